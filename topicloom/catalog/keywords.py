"""Queries for term counts, class TF-IDF and topic keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.registry import query, sql_text, table
from topicloom.functions import text as T
from topicloom.operators import keywords as W
from topicloom.sources import files
from topicloom.staging import stage, stage_path

STOP = ("the", "and", "of", "de", "la", "que", "der", "und", "le", "en")
STOP_SQL = ", ".join(sql_text(w) for w in STOP)


def tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def counts_sql(topic: str, source: str = "documents", where: str = f"term NOT IN ({STOP_SQL})") -> str:
    return f"""
    words AS (SELECT {topic} AS topic, unnest({tokens_sql('text')}) AS term FROM {source}),
    counts AS (SELECT topic, term, count(*) AS n FROM words WHERE {where} GROUP BY topic, term),
    per_topic AS (SELECT topic, sum(n) AS w FROM counts GROUP BY topic),
    per_term AS (SELECT term, sum(n) AS sum_t FROM counts GROUP BY term),
    scored AS (SELECT c.topic, c.term, c.n, c.n / p.w AS tf, ln((SELECT count(*) FROM documents) / s.sum_t) AS idf
               FROM counts c JOIN per_topic p ON c.topic = p.topic JOIN per_term s ON c.term = s.term),
    ranked AS (SELECT topic, term, round(tf * idf, 9) AS score,
                      row_number() OVER (PARTITION BY topic ORDER BY round(tf * idf, 9) DESC, term) AS rank FROM scored)"""


def _docs(spark, folder, *columns):
    return table(spark, folder, "documents").select("doc_id", "text", *columns)


@query("topic_term_counts", f"WITH {counts_sql('lang')} SELECT topic, term, n FROM counts")
def topic_term_counts(spark, folder):
    return W.topic_term_counts(_docs(spark, folder, "lang"), "text", "lang", STOP)


GRAMS_SQL = f"""
    lists AS (SELECT lang AS topic, doc_id, list_filter({tokens_sql('text')}, lambda t: NOT list_contains([{STOP_SQL}], t)) AS ws FROM documents),
    positions AS (SELECT topic, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
    grams AS (SELECT topic, ws[i] AS term FROM positions
              UNION ALL SELECT topic, ws[i] || ' ' || ws[i + 1] FROM positions WHERE i < len(ws))"""


@query("ngram_counts", f"WITH {GRAMS_SQL} SELECT topic, term, count(*) AS n FROM grams GROUP BY topic, term")
def ngram_counts(spark, folder):
    return W.topic_term_counts(_docs(spark, folder, "lang"), "text", "lang", STOP, (1, 2))


@query(
    "ngram_counts_cross_docs",
    f"""WITH {GRAMS_SQL},
             placed AS MATERIALIZED (SELECT topic, doc_id, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM lists),
             line AS (SELECT topic, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c
                      FROM placed WINDOW w AS (PARTITION BY topic ORDER BY doc_id, i)),
             runs AS (SELECT topic, a || ' ' || b AS term FROM line WHERE b IS NOT NULL
                      UNION ALL SELECT topic, a || ' ' || b || ' ' || c FROM line WHERE c IS NOT NULL)
        SELECT topic, term, count(*) AS n FROM runs GROUP BY topic, term""",
)
def ngram_counts_cross_docs(spark, folder):
    """Two- and three-word runs, also over text borders."""
    return W.topic_term_counts(_docs(spark, folder, "lang"), "text", "lang", STOP, (2, 3), cross_docs=True, order_col="doc_id")


@query(
    "ctfidf",
    f"""WITH {counts_sql('lang')} SELECT topic, term, n, round(tf, 9) AS tf, round(idf, 9) AS idf, round(tf * idf, 9) AS score FROM scored""",
)
def ctfidf(spark, folder):
    docs = _docs(spark, folder, "lang")
    counts = stage(W.topic_term_counts(docs, "text", "lang", STOP), "terms")
    scored = W.class_tf_idf(counts, table(spark, folder, "documents"))
    return scored.select("topic", "term", "n", *[F.round(c, 9).alias(c) for c in ("tf", "idf", "score")])


@query(
    "changed_term_counts",
    f"""WITH {counts_sql("CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'moved' ELSE lang END")}
        SELECT topic, term, n FROM counts WHERE topic IS NOT NULL""",
)
def changed_term_counts(spark, folder):
    """Counts kept from before: a third of the texts goes to another topic, a fifth goes, a seventh is new."""
    docs = _docs(spark, folder, "lang")
    number = F.col("doc_id")
    old = F.when(number % 7 != 0, F.col("lang"))
    new = F.when(number % 5 == 0, F.lit(None)).when(number % 3 == 0, "moved").otherwise(F.col("lang"))
    both = docs.withColumn("old_topic", old).withColumn("new_topic", new)
    kept = stage(W.topic_term_counts(both.where("old_topic IS NOT NULL"), "text", "old_topic", STOP), "terms")
    return W.changed_counts(kept, both, "text", stopwords=STOP)


KEYWORDS_SQL = f"{counts_sql('source')}, keys AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 10 GROUP BY topic)"


def source_keywords(spark, folder):
    return W.topic_keywords(_docs(spark, folder, "source"), "text", 10, "source", STOP)


@query("topic_keywords", f"WITH {KEYWORDS_SQL} SELECT topic, keywords FROM keys")
def topic_keywords(spark, folder):
    return source_keywords(spark, folder).select("topic", F.array_join("keywords", ", ").alias("keywords"))


@query("topic_keywords_attach", f"WITH {KEYWORDS_SQL} SELECT doc_id, source, keywords FROM documents JOIN keys ON topic = source")
def topic_keywords_attach(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return W.attach_keywords(docs, source_keywords(spark, folder), "source").select("doc_id", "source", "keywords")


WORD_FILE_SQL = f"SELECT unnest({tokens_sql('text')}) FROM benchmark"


def _word_file(spark, folder):
    """Words of the benchmark texts, written as lines and scanned."""
    words = table(spark, folder, "benchmark").select(F.explode(T.tokens(F.col("text"))))
    path = stage_path(spark, "stopwords")
    files.write_lines(words, path)
    return files.read_word_list(spark, path)


@query(
    "keywords_with_word_file",
    f"""WITH {counts_sql('source', where=f'term NOT IN ({WORD_FILE_SQL})')},
        keys AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 10 GROUP BY topic)
        SELECT t.topic, coalesce(keywords, '') AS keywords FROM (SELECT DISTINCT source AS topic FROM documents) t LEFT JOIN keys ON keys.topic = t.topic""",
)
def keywords_with_word_file(spark, folder):
    found = W.topic_keywords(_docs(spark, folder, "source"), "text", 10, "source", _word_file(spark, folder))
    return found.select("topic", F.array_join("keywords", ", ").alias("keywords"))


@query(
    "ngram_counts_word_file",
    f"""WITH lists AS (SELECT lang AS topic, list_filter({tokens_sql('text')}, lambda t: NOT list_contains(s, t)) AS ws
                      FROM documents CROSS JOIN (SELECT list(DISTINCT w) AS s FROM (SELECT unnest({tokens_sql('text')}) AS w FROM benchmark))),
        positions AS (SELECT topic, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
        grams AS (SELECT topic, ws[i] AS term FROM positions UNION ALL SELECT topic, ws[i] || ' ' || ws[i + 1] FROM positions WHERE i < len(ws))
        SELECT topic, term, count(*) AS n FROM grams GROUP BY topic, term""",
)
def ngram_counts_word_file(spark, folder):
    """One- and two-word terms after the words of the file are gone."""
    return W.topic_term_counts(_docs(spark, folder, "lang"), "text", "lang", _word_file(spark, folder), (1, 2))
