"""Registered queries of the ten operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.catalog.registry import table
from topicloom.llm import containment, dart_minhash, imatch, label_propagation, lightest_repair, line_crf, line_deletion, log_bilinear, mixing, ngram_bayes, phrase_automata, residue_negatives, robust_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def fold(folds: int, id_col: str = "doc_id") -> Column:
    """Remainder of the CRC-32 of the id as text; null ids have none and count as learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))


@_query("op1_near_duplicates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = dart_minhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "copies", "keep")


def quality_field(spark: SparkSession, folder: str, docs: DataFrame) -> line_crf.Field:
    return line_crf.train(docs, table(spark, folder, "labels"), fold(5) != 0)


@_query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = line_crf.score(docs, quality_field(spark, folder, docs))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= line_crf.ACCEPT).cast("int").alias("predicted"), "bad_lines")


_SHORT = "unnest([struct_pack(m := n, k := 0), struct_pack(m := n, k := 1), struct_pack(m := n - 1, k := 0), struct_pack(m := n - 1, k := 1)])"


@_query(
    "op3_near_lines",
    f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM split, unnest(range(1, len(ls) + 1)) AS t(i)),
    firsts AS (SELECT line, min(doc_id * 1000000 + pos) AS place, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
    halves AS (SELECT line, place, n, h.m AS m, h.k AS k,
                      CASE h.k WHEN 0 THEN left(line, h.m // 2) ELSE right(line, h.m - h.m // 2) END AS half
               FROM (SELECT line, place, n, {_SHORT} AS h FROM firsts WHERE n >= 9)),
    pairs AS (SELECT DISTINCT a.line AS x, a.n AS nx, b.line AS y, b.n AS ny
              FROM halves a JOIN halves b ON a.m = b.m AND a.k = b.k AND a.half = b.half
              WHERE a.place < b.place AND b.n >= 10 AND abs(a.n - b.n) <= 1),
    near AS (SELECT DISTINCT y FROM pairs
             WHERE len(list_filter(range(0, greatest(nx, ny)), lambda i: left(x, i) = left(y, i) AND
                 substr(x, i + CASE WHEN nx >= ny THEN 2 ELSE 1 END) = substr(y, i + CASE WHEN ny >= nx THEN 2 ELSE 1 END))) > 0),
    judged AS (SELECT l.doc_id, l.pos, l.line, l.line <> '' AND (near.y IS NOT NULL OR l.doc_id * 1000000 + l.pos <> f.place) AS gone
               FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near ON l.line = near.y)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = line_deletion.dedup_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op4_repeated_passages")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_automata.remove_repeats(table(spark, folder, "documents")).drop("kept")


@_query("op5_language")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = ngram_bayes.predict(docs, ngram_bayes.train(docs, fold(4) != 2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@_query("op6_language_model")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model, counts = log_bilinear.train(docs, fold(5) != 1)
    scored = log_bilinear.score(docs, model, counts)
    return scored.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op7_fingerprints")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return imatch.edit_report(docs, imatch.lexicon(docs))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@_query(
    "op8_benchmark_containment",
    rf"""
    WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
    asked AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    wanted AS (SELECT DISTINCT item_id, list_slice(w, i, i + 4) AS s
               FROM asked, unnest(range(1, len(w) - 3)) AS t(i)),
    sizes AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id),
    have AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s
             FROM words, unnest(range(1, len(w) - 3)) AS t(i)
             WHERE list_slice(w, i, i + 4) IN (SELECT s FROM wanted)),
    found AS (SELECT doc_id, item_id, count(*) AS n_found FROM have JOIN wanted USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_found, n_shingles, n_found / n_shingles AS containment
    FROM found JOIN sizes USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return containment.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query("op9_source_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, folder, "documents")).drop("source")


@_query("op10_balanced_shards")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = label_propagation.balanced_shards(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query(
    "op11_hard_negatives",
    """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
                      CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
               FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    ranked AS (SELECT p.anchor_id, p.positive_id,
                      CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
                      s.other_id AS negative_id, p.positive_score, s.score AS negative_score
               FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
               WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
    SELECT * FROM ranked WHERE rank <= 10
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return residue_negatives.hard_negatives(table(spark, folder, "embeddings"), vec_id % 100 == 0, label=label)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with the damage that the CRC-32 of ``conv_id:turn`` chooses; ``there`` is false for dropped rows."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    chosen = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return chosen.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") != 0).alias("there"), F.explode(times).alias("copy")).drop("copy")


_KEY = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
_LAST = r"regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)"


@_query(
    "op12_conversation_repair",
    rf"""
    WITH RECURSIVE
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KEY} AS k FROM conversations),
    chosen AS (SELECT *, xor(list_reduce(
                   list_concat([4294967295::BIGINT], list_transform(range(0, 8 * strlen(k)), lambda j: (ascii(substr(k, j // 8 + 1, 1)) >> (j % 8)::INTEGER) & 1)::BIGINT[]),
                   lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS harm FROM keyed),
    harmed AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
                      CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
               FROM chosen, unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS u(copy) WHERE harm <> 0),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, left(role, 1) AS first FROM harmed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i FROM numbered),
    judged AS (SELECT *, CASE WHEN {_LAST} = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN {_LAST} NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
                      lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS pair FROM placed),
    insertions(q, p, ins) AS (VALUES ('-', '-', 0), ('-', 'u', 1), ('-', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2), ('u', 'u', 0), ('u', 'a', 1), ('a', 'a', 0), ('a', 'u', 1)),
    follows(q, x, p) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
    edits AS (SELECT q, x, p, 'K' AS letter, 0 AS cost FROM follows UNION ALL SELECT q, x, p, 'R', 3 FROM follows WHERE x <> 's'
              UNION ALL SELECT DISTINCT q, '', q, 'D', 4 FROM insertions),
    way AS (SELECT DISTINCT conv_id, 0 AS i, '-' AS q, {{'c': 0, 'w': ''}} AS v FROM judged
            UNION ALL
            SELECT way.conv_id, way.i + 1, e.p,
                   min({{'c': way.v.c + 3 * s.ins + e.cost + CASE WHEN r.fault = 't' AND e.letter <> 'D' THEN 3 ELSE 0 END, 'w': way.v.w || repeat('I', s.ins) || e.letter}})
            FROM way JOIN insertions s ON s.q = way.q JOIN judged r ON r.conv_id = way.conv_id AND r.i = way.i + 1
            JOIN edits e ON e.q = s.p AND (e.letter = 'D' OR r.fault NOT IN ('b', 'd')) AND (e.letter <> 'K' OR e.x = r.first)
            GROUP BY way.conv_id, way.i, e.p),
    counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                       count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                       count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
    best AS (SELECT way.conv_id, min({{'c': way.v.c + 3 * s.ins, 'w': way.v.w || repeat('I', s.ins)}}) AS v
             FROM way JOIN counted ON counted.conv_id = way.conv_id AND counted.n = way.i JOIN insertions s ON s.q = way.q AND s.p IN ('-', 'a') GROUP BY way.conv_id),
    letters AS (SELECT conv_id, j, substr(v.w, j, 1) AS letter, length(replace(left(v.w, j), 'I', '')) AS i, length(replace(left(v.w, j), 'D', '')) AS o,
                       length(replace(v.w, 'D', '')) % 2 AS odd FROM best, unnest(range(1, length(v.w) + 1)) AS t(j)),
    lines AS (SELECT l.conv_id, l.j, CASE WHEN l.letter = 'K' THEN r.role WHEN (l.o + l.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                     CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS line
              FROM letters l LEFT JOIN judged r ON r.conv_id = l.conv_id AND r.i = l.i WHERE l.letter <> 'D'),
    joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS body FROM lines GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(coalesce(best.v.c, 0) AS BIGINT) AS cost, coalesce(best.v.w, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN joined USING (conv_id)
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lightest_repair.report(lightest_repair.repair(damaged(table(spark, folder, "conversations")), present=F.col("there")))


@_query("op13_quality_rules")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    judged = robust_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
