"""Queries for the corpus builds and labelled pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.registry import query, table
from topicloom.catalog.texts import LATIN_KEEP, clean_corpus_sql, clean_record_sql, section_sql
from topicloom.functions import fixed_values as V
from topicloom.functions import text as T
from topicloom.operators import corpus
from topicloom.plans import corpora as plans
from topicloom.sources import files
from topicloom.staging import stage_path

FIRST_LINE = "^(.+?)\\n"
INNER_LINE = "\\n(.+?)\\n"

PIECES_SQL = rf"""
    fields AS (
        SELECT 0 AS field_no, 'issue' AS field, doc_id, nullif(regexp_extract(text, '{FIRST_LINE}', 1), '') AS t FROM documents
        UNION ALL SELECT 1, 'summary', doc_id, text FROM documents
        UNION ALL SELECT 2, 'contents', doc_id,
            nullif(coalesce(nullif(regexp_extract(text, '{FIRST_LINE}', 1), ''), '') || coalesce(nullif(regexp_extract(text, '{INNER_LINE}', 1), ''), ''), '')
        FROM documents),
    split AS (SELECT field_no, field, doc_id, string_split_regex(t, '[./?\n]') AS parts FROM fields WHERE t IS NOT NULL),
    numbered AS (SELECT field_no, field, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split),
    corpus AS (SELECT CAST(field_no AS INTEGER) AS field_no, field, doc_id, CAST(i - 1 AS INTEGER) AS pos,
                      {clean_corpus_sql('parts[i]')} AS sentence
               FROM numbered WHERE length(parts[i]) > 20)"""


def _sentences(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = F.col("text")
    return corpus.sentence_corpus(
        docs,
        "doc_id",
        {
            "issue": T.joined_sections(text, (FIRST_LINE,)),
            "summary": text,
            "contents": T.joined_sections(text, (FIRST_LINE, INNER_LINE)),
        },
    )


@query("sentence_corpus", f"WITH {PIECES_SQL} SELECT field_no, field, doc_id, pos, sentence FROM corpus")
def sentence_corpus(spark, folder):
    return _sentences(spark, folder)


@query(
    "corpus_sample",
    f"""WITH {PIECES_SQL} SELECT field_no, field, doc_id, pos, sentence FROM corpus
        WHERE field_no < 2 ORDER BY field_no, doc_id, pos LIMIT 1000""",
)
def corpus_sample(spark, folder):
    """The first 1000 lines of the small corpus, which holds the first two fields."""
    return corpus.corpus_sample(_sentences(spark, folder).where("field_no < 2"))


@query(
    "corpus_files",
    f"""WITH {PIECES_SQL},
        lines AS (SELECT 'small' AS file, sentence FROM corpus WHERE field_no < 2
                  UNION ALL SELECT 'large', sentence FROM corpus
                  UNION ALL SELECT 'sample', sentence FROM (
                      SELECT sentence FROM corpus WHERE field_no < 2 ORDER BY field_no, doc_id, pos LIMIT 1000))
        SELECT file, sentence, count(*) AS n FROM lines GROUP BY file, sentence""",
)
def corpus_files(spark, folder):
    """The three line files, read back and counted; sample is the first 1000 lines of small."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cases = docs.select(
        "doc_id", T.joined_sections(F.col("text"), (FIRST_LINE,)).alias("judgment_issue"),
        F.col("text").alias("judgment_summary"), F.col("text").alias("judgment_contents"),
    )
    path = stage_path(spark, "corpora")
    plans.write_sentence_corpora(cases, path, "doc_id", sections=(FIRST_LINE, INNER_LINE))
    parts = [
        spark.read.text(f"{path}/{name}").select(F.lit(name).alias("file"), F.col("value").alias("sentence"))
        for name in ("small", "large", "sample")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("file", "sentence").agg(F.count(F.lit(1)).alias("n"))


RULING = ((FIRST_LINE, "", 0),)
REASONING = ((INNER_LINE, " end", 0), (FIRST_LINE, "", 8))


@query(
    "corpus_nested_json",
    f"""WITH c AS (SELECT doc_id, lang, source, text, nullif(regexp_extract(text, '{FIRST_LINE}', 1), '') AS issue,
                          CASE WHEN length(text) >= 100 THEN text END AS contents FROM documents),
             s AS (SELECT *, {section_sql('contents', RULING)} AS ruling, {section_sql('contents', REASONING)} AS reasoning FROM c)
        SELECT CAST(doc_id AS VARCHAR) AS id, lang AS case_name, source AS case_num,
               {clean_record_sql('issue', LATIN_KEEP)} AS issue, {clean_record_sql('text', LATIN_KEEP)} AS summary,
               {clean_record_sql('ruling', LATIN_KEEP)} AS ruling, {clean_record_sql('reasoning', LATIN_KEEP)} AS reasoning
        FROM s""",
)
def corpus_nested_json(spark, folder):
    """Records are written to the JSON sink and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    docs = docs.withColumn("issue", T.joined_sections(F.col("text"), (FIRST_LINE,)))
    records = corpus.nested_records(
        docs, "doc_id", "lang", "source", "issue", "text", "text", RULING, REASONING, keep=LATIN_KEEP
    )
    path = stage_path(spark, "records")
    files.write_json(records, path)
    back = files.read_json_lines(spark, path, records.schema)
    return back.select(
        "id", "law_case.case_name", "law_case.case_num", "law_case.issue", "law_case.summary",
        "law_case.full_text.ruling", "law_case.full_text.reasoning",
    )


#: Earliest date of the cases, exclusive.
AFTER = 19970000.0

CASES_SQL = f"""
    dates AS (SELECT o_orderkey AS doc_id, CAST(strftime(o_orderdate, '%Y%m%d') AS DOUBLE) AS date FROM orders),
    cases AS (SELECT CAST(d.doc_id AS VARCHAR) AS case_id, lang, source, date, nullif(regexp_extract(text, '{FIRST_LINE}', 1), '') AS issue, text
              FROM documents d LEFT JOIN dates USING (doc_id)),
    whole AS (SELECT * FROM cases WHERE date IS NOT NULL AND issue IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL),
    firsts AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY issue ORDER BY case_id) = 1),
    kept AS (SELECT *, CASE WHEN length(text) >= 100 THEN text END AS contents FROM firsts WHERE date > {AFTER}),
    built AS (SELECT case_id AS id, lang AS case_name, source AS case_num, {clean_record_sql('issue', V.RECORD_KEEP)} AS issue,
                     {clean_record_sql('text', V.RECORD_KEEP)} AS summary, {clean_record_sql(section_sql('contents', V.RULING_RULES), V.RECORD_KEEP)} AS ruling,
                     {clean_record_sql(section_sql('contents', V.REASONING_RULES), V.RECORD_KEEP)} AS reasoning FROM kept)"""
RECORD = "id string, law_case struct<case_name:string,case_num:string,issue:string,summary:string,full_text:struct<ruling:string,reasoning:string>>"


def _cases(spark, folder):
    """Documents as a case table: their first line is the issue, the date is that of the order of the same number."""
    dates = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyyMMdd").cast("double").alias("date"))
    docs = table(spark, folder, "documents").join(dates, "doc_id", "left")
    return docs.select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("case_name"), F.col("source").alias("case_number"), "date",
        T.joined_sections(F.col("text"), (FIRST_LINE,)).alias("judgment_issue"), F.col("text").alias("judgment_summary"),
        F.col("text").alias("judgment_contents"),
    )


def _flat(records):
    return records.select(
        "id", "law_case.case_name", "law_case.case_num", "law_case.issue", "law_case.summary",
        "law_case.full_text.ruling", "law_case.full_text.reasoning",
    )


@query("corpus_case_records", f"WITH {CASES_SQL} SELECT * FROM built")
def corpus_case_records(spark, folder):
    """The whole build from a raw case table to files: complete rows, first per issue, after a date, fixed section rules."""
    path = stage_path(spark, "case-records")
    plans.write_nested_records(_cases(spark, folder), path, AFTER)
    return _flat(files.read_json_lines(spark, path, RECORD))


@query("corpus_case_array", f"WITH {CASES_SQL} SELECT * FROM built")
def corpus_case_array(spark, folder):
    """The same build as one JSON array, whose lines are read back as records."""
    path = f"{stage_path(spark, 'case-array')}/cases.json"
    plans.write_nested_array(_cases(spark, folder), path, AFTER)
    lines = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace(F.regexp_replace("value", r"^\[", ""), r"[,\]]$", "")
    return _flat(lines.select(F.from_json(line, RECORD).alias("r")).select("r.*"))


ROLES = {"system": 0, "user": 1, "assistant": 2}
TURNS_SQL = """turns AS (SELECT a.conv_id, a.text AS sentence1, b.text AS sentence2, b.role
                         FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turns(spark, folder):
    """Neighbouring turns by an equi-join on conversation and turn, which no long conversation can skew."""
    talk = table(spark, folder, "conversations")
    first = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("sentence1"))
    second = talk.select("conv_id", "turn", F.col("text").alias("sentence2"), "role")
    return first.join(second, ["conv_id", "turn"])


@query(
    "nli_prepare",
    f"""WITH {TURNS_SQL}
        SELECT DISTINCT sentence1 AS text_1, sentence2 AS text_2,
               CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END AS label
        FROM turns WHERE sentence1 IS NOT NULL AND sentence2 IS NOT NULL AND role IS NOT NULL""",
)
def nli_prepare(spark, folder):
    pairs = _turns(spark, folder).select("sentence1", "sentence2", F.col("role").alias("gold_label"))
    ready = corpus.inference_pairs(pairs, labels=ROLES)
    return ready.select(F.col("texts")[0].alias("text_1"), F.col("texts")[1].alias("text_2"), "label")


@query(
    "sts_prepare",
    f"""WITH {TURNS_SQL},
             scored AS (SELECT DISTINCT t.conv_id, t.sentence1, t.sentence2, CAST(l.quality AS DOUBLE) * 2.5 + l.toxic AS score
                        FROM turns t JOIN labels l ON l.doc_id = t.conv_id)
        SELECT sentence1 AS text_1, sentence2 AS text_2, score / 5.0 AS label FROM scored
        WHERE sentence1 IS NOT NULL AND sentence2 IS NOT NULL AND score IS NOT NULL""",
)
def sts_prepare(spark, folder):
    """Rows are distinct on all columns, the conversation included, before the projection."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("conv_id"), (F.col("quality").cast("double") * 2.5 + F.col("toxic")).alias("score")
    )
    rows = _turns(spark, folder).join(labels, "conv_id").select("conv_id", "score", "sentence1", "sentence2")
    ready = corpus.similarity_pairs(rows)
    return ready.select(F.col("texts")[0].alias("text_1"), F.col("texts")[1].alias("text_2"), "label")
