"""Corpus builds from a case table to files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as V
from topicloom.functions import text as T
from topicloom.operators import corpus, tables
from topicloom.sources import files
from topicloom.sources.arrays import write_json_array
from topicloom.staging import stage


def write_sentence_corpora(
    cases: DataFrame, folder: str, id_col: str = "case_id", sample: int = 1000, sections: Sequence[str] = V.CORPUS_SECTIONS
) -> None:
    """Three line files: issues and summaries (small), these and contents (large), first lines of small.

    Lines keep corpus order across the part files: field, then row, then position.
    """
    lines = corpus.sentence_corpus(
        cases,
        id_col,
        {
            "issue": F.col("judgment_issue"),
            "summary": F.col("judgment_summary"),
            "contents": T.joined_sections(F.col("judgment_contents"), sections),
        },
        clean=False,
    )
    order = ("field_no", "doc_id", "pos")
    # Lines of both files are put in order by one shuffle, and cleaned after it: putting in order reads its input twice.
    names = F.when(F.col("field_no") < 2, F.array(F.lit("small"), F.lit("large"))).otherwise(F.array(F.lit("large")))
    ranged = lines.repartitionByRange(*order).select(*order, T.clean_corpus(F.col("sentence")).alias("sentence"))
    # a line is cleaned once, before it goes to its files
    named = ranged.select("*", F.explode(names).alias("file"))
    files.write_line_files(named.sortWithinPartitions("file", *order).select("sentence", "file"), folder, "file", ("small", "large"))
    first = corpus.corpus_sample(lines.where(F.col("field_no") < 2), sample)
    files.write_lines(first.select(T.clean_corpus(F.col("sentence")).alias("sentence")), f"{folder}/sample")


def _nested(cases: DataFrame, after: float, mapping: Mapping[str, str] | None) -> DataFrame:
    kept = tables.clean_table(cases, "judgment_issue", "date", after, "case_id")
    records = corpus.nested_records(
        kept, "case_id", "case_name", "case_number", "judgment_issue", "judgment_summary", "judgment_contents",
        V.RULING_RULES, V.REASONING_RULES, mapping, beside=("date", "case_id"),
    )
    # putting rows in order reads them twice, once for a sample
    return stage(records, "nested")


def write_nested_records(
    cases: DataFrame, path: str, after: float = 19900000.0, mapping: Mapping[str, str] | None = None
) -> None:
    """Complete cases after the date, first per issue, as nested JSON lines in date order."""
    records = _nested(cases, after, mapping).orderBy("date", "case_id")
    files.write_json(records.select("id", "law_case"), path)


def write_nested_array(
    cases: DataFrame, path: str, after: float = 19900000.0, mapping: Mapping[str, str] | None = None
) -> None:
    """The same records as one JSON array in one file, in date order."""
    write_json_array(_nested(cases, after, mapping), path, ["date", "case_id"], ["id", "law_case"])
