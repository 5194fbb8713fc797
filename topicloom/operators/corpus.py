"""Corpus builds: sentence lines, nested records, labelled pairs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as V
from topicloom.functions import text as T
from topicloom.operators import tables


def sentence_corpus(df: DataFrame, id_col: str, fields: Mapping[str, Column], clean: bool = True) -> DataFrame:
    """``(field_no, field, doc_id, pos, sentence)`` for every field in order.

    Pieces are filtered by length before cleaning, so a kept one may clean to an
    empty line.  The pieces of all fields form one array per row, which is
    unrolled once.  Without ``clean`` the caller cleans them later.
    """
    empty = F.array().cast("array<struct<field_no:int,field:string,pos:int,raw:string>>")
    pieces = F.concat(
        *[
            F.coalesce(T.corpus_sentences(text, F.lit(i).alias("field_no"), F.lit(name).alias("field")), empty)
            for i, (name, text) in enumerate(fields.items())
        ]
    )
    rows = df.select(F.col(id_col).alias("doc_id"), F.explode(pieces).alias("p"))
    sentence = T.clean_corpus(F.col("p.raw")) if clean else F.col("p.raw")
    return rows.select("p.field_no", "p.field", "doc_id", "p.pos", sentence.alias("sentence"))


def corpus_sample(corpus: DataFrame, rows: int = 1000) -> DataFrame:
    """First lines of the corpus in corpus order; each task keeps only its best rows."""
    return corpus.orderBy("field_no", "doc_id", "pos").limit(rows)


def nested_records(
    df: DataFrame,
    id_col: str,
    name_col: str,
    number_col: str,
    issue_col: str,
    summary_col: str,
    contents_col: str,
    ruling_rules: Iterable[tuple[str, str, int]] = V.RULING_RULES,
    reasoning_rules: Iterable[tuple[str, str, int]] = V.REASONING_RULES,
    mapping: Mapping[str, str] | None = None,
    keep: str = V.RECORD_KEEP,
    shortest: int = V.SHORTEST_FULL_TEXT,
    beside: Sequence[str] = (),
) -> DataFrame:
    """``(id, law_case)`` records; contents shorter than the bound have no full text.  Columns ``beside`` come along."""

    def clean(text: Column) -> Column:
        return T.clean_sentence(text, mapping, keep)

    contents = F.when(F.length(contents_col) >= shortest, F.col(contents_col))
    full_text = F.struct(
        clean(T.first_section(contents, ruling_rules)).alias("ruling"),
        clean(T.first_section(contents, reasoning_rules)).alias("reasoning"),
    )
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.struct(
            F.col(name_col).alias("case_name"),
            F.col(number_col).alias("case_num"),
            clean(F.col(issue_col)).alias("issue"),
            clean(F.col(summary_col)).alias("summary"),
            full_text.alias("full_text"),
        ).alias("law_case"),
        *beside,
    )


def inference_pairs(
    df: DataFrame, label_col: str = "gold_label", labels: Mapping[str, int] = V.INFERENCE_LABELS, strict: bool = True
) -> DataFrame:
    """Complete distinct ``(sentence1, sentence2, label)`` rows as ``(texts, label)``.

    An unknown label is an error, or null when not strict.
    """
    ready = tables.drop_incomplete(df).dropDuplicates()
    number = None
    for name, value in labels.items():
        hit = F.col(label_col) == name
        number = F.when(hit, F.lit(value)) if number is None else number.when(hit, F.lit(value))
    if strict:
        number = number.otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.col(label_col))).cast("int"))
    return ready.select(F.array("sentence1", "sentence2").alias("texts"), number.alias("label"))


def similarity_pairs(df: DataFrame, score_col: str = "score", scale: float = V.SIMILARITY_SCALE) -> DataFrame:
    """Complete distinct rows as ``(texts, label)``; rows are compared on all their columns."""
    ready = tables.drop_incomplete(df).dropDuplicates().select(score_col, "sentence1", "sentence2")
    return ready.select(
        F.array("sentence1", "sentence2").alias("texts"), (F.col(score_col) / F.lit(scale)).alias("label")
    )


def corpus_lines(corpus: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One-column table for the text sink, optionally of some fields only."""
    if fields is not None:
        corpus = corpus.where(F.col("field").isin(*fields))
    return corpus.select("sentence")
