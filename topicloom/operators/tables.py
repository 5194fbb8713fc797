"""Row operators on document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text as T


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any null."""
    return df.na.drop("any", subset=columns)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Keys travel as a digest, so long texts are compared by 32 hex digits.  The
    rank filter runs in every task before the shuffle: a key with a third of all
    rows sends one row per task.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    nulls = [F.col(k).isNull().cast("string") for k in keys]
    lengths = [F.length(p).cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", *nulls, *lengths, *parts))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return df.withColumn("_key", digest).withColumn("_first", first).where("_first = 1").drop("_key", "_first")


def clean_table(
    df: DataFrame, key: str, date_col: str, after: float, tie: str, required: list[str] | None = None
) -> DataFrame:
    """Drop incomplete rows, keep the first row per key, then keep dates strictly after the bound.

    The date filter comes last on purpose: a key whose first row is too old goes
    away with it.
    """
    complete = drop_incomplete(df, required)
    first = keep_first(complete, [key], [F.asc(tie)])
    return first.where(F.col(date_col) > F.lit(after))


def year_window(df: DataFrame, reference_col: str, low: int, high: int, out: str = "year") -> DataFrame:
    """Rows whose reference ends in a year between the bounds, both included."""
    year = T.trailing_year(F.col(reference_col))
    return df.withColumn(out, year).where(F.col(out).between(low, high))


def preview(df: DataFrame, order: list[Column], rows: int = 5) -> DataFrame:
    """First rows in the given order, each with the row count of the table."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(rows).withColumn("total_rows", total)
