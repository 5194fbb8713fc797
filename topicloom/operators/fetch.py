"""Documents laid out by a bucket of their id, so that fetching a few of them reads a few folders."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.staging import stage

ROWS_PER_BUCKET = 20_000
MAX_BUCKETS = 10_000
_NAME = re.compile(r"bucket_of_(\d+)$")


def bucket_of(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col(id_col).cast("long")), F.lit(buckets)).cast("int")


def save_buckets(docs: DataFrame, path: str, id_col: str = "doc_id", buckets: int | None = None, mode: str = "errorifexists") -> int:
    """Write ``docs`` with one folder per bucket of the id, sorted by id inside; returns the number of buckets.

    The number of buckets is part of the folders' names, so a reader needs
    nothing else.  Ids decide the bucket, so buckets are even whatever the rows hold.
    """
    buckets = buckets or max(1, min(MAX_BUCKETS, math.ceil(docs.count() / ROWS_PER_BUCKET)))
    name = f"bucket_of_{buckets}"
    laid = docs.withColumn(name, bucket_of(id_col, buckets)).repartition(name).sortWithinPartitions(name, id_col)
    laid.write.mode(mode).partitionBy(name).parquet(path)
    return buckets


def bucket_column(docs: DataFrame) -> str | None:
    """The bucket column of a table that ``save_buckets`` wrote; None for other tables."""
    return next((c for c in docs.columns if _NAME.match(c)), None)


def fetch_rows(wanted: DataFrame, docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Rows of ``wanted`` with ``columns`` of the documents they name in ``id_col``.

    ``docs`` is a table by buckets.  The wanted rows are written first; where
    they are small enough to be broadcast, the scan gets their buckets at run
    time and skips all other folders, and reads only the chosen columns.
    """
    name = bucket_column(docs)
    if name is None:
        raise ValueError("the documents have no bucket column; write them with save_buckets")
    wanted = stage(wanted.withColumn(name, bucket_of(id_col, int(_NAME.match(name)[1]))), "wanted")
    # holds for every bucket; Spark prunes folders at run time only by a side that has a comparison
    wanted = wanted.where(F.col(name) >= 0)
    chosen = docs.select(name, id_col, *[c for c in columns if c != id_col])
    return wanted.join(chosen, [name, id_col]).drop(name)
