"""Cutting ids into pages in a seeded random order, or in an order that puts similar vectors next to each other."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.functions.encoders import arrow_once
from topicloom.functions.vectors import ROUND
from topicloom.staging import ordered_index

ROWS_PER_BUCKET = 100_000
MAX_DIGITS = 5
#: Hyperplanes of a locality key; pages of a table of ``n`` pages share about ``log2(n)`` of them.
PLANES = 32


def shuffle_key(id_col: str, seed: str) -> Column:
    """Seeded random order that any SQL engine can repeat: md5 of seed and id."""
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def _leading_hex(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def page_count(rows: int, page_size: int) -> int:
    return math.ceil(rows / page_size)


def hash_pages(df: DataFrame, id_col: str, pages: int, seed: str = "0", out: str = "page") -> DataFrame:
    """Page from the hash alone: no shuffle, page sizes equal only on average."""
    return df.withColumn(out, F.pmod(_leading_hex(shuffle_key(id_col, seed), 8), F.lit(max(1, pages))).cast("int"))


def balanced_pages(
    df: DataFrame, id_col: str, page_size: int, seed: str = "0", rows: int | None = None, out: str = "page"
) -> DataFrame:
    """``ceil(N / page_size)`` pages in hash order whose sizes differ by at most one.

    The rank of a row is its rank inside a hash bucket plus the rows of the
    buckets before it.  Buckets are even whatever the data looks like, because
    ids are unique.  The same pages come out of ``ntile`` over the whole table,
    which would be one task.
    """
    rows = df.count() if rows is None else rows
    pages = page_count(rows, page_size)
    if pages <= 1:
        return df.withColumn(out, F.lit(0))
    digits = max(1, min(MAX_DIGITS, math.ceil(math.log(max(2, rows / ROWS_PER_BUCKET), 16))))
    keyed = df.withColumn("_key", shuffle_key(id_col, seed)).withColumn("_bucket", _leading_hex(F.col("_key"), digits))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy("_key", id_col)
    # The offset table has at most 16 ** MAX_DIGITS rows, 16 MB.
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), "_bucket")
    rank = F.col("_rank") + F.col("_offset")
    small, longer = divmod(rows, pages)
    in_long = F.floor(rank / (small + 1))
    in_short = F.floor((rank - longer * (small + 1)) / small) + longer
    page = F.when(rank < longer * (small + 1), in_long).otherwise(in_short)
    return ranked.withColumn(out, page.cast("int")).drop("_key", "_bucket", "_rank", "_offset")


def hyperplanes(seed: str, dim: int, count: int = PLANES) -> np.ndarray:
    """``(count, dim)`` signs: 1 where the first hex digit of the md5 of ``seed/plane/place`` is even, else -1."""
    digit = lambda j, i: int(hashlib.md5(f"{seed}/{j}/{i}".encode()).hexdigest()[0], 16)
    return np.array([[1.0 if digit(j, i) % 2 == 0 else -1.0 for i in range(dim)] for j in range(count)])


def locality_key(vec: Column, seed: str) -> Column:
    """One character per hyperplane, ``1`` on its side, so that near vectors often share the first ones."""

    def run(vecs: pa.Array) -> pa.Array:
        rows = K.matrix(vecs)
        sides = np.round(rows @ hyperplanes(seed, rows.shape[1]).T, ROUND) >= 0
        return pa.array(["".join(r) for r in np.where(sides, "1", "0")], pa.string())

    run.__annotations__ = {"vecs": pa.Array, "return": pa.Array}
    return arrow_once(run, "string")(vec)


def page_shift(seed: str, page_size: int) -> int:
    """By how many rows the first page of a seed is shorter, so that borders between pages move from round to round."""
    return int(hashlib.md5(f"{seed}/shift".encode()).hexdigest()[:8], 16) % page_size


def locality_pages(
    df: DataFrame, id_col: str, vec_col: str, page_size: int, seed: str = "0", out: str = "page"
) -> DataFrame:
    """Pages of ``page_size`` rows in the order of their locality keys, equal keys in hash order.

    The first page is shorter by the seed's shift.  Similar rows come into the
    same page far more often than in a random order; another seed turns the
    hyperplanes and moves the borders, so a group that one round cuts is whole
    in another.  Copies of one vector have one key and are cut by the hash.
    """
    keyed = df.where(F.col(vec_col).isNotNull()).withColumn("_key", locality_key(F.col(vec_col), seed))
    placed = ordered_index(keyed, [F.asc("_key"), shuffle_key(id_col, seed).asc(), F.asc(id_col)], "_rank", "locality")
    page = F.floor((F.col("_rank") + page_shift(seed, page_size)) / page_size).cast("int")
    return placed.withColumn(out, page).drop("_key", "_rank")
