"""Vector against vector work: one side goes to every task, whole when it is small, else part by part."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.staging import stage, stage_path

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 65536


@dataclass
class SmallSide:
    ids: np.ndarray
    rows: np.ndarray
    extra: pa.Table


def _allowed(df: DataFrame, vec_col: str, limit: int) -> int:
    """Rows of the dimension of a first row that the bytes allow."""
    first = df.select(F.size(vec_col).alias("dim")).first()
    return min(BROADCAST_ROWS, limit // (8 * max(1, first["dim"] if first else 1)))


def _side(table: pa.Table, id_col: str, vec_col: str, extra: tuple[str, ...]) -> SmallSide:
    ids = table.column(id_col).to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    table = table.take(pa.array(order))
    return SmallSide(ids[order], K.matrix(table.column(vec_col)), table.select(list(extra)))


def fetch_small(df: DataFrame, id_col: str, vec_col: str, *extra: str, limit: int = BROADCAST_BYTES) -> SmallSide | None:
    """The side as arrays in id order when it is small, else None.

    The number of rows that the bytes allow follows from the dimension of a first
    row, so no more than these, and one, leave the executors.
    """
    allowed = _allowed(df, vec_col, limit)
    table = df.select(id_col, vec_col, *extra).limit(allowed + 1).toArrow()
    return None if table.num_rows > allowed else _side(table, id_col, vec_col, extra)


def parts_of(df: DataFrame, id_col: str, vec_col: str, *extra: str, limit: int = BROADCAST_BYTES) -> Iterator[SmallSide]:
    """A large side in parts of about ``limit`` bytes, one after the other.

    Parts come from a hash of the unique ids, so no value can make one hot.  The
    side is written once by part; fetching a part reads that part alone.
    """
    side = stage(df.select(id_col, vec_col, *extra), "side")
    # Half of what the bytes allow, so that a part a little over the mean still fits.
    count = max(1, math.ceil(2 * side.count() / max(2, _allowed(side, vec_col, limit))))
    part = F.pmod(F.xxhash64(F.lit("part"), id_col), F.lit(count))
    path = stage_path(df.sparkSession, "parts")
    side.withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(path)
    written = df.sparkSession.read.parquet(path)
    for number in range(count):
        table = written.where(F.col("_part") == number).select(id_col, vec_col, *extra).toArrow()
        if table.num_rows:
            yield _side(table, id_col, vec_col, extra)


#: Bytes of the big side's rows, as doubles, that a task holds while the other side goes past them.
SHARE_BYTES = 32 * 1024 * 1024


def past(big: DataFrame, small: DataFrame, id_col: str, vec_col: str, task: Callable, schema: str) -> DataFrame:
    """``task`` over shares of ``big``, past each of which all rows of ``small`` go: one job, whatever the sizes.

    Both sides have the columns ``id_col`` and ``vec_col``.  ``task`` gets batches
    sorted by ``share`` and ``asks``: the rows of a share (0), then the small side (1).
    """
    spark = big.sparkSession
    big = stage(big.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), "scanned")
    first = big.select(F.size("vec").alias("dim")).first()
    held = max(1, SHARE_BYTES // (8 * max(1, first["dim"] if first else 1)))
    shares = max(1, -(-big.count() // held), 3 * spark.sparkContext.defaultParallelism)
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int")
    left = big.select(share.alias("share"), F.lit(0).alias("asks"), "id", "vec")
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    right = small.select(every.alias("share"), F.lit(1).alias("asks"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    both = left.unionByName(right).repartition(shares, "share").sortWithinPartitions("share", "asks")
    return both.mapInArrow(task, schema)


def against(
    big: DataFrame,
    small: DataFrame,
    id_col: str,
    vec_col: str,
    *extra: str,
    pack: Callable[[SmallSide], object],
    task: Callable[[object], Callable],
    schema: str,
    limit: int = BROADCAST_BYTES,
    narrow: Callable[[DataFrame, object], DataFrame] | None = None,
    derived: bool = False,
) -> tuple[DataFrame, bool]:
    """``big.mapInArrow(task(packed side))`` over the whole small side, in one pass or one per part.

    Returns the results and whether there were several parts.  The big side is scanned where it lies and never shuffled.  A side within
    ``limit`` makes one lazy pass.  A larger one is sent part by part; the
    narrow results of each pass are written, so at most one part is held in the
    driver and in a task.  A row of ``big`` then has results from each part.
    ``derived`` writes ``big`` before the passes, for one that is no plain table.
    """
    spark = big.sparkSession
    narrow = narrow or (lambda rows, packed: rows)
    side = fetch_small(small, id_col, vec_col, *extra, limit=limit)
    if side is not None:
        packed = pack(side)
        return narrow(big, packed).mapInArrow(task(spark.sparkContext.broadcast(packed)), schema), False
    big = stage(big, "scanned") if derived else big
    path = stage_path(spark, "passes")
    for side in parts_of(small, id_col, vec_col, *extra, limit=limit):
        packed = pack(side)
        shared = spark.sparkContext.broadcast(packed)
        narrow(big, packed).mapInArrow(task(shared), schema).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path), True
