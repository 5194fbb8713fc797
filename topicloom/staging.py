"""Cutting lineage through written tables, ordered numbering."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


STAGE_KEY = "spark.topicloom.stageDir"


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Spark refuses to set that key while it runs, so the folder a caller (or a
    local session without the setting) chooses is kept under ``STAGE_KEY``.
    Only a local session falls back to a fresh temporary folder; on a cluster
    a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(STAGE_KEY, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="topicloom-stage-")
    spark.conf.set(STAGE_KEY, folder)
    return folder


def stage_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/topicloom/{label}-{uuid.uuid4().hex}"
    for scope in _SCOPES.open.get():
        scope.append((spark, path))
    return path


class _Scopes:
    """Open scopes of this thread; a stream's micro-batches run in a thread of their own.  Travels to tasks empty."""

    def __init__(self):
        self.open: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("stage scopes", default=())

    def __reduce__(self):
        return _Scopes, ()


_SCOPES = _Scopes()


@contextmanager
def stage_scope():
    """Remove the tables that this thread stages inside once the block is left.

    The caller writes or collects the final result inside the block; a lazy
    result that leaves it would read removed tables.
    """
    mine: list[tuple[SparkSession, str]] = []
    token = _SCOPES.open.set((*_SCOPES.open.get(), mine))
    try:
        yield
    finally:
        _SCOPES.open.reset(token)
        for spark, path in mine:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged folder through the file system that Spark uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    A written Parquet table survives lost executors, keeps real size statistics
    for the join planner and still allows column pruning in later steps.
    """
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_files(df: DataFrame, label: str) -> str:
    """Folder of a written table, for readers that take files."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def ordered_index(df: DataFrame, order: list[Column], name: str, label: str = "ordered") -> DataFrame:
    """Add ``name`` = 0..N-1 in the given total order, without a one-task window.

    Rows are range partitioned and sorted; the position inside a partition plus
    the rows of the partitions before it is the global position.  The ranged
    rows are staged, because a second run of the range sampling could choose
    other borders.  The offset table has one row per partition.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranged = stage(ranged, label)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_part", "_local", "_offset")
    )
