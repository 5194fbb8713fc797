"""One JSON array as one file, written by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.staging import drop_path, ordered_index, stage, stage_path

BUFFER = 1 << 20


def write_json_array(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> None:
    """Write ``columns`` (all of them by default) as objects of one JSON array in the file ``path``, sorted by the columns ``order``.

    Tasks write the lines of their range; the first line opens the array, the
    last one closes it, and all others end with a comma.  One file has one
    writer: the part files are then copied into it in their order through a
    buffer of ``BUFFER`` bytes; rows are never gathered.  ``path`` must not
    exist.  Null fields are written as nulls; a table without rows is ``[]``.
    ``order`` should be unique, else rows equal in it come in any order.
    """
    spark = df.sparkSession
    line = F.to_json(F.struct(*[f"`{c}`" for c in columns or df.columns]), {"ignoreNullFields": "false"}).alias("_line")
    keys = [f"_o{k}" for k in range(len(order))]
    rows = df.select(line, *[F.col(o).alias(k) for o, k in zip(order, keys)])
    placed = stage(ordered_index(rows, [F.col(k) for k in keys], "_at", "array"), "array")
    count = placed.count()
    opened = F.when(F.col("_at") == 0, F.lit("[")).otherwise(F.lit(""))
    closed = F.when(F.col("_at") == count - 1, F.lit("]")).otherwise(F.lit(","))
    parts = stage_path(spark, "array-parts")
    lines = placed.repartitionByRange("_at").sortWithinPartitions("_at").select(F.concat(opened, "_line", closed).alias("value"))
    (lines if count else spark.createDataFrame([("[]",)], "value string")).write.text(parts)
    _join_files(spark, parts, path)
    drop_path(spark, parts)


def _join_files(spark, folder: str, path: str) -> None:
    """The part files of ``folder`` in the order of their numbers as the one file ``path``."""
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, source = files.Path(path), files.Path(folder)
    system, source_system = target.getFileSystem(conf), source.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    parts = [s.getPath() for s in source_system.listStatus(source) if s.getPath().getName().startswith("part-")]
    out = system.create(target, False)
    try:
        for part in sorted(parts, key=lambda p: int(p.getName().split("-")[1])):
            read = source_system.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, BUFFER, False)
            finally:
                read.close()
    finally:
        out.close()
