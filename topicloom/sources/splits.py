"""CSV whose quoted fields hold line ends, read by many tasks per file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from topicloom.functions import fixed_values as V
from topicloom.sources.files import _typed, csv_header
from topicloom.staging import stage

#: Splits whose start states may be sent to every task; more are joined by a shuffle.
SENT_SPLITS = 200_000
WHOLE, OPEN, INNER = 0, 1, 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """``(file, start, from, to)`` of neighbouring lines of one split."""
    files, starts = batch.column("file").dictionary_encode(), np.asarray(batch.column("start"))
    codes = np.asarray(files.indices)
    cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield files.dictionary[int(codes[a])].as_py(), int(starts[a]), a, b


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quote characters of each split."""
    counts: dict[tuple[str, int], int] = {}
    for batch in batches:
        if batch.num_rows:
            each = np.asarray(pc.count_substring(batch.column("value"), '"'), np.int64)
            for file, start, a, b in _runs(batch):
                counts[file, start] = counts.get((file, start), 0) + int(each[a:b].sum())
    if counts:
        files, starts = zip(*counts)
        yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(starts, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["file", "start", "quotes"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces of records that begin or end in another split.

    A line end outside of quotes ends a record.  The number of quotes before a
    split tells whether it starts inside of them.
    """
    key, inside, held, part, at = None, False, [], WHOLE, 0

    def closed() -> list[tuple]:
        return [(*key, at, OPEN if part == WHOLE else INNER, "\n".join(held))] if held else []

    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[tuple] = []
        odd = np.asarray(pc.count_substring(batch.column("value"), '"'), np.int64) % 2
        lines, states = batch.column("value").to_pylist(), np.asarray(batch.column("before"))
        for file, start, a, b in _runs(batch):
            if key != (file, start):
                if key is not None:
                    out += closed()
                key, inside, held, at = (file, start), bool(states[a] % 2), [], 0
                part = INNER if inside else WHOLE
            for k in range(a, b):
                held.append(lines[k])
                inside ^= bool(odd[k])
                if not inside:
                    out.append((*key, at, part, "\n".join(held)))
                    held, part, at = [], WHOLE, at + 1
        if out:
            yield _packed(out)
    if key is not None and (out := closed()):
        yield _packed(out)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "start", "at", "part", "record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, at, record)``: the records of CSV files as texts, each file read in splits.

    Three passes over small things only: the quotes of each split are counted,
    their sums before each split give its state, and the pieces of the records
    that cross a border between splits are put together, at most two a split
    and those of fields longer than a split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    counted = stage(lines.mapInArrow(_quotes, "file string, start long, quotes long"), "quotes")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = stage(counted.select("file", "start", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("before")), "states")
    torn = counted.groupBy("file").agg(F.sum("quotes").alias("n")).where("n % 2 = 1").first()
    if torn is not None:
        raise ValueError(f"a quote is not closed in {torn['file']}")
    if states.count() <= SENT_SPLITS:
        known = lines.join(F.broadcast(states), ["file", "start"])
    else:
        numbered = lines.withColumn("_line", F.monotonically_increasing_id())
        known = numbered.join(states, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "_line")
    found = known.select("file", "start", "value", "before").mapInArrow(_records, "file string, start long, at long, part int, record string")
    found = stage(found, "records")
    order = Window.partitionBy("file").orderBy("start", "at")
    # a record that crosses a border is an open piece and all inner ones up to the next open piece
    pieces = found.where(F.col("part") != WHOLE).withColumn("_of", F.sum((F.col("part") == OPEN).cast("int")).over(order))
    joined = pieces.groupBy("file", "_of").agg(
        F.min(F.struct("start", "at")).alias("_first"), F.sort_array(F.collect_list(F.struct("start", "at", "record"))).alias("_all")
    )
    joined = joined.select("file", "_first.start", "_first.at", F.array_join(F.transform("_all", lambda p: p["record"]), "\n").alias("record"))
    return found.where(F.col("part") == WHOLE).select("file", "start", "at", "record").unionByName(joined)


def read_csv_splits(spark: SparkSession, path: str, schema: str, nulls: Sequence[str] = V.CSV_NULLS, mode: str = "fail") -> DataFrame:
    """What ``read_csv`` reads, but a file whose fields hold line ends is read by as many tasks as it has splits.

    Quotes may stand only around fields, and doubled inside of them, which the
    CSV sink writes; a file in which they do not pair up raises.  Lines end in
    a line feed, with or without a carriage return.
    """
    if mode not in ("fail", "null"):
        raise ValueError(f"mode must be fail or null, not {mode!r}")
    wanted = spark.createDataFrame([], schema).schema
    names = csv_header(spark, path, wanted)
    records = csv_records(spark, path).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    first = (F.col("start") == 0) & (F.col("at") == 0)
    if len(records.where(first).select("record").distinct().limit(2).collect()) > 1:
        raise ValueError("the files have different headers")
    texts = S.StructType([S.StructField(n, S.StringType()) for n in names])
    options = {"escape": '"', "mode": "FAILFAST" if mode == "fail" else "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = records.where(~first & (F.col("record") != "")).select(F.from_csv("record", texts.simpleString(), options).alias("r")).select("r.*")
    return rows.select(*[_typed(f, nulls, mode).alias(f.name) for f in wanted])
