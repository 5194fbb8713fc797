"""The ordered vector fold as an aggregate over rows, however the rows are spread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.staging import stage

_PIECE = "key long, first long, size long, start array<double>, added array<double>"


def _pieces(share: float):
    """One row per run of a key in a task: its length, its first vector, and what the run adds.

    Taking in a vector maps a running value ``x`` to ``share * x + (1 - share) * v``;
    a run of ``n`` maps it to ``share ** n * x + added``.  Runs are folded in pieces of
    a batch, which are put together in the same way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, places, rows = np.asarray(batch.column("key")), np.asarray(batch.column("place")), K.matrix(batch.column("vec"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            sizes = np.diff(np.append(cuts, len(keys)))
            back = np.repeat(cuts + sizes, sizes) - 1 - np.arange(len(keys))
            added = np.add.reduceat(rows * ((1 - share) * share**back.astype(np.float64))[:, None], cuts, axis=0)
            done = []
            for k, (at, size) in enumerate(zip(cuts.tolist(), sizes.tolist())):
                if open_run is not None and open_run[0] == keys[at]:
                    open_run[4] = share**size * open_run[4] + added[k]
                    open_run[2] += size
                    continue
                if open_run is not None:
                    done.append(open_run)
                open_run = [keys[at], places[at], size, rows[at], added[k]]
            if done:
                yield _packed(done)
        if open_run is not None:
            yield _packed([open_run])

    return run


def _packed(runs: list) -> pa.RecordBatch:
    keys, firsts, sizes, starts, added = zip(*runs)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(keys), pa.int64()), pa.array(np.array(firsts), pa.int64()), pa.array(np.array(sizes), pa.int64()), pa.array(list(starts)), pa.array(list(added))],
        ["key", "first", "size", "start", "added"],
    )


def _joined(share: float):
    """Runs of a key in their order put together; a key's first vector is its starting value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, None
        for batch in batches:
            out = []
            columns = [np.asarray(batch.column("key")), np.asarray(batch.column("size")), K.matrix(batch.column("start")), K.matrix(batch.column("added"))]
            for own, size, start, added in zip(*columns):
                if own != key:
                    if key is not None:
                        out.append((key, value))
                    key, value = own, start
                value = share ** int(size) * value + added
            if out:
                yield finished(out)
        if key is not None:
            yield finished([(key, value)])

    def finished(out):
        rows = np.stack([v for _, v in out])
        return pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in out]), pa.int64()), K.vector_array(rows)], ["key", "vec"])

    return run


def fold_ordered(rows: DataFrame, key_col: str, order_col: str, vec_col: str = "vec", share: float = 0.5, out: str = "vec") -> DataFrame:
    """``(key_col, out)``: the vectors of each key folded from first to last, ``share * sum so far + (1 - share) * next``.

    The gate's step is affine, and affine maps can be put together in any
    grouping as long as their order is kept.  Rows are range partitioned by key
    and order, so a key with a third of all rows is folded by many tasks; each
    gives one small row per key, and these meet in order.  Orders are unique
    within a key.  Rows with a null key, order or vector are left out.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be from 0 to 1")
    plain = rows.where(F.col(key_col).isNotNull() & F.col(order_col).isNotNull() & F.col(vec_col).isNotNull())
    plain = plain.select(F.col(key_col).cast("long").alias("key"), F.col(order_col).cast("long").alias("place"), F.col(vec_col).alias("vec"))
    pieces = plain.repartitionByRange("key", "place").sortWithinPartitions("key", "place").mapInArrow(_pieces(share), _PIECE)
    # written, since a second run of the range sampling could choose other borders
    pieces = stage(pieces, "runs")
    joined = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_joined(share), "key long, vec array<float>")
    return joined.select(F.col("key").alias(key_col), F.col("vec").alias(out))
