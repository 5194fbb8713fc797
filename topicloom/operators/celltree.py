"""Many cells: a tree of two levels whose centroids are trained on a bounded sample and descended by shuffles.

A flat list of cells is compared with every vector and sent to every task.
Here only the top centroids are; a vector then goes to the task that holds the
leaves of its top, so neither work nor memory grows with the number of cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.operators import blocks
from topicloom.operators import search as S
from topicloom.operators.search import _lists, _nearest_cells
from topicloom.staging import stage

#: Rows that train the top centroids, and the leaves of one top, at most.
TRAIN_ROWS = 65_536
#: Rows per cell that the leaves are trained on.
ROWS_PER_CELL = 64
STEPS = 10
#: Rows that go to the leaves of one top in one task; more are dealt to several.
ROWS_PER_SALT = 10_000


@dataclass(frozen=True)
class CellTree:
    """``tops(cell, centroid)`` and ``leaves(cell, top, centroid)`` as written tables."""

    tops: DataFrame
    leaves: DataFrame


def _hash_share(id_col: str, salt: str) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 31)) / F.lit(float(1 << 31))


def _centroids(cells_of: Callable[[pa.Table], int], steps: int):
    """Centroids of the rows of a group; the rows with the least key are the first ones."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("id", "ascending")])
        rows = K.matrix(group.column("vec"))
        found = K.lloyd(rows, cells_of(group), steps)
        top = group.column("top")[0].as_py()
        return pa.table({"top": pa.array([top] * len(found), pa.int32()), "at": pa.array(range(len(found)), pa.int32()), "centroid": found.tolist()})

    run.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return run


_TRAINED = "top int, at int, centroid array<double>"


def train_cell_tree(
    vectors: DataFrame, cells: int, id_col: str = "doc_id", vec_col: str = "vec", tops: int | None = None, steps: int = STEPS
) -> CellTree:
    """A tree of about ``cells`` leaves under about ``tops`` (their root) top centroids.

    Trained on rows chosen by the hash of their id: at most ``TRAIN_ROWS`` for
    the tops; for the leaves about ``ROWS_PER_CELL`` a cell, of one top at most
    ``TRAIN_ROWS``.  A top gets leaves by its share of the sample, each top in
    a task of its own.  Every vector is assigned later, whatever the sample.
    """
    if cells < 1:
        raise ValueError("there must be a cell at least")
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    count = rows.count()
    tops = tops or max(1, math.ceil(math.sqrt(cells)))
    wanted = min(1.0, TRAIN_ROWS / max(1, count))
    first = rows.withColumn("key", _hash_share("id", "top")).where(F.col("key") < wanted).withColumn("top", F.lit(0))
    # the hash share is right on average only; a bound on the rows is kept by the limit
    first = first.orderBy("key", "id").limit(TRAIN_ROWS)
    trained = first.groupBy("top").applyInArrow(_centroids(lambda group: tops, steps), _TRAINED)
    top_rows = stage(trained.select(F.col("at").alias("cell"), "centroid"), "tops")
    wanted = min(1.0, ROWS_PER_CELL * cells / max(1, count))
    sample = rows.withColumn("key", _hash_share("id", "leaf")).where(F.col("key") < wanted)
    sample = stage(S.assign_cells(sample, top_rows, out="top", id_col="id"), "leaf-sample")
    sizes = sample.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS)) / F.col("n")) * wanted
    asked = F.greatest(F.lit(1), F.round(F.lit(float(cells)) * F.col("n") / F.lit(max(1, sample.count()))).cast("int"))
    bounded = sample.join(F.broadcast(sizes), "top").where(F.col("key") < share).withColumn("cells", asked)
    leaves = bounded.groupBy("top").applyInArrow(_centroids(lambda group: group.column("cells")[0].as_py(), steps), _TRAINED)
    leaves = stage(leaves, "leaves")
    # a top without a row in the sample is its own leaf
    bare = top_rows.select(F.col("cell").alias("top"), F.lit(0).alias("at"), "centroid").join(leaves.select("top").distinct(), "top", "left_anti")
    leaves = leaves.unionByName(bare)
    # cells are numbered top by top; there is one row per top in the window
    before = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    offsets = leaves.groupBy("top").agg(F.count(F.lit(1)).alias("n")).select("top", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = leaves.join(F.broadcast(offsets), "top").select((F.col("offset") + F.col("at")).cast("int").alias("cell"), "top", "centroid")
    return CellTree(top_rows, stage(numbered, "leaves"))


def _descending(keep: int):
    """Streams rows sorted by top, leaves first: the ``keep`` nearest leaves of each asking row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, parts, own = None, [], None
        for batch in batches:
            tops, asks = np.asarray(batch.column("top")), np.asarray(batch.column("asks"))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(tops) != 0) | (np.diff(asks) != 0)) + 1, [len(tops)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if tops[a] != top:
                    top, parts, own = tops[a], [], None
                rows = K.matrix(piece.column("vec"))
                if not asks[a]:
                    if own is None:
                        parts.append((np.asarray(piece.column("id")), rows))
                    continue
                if own is None:
                    ids = np.concatenate([p[0] for p in parts])
                    order = np.argsort(ids, kind="stable")
                    own = ids[order], np.concatenate([p[1] for p in parts])[order]
                    parts = []
                cells, far = _nearest_cells(rows, *own, keep)
                yield pa.RecordBatch.from_arrays([piece.column("id"), _lists(far, pa.float64()), _lists(cells, pa.int32())], ["id", "far", "cells"])

    return run


def _to_leaves(asks: DataFrame, leaves: DataFrame, keep: int) -> DataFrame:
    """``(id, far, cells)`` of rows ``(id, vec, top)``; a top that many rows ask for is held by several tasks."""
    counted = asks.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
    salts = stage(counted.select("top", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts")), "tops-asked")
    salted = asks.join(F.broadcast(salts.where("salts > 1")), "top", "left")
    left = salted.select("top", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("asks"), "id", F.col("vec").cast("array<double>").alias("vec"))
    held = leaves.join(F.broadcast(salts), "top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = held.select("top", "salt", F.lit(0).alias("asks"), F.col("cell").cast("long").alias("id"), F.col("centroid").alias("vec"))
    spark = asks.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    both = right.unionByName(left).repartition(tasks, "top", "salt").sortWithinPartitions("top", "salt", "asks", "id")
    return both.mapInArrow(_descending(keep), "id long, far array<double>, cells array<int>")


def tree_cells(vectors: DataFrame, tree: CellTree, keep: int = 1, tops: int = 1, id_col: str = "doc_id", vec_col: str = "vec", limit: int = blocks.BROADCAST_BYTES) -> DataFrame:
    """``(id_col, cells)``: the ``keep`` nearest leaves under the ``tops`` nearest tops of every vector, nearest first.

    ``id_col`` must be unique.  Equal distances go to the lower cell.
    """
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    # written once, since the rows are counted by top before they are dealt out
    near = stage(S.assign_cells(rows, tree.tops, out="tops", keep=max(2, tops), id_col="id", limit=limit), "topped")
    asks = near.select("id", "vec", F.explode(F.slice("tops", 1, tops)).alias("top"))
    found = _to_leaves(asks, tree.leaves, keep)
    if tops > 1:
        # a row has keep entries from each of its tops
        pairs = F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("far", "cells")))), 1, keep)
        found = found.groupBy("id").agg(F.transform(pairs, lambda p: p["cells"]).alias("cells"))
    return found.select(F.col("id").alias(id_col), "cells")


def assign_tree_cells(vectors: DataFrame, tree: CellTree, id_col: str = "doc_id", vec_col: str = "vec", tops: int = 1) -> DataFrame:
    """``vectors`` with the nearest leaf as ``cell``."""
    cells = tree_cells(vectors, tree, 1, tops, id_col, vec_col).select(id_col, F.col("cells")[0].alias("cell"))
    return vectors.where(F.col(vec_col).isNotNull()).join(cells, id_col)


def search_tree(
    vectors: DataFrame, tree: CellTree, queries: DataFrame, k: int, probes: int, tops: int = 4,
    id_col: str = "doc_id", vec_col: str = "vec", query_id: str = "query_id", query_vec: str = "vec", limit: int = blocks.BROADCAST_BYTES,
) -> DataFrame:
    """Top ``k`` by squared L2 within the ``probes`` cells that a query reaches through its ``tops`` nearest tops.

    ``vectors`` has the column ``cell`` of ``assign_tree_cells``.
    """
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec"))
    cells = tree_cells(asked, tree, probes, tops, "query_id", "vec", limit)
    return S.search_probed(vectors, asked.join(cells, "query_id"), k, id_col, vec_col, limit)


def recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(wanted, found, recall)``: how many rows of the exact hits are among ``hits``."""
    inside = hits.select("query_id", "doc_id", F.lit(1).alias("_in"))
    counted = exact.join(inside, ["query_id", "doc_id"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("_in").alias("found"))
    return counted.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(F.lit(1.0)))

