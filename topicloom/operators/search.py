"""Top-k vector search: exhaustive, or within the nearest cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.functions import vectors as X
from topicloom.functions.encoders import arrow_once
from topicloom.operators import blocks
from topicloom.operators.fetch import bucket_column, fetch_rows
from topicloom.staging import stage

METRICS = ("l2", "ip")
HITS_SCHEMA = "query_id bigint, doc_id bigint, score double"


def _ranked(hits: DataFrame, k: int, metric: str) -> DataFrame:
    """Rank partial hits per query; equal scores go by document id."""
    score = F.desc("score") if metric == "ip" else F.asc("score")
    order = Window.partitionBy("query_id").orderBy(score, F.asc("doc_id"))
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id", "score")
    )


def _check(metric: str, k: int) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if k < 1:
        raise ValueError("k must be at least 1")


def search_flat(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    id_col: str = "doc_id",
    vec_col: str = "vec",
    query_id: str = "query_id",
    query_vec: str = "vec",
    limit: int = blocks.BROADCAST_BYTES,
) -> DataFrame:
    """Top ``k`` vectors of every query: ``(query_id, rank, doc_id, score)``.

    The vector table is scanned once and never shuffled: each task keeps the best
    ``k`` per query of its rows, and only these meet in the final ranking.  A
    query batch beyond the size limit takes one scan per bounded part of it.
    """
    _check(metric, k)
    vectors = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("vec"))
    queries = queries.where(F.col(query_vec).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec")
    )

    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, query_rows = shared.value
            best = K.TopK(len(query_ids), k)
            for batch in batches:
                _add_all(best, query_rows, batch, metric)
            yield best.table(query_ids, metric)

        return run

    hits, _ = blocks.against(
        vectors, queries, "query_id", "vec", pack=lambda s: (s.ids, s.rows), task=task, schema=HITS_SCHEMA, limit=limit
    )
    return _ranked(hits, k, metric)


def _add_all(best: K.TopK, query_rows: np.ndarray, data: pa.RecordBatch | pa.Table, metric: str) -> None:
    if not data.num_rows or not len(query_rows):
        return
    ids = data.column("doc_id").to_numpy(zero_copy_only=False) if isinstance(data, pa.RecordBatch) else data.column("doc_id").to_numpy()
    rows = K.matrix(data.column("vec"))
    for block in K.row_blocks(len(query_rows), len(rows)):
        best.add(np.arange(block.start, block.stop), ids, K.distances(query_rows[block], rows, metric))


def train_cells(vectors: DataFrame, cells: int, vec_col: str = "vec", seed: int = 7, max_iter: int = 20) -> DataFrame:
    """K-means centroids of the vectors: ``(cell, centroid)``, at most ``cells`` rows."""
    data = vectors.where(F.col(vec_col).isNotNull()).select(array_to_vector(F.col(vec_col)).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter).fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def assign_cells(
    vectors: DataFrame, centroids: DataFrame, vec_col: str = "vec", out: str = "cell", keep: int = 1,
    id_col: str = "doc_id", limit: int = blocks.BROADCAST_BYTES,
) -> DataFrame:
    """Add the nearest cell (squared L2, ties to the lower cell), or an array of the ``keep`` nearest.

    Centroids beyond the limit are compared part by part; the best of the parts
    are then joined to the vectors by the unique ``id_col``.
    """
    vectors = vectors.where(F.col(vec_col).isNotNull())
    small = blocks.fetch_small(centroids, "cell", "centroid", limit=limit)
    if small is None:
        return _cells_by_parts(vectors, centroids, vec_col, out, keep, id_col, limit)
    shared = vectors.sparkSession.sparkContext.broadcast((small.ids, small.rows))

    def run(vecs: pa.Array) -> pa.Array:
        nearest, _ = _nearest_cells(K.matrix(vecs), *shared.value, keep)
        return pa.array(nearest[:, 0], pa.int32()) if keep == 1 else _lists(nearest, pa.int32())

    run.__annotations__ = {"vecs": pa.Array, "return": pa.Array}
    cell = arrow_once(run, "int" if keep == 1 else "array<int>")
    return vectors.withColumn(out, cell(F.col(vec_col)))


def _nearest_cells(rows: np.ndarray, cell_ids: np.ndarray, centers: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, keep)`` cells, nearest first, and their distances."""
    wanted = min(keep, len(cell_ids))
    nearest, far = np.empty((len(rows), wanted), np.int32), np.empty((len(rows), wanted))
    for block in K.row_blocks(len(rows), len(cell_ids)):
        away = np.round(K.distances(rows[block], centers, "l2"), X.ROUND)
        order = np.argsort(away, axis=1, kind="stable")[:, :wanted]
        nearest[block], far[block] = cell_ids[order], np.take_along_axis(away, order, axis=1)
    return nearest, far


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _cells_by_parts(vectors: DataFrame, centroids: DataFrame, vec_col: str, out: str, keep: int, id_col: str, limit: int) -> DataFrame:
    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells, far = _nearest_cells(K.matrix(batch.column("vec")), *shared.value, keep)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), _lists(far, pa.float64()), _lists(cells, pa.int32())], ["id", "far", "cells"]
                    )

        return run

    found, _ = blocks.against(
        vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), centroids, "cell", "centroid",
        pack=lambda s: (s.ids, s.rows), task=task, schema="id bigint, far array<double>, cells array<int>", limit=limit, derived=True,
    )
    # A row has keep entries from each part, so its list is bounded by the number of parts.
    pairs = F.flatten(F.collect_list(F.arrays_zip("far", "cells")))
    best = F.transform(F.slice(F.sort_array(pairs), 1, keep), lambda p: p["cells"])
    best = found.groupBy(F.col("id").alias(id_col)).agg(best.alias(out))
    if keep == 1:
        best = best.withColumn(out, F.col(out)[0])
    return vectors.join(best, id_col)


def save_index(vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Keep a vector table; one with cells is laid out by cell, so probes read few folders."""
    writer = vectors.write.mode(mode)
    if "cell" in vectors.columns:
        writer = writer.partitionBy("cell")
    writer.parquet(path)


def search_cells(
    vectors: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int,
    probes: int,
    id_col: str = "doc_id",
    vec_col: str = "vec",
    query_id: str = "query_id",
    query_vec: str = "vec",
    limit: int = blocks.BROADCAST_BYTES,
) -> DataFrame:
    """Top ``k`` by squared L2 among vectors whose ``cell`` is one of the query's nearest ``probes`` cells.

    The vectors stay where they are scanned, so a cell with a third of all rows
    is still worked on by many tasks.  Cells nobody probes are not read when the
    table is laid out by cell.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec"))
    asked = assign_cells(asked, centroids, out="cells", keep=max(2, probes), id_col="query_id", limit=limit)
    return search_probed(vectors, asked.withColumn("cells", F.slice("cells", 1, probes)), k, id_col, vec_col, limit)


def search_probed(
    vectors: DataFrame, asked: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "vec", limit: int = blocks.BROADCAST_BYTES
) -> DataFrame:
    """Top ``k`` by squared L2 among vectors whose ``cell`` is in the list ``cells`` of ``asked(query_id, vec, cells)``.

    The probed cells are a table that the vectors are joined with, so a layout
    by cell is pruned by its folders and the plan does not grow with their number.
    """
    _check("l2", k)
    vectors = vectors.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col("cell").cast("int").alias("cell"), F.col(vec_col).alias("vec")
    )

    def pack(side: blocks.SmallSide):
        by_cell: dict[int, list[int]] = {}
        for position, cells in enumerate(side.extra.column("cells").to_pylist()):
            for c in cells:
                by_cell.setdefault(c, []).append(position)
        return side.ids, side.rows, {c: np.array(p) for c, p in by_cell.items()}

    def narrow(rows: DataFrame, packed) -> DataFrame:
        probed = rows.sparkSession.createDataFrame([(c,) for c in sorted(packed[2])], "cell int")
        return rows.join(F.broadcast(probed), "cell", "left_semi").select("doc_id", "cell", "vec")

    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, query_rows, of_cell = shared.value
            best = K.TopK(len(query_ids), k)
            for batch in batches:
                _add_cells(best, query_rows, of_cell, batch)
            yield best.table(query_ids, "l2")

        return run

    hits, _ = blocks.against(
        vectors, asked, "query_id", "vec", "cells", pack=pack, task=task, schema=HITS_SCHEMA, limit=limit, narrow=narrow
    )
    return _ranked(hits, k, "l2")


def _add_cells(best: K.TopK, query_rows: np.ndarray, of_cell: dict, data: pa.RecordBatch | pa.Table) -> None:
    if not data.num_rows:
        return
    rows = K.matrix(data.column("vec"))
    ids = np.asarray(data.column("doc_id"))
    cells = np.asarray(data.column("cell"))
    for cell in np.unique(cells):
        slots = of_cell.get(int(cell))
        if slots is None:
            continue
        inside = np.flatnonzero(cells == cell)
        for block in K.row_blocks(len(slots), len(inside)):
            part = slots[block]
            best.add(part, ids[inside], K.distances(query_rows[part], rows[inside], "l2"))


def attach_documents(hits: DataFrame, docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Hits with the chosen columns of their documents.

    The hits are written first: their measured size lets Spark broadcast a small
    hit list and scan the documents in place, and shuffle both sides otherwise.
    Of documents kept by bucket only the buckets of the hits are read.
    """
    if bucket_column(docs) is not None:
        renamed = docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs
        found = fetch_rows(hits, renamed, [c for c in columns if c != id_col])
        return found.select("query_id", "rank", "doc_id", "score", *[c for c in columns if c != id_col])
    hits = stage(hits, "hits")
    wanted = docs.select(F.col(id_col).alias("doc_id"), *[c for c in columns if c != id_col])
    return hits.join(wanted, "doc_id").select("query_id", "rank", "doc_id", "score", *[c for c in columns if c != id_col])


def format_hits(hits: DataFrame, template: str, columns: list[str | Column], out: str = "line") -> DataFrame:
    """One readable line per hit."""
    return hits.withColumn(out, F.format_string(template, *columns))
