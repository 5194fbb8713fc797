"""Operators on cluster tables ``(head_id, member_id, score)``.

A head is a member of its own cluster.  Sizes are always found by a grouped
count and joined back, because a window per head would put a cluster with a
third of all rows into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.functions.encoders import arrow_once
from topicloom.operators import blocks
from topicloom.operators.paging import balanced_pages, hash_pages, locality_pages, page_count
from topicloom.staging import ordered_index
from topicloom.staging import stage as stage_table

CLUSTER_COLUMNS = ("head_id", "member_id", "score")


def no_clusters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], K.CLUSTER_SCHEMA)


# ---------------------------------------------------------------- inside pages


def page_pairs(paged: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Pairs ``id_a < id_b`` of one page with cosine at or above the threshold.

    For inspection; clustering itself never writes pairs out.
    """

    def run(page: pa.Table) -> pa.Table:
        ids = page.column(id_col).to_numpy()
        units = K.unit_rows(K.matrix(page.column(vec_col)))
        number = page.column("page")[0].as_py()
        parts = list(K.similar_pairs(ids, units, threshold))
        left, right, score = (np.concatenate(p) for p in zip(*parts))
        return pa.table(
            {
                "page": pa.array(np.full(len(left), number), pa.int32()),
                "id_a": pa.array(left, pa.int64()),
                "id_b": pa.array(right, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return _by_page(paged, id_col, vec_col, run, "page int, id_a bigint, id_b bigint, score double")


def page_candidates(paged: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """How many rows of its page each row covers, and the sum of their scores: one row per input row."""

    def run(page: pa.Table) -> pa.Table:
        ids = page.column(id_col).to_numpy()
        units = K.unit_rows(K.matrix(page.column(vec_col)))
        sizes, totals = K.candidate_sizes(ids, units, threshold)
        number = page.column("page")[0].as_py()
        return pa.table(
            {
                "page": pa.array(np.full(len(ids), number), pa.int32()),
                "head_id": pa.array(ids, pa.int64()),
                "size": pa.array(sizes, pa.int64()),
                "total_score": pa.array(totals, pa.float64()),
            }
        )

    return _by_page(paged, id_col, vec_col, run, "page int, head_id bigint, size bigint, total_score double")


def greedy_clusters(
    paged: DataFrame, threshold: float, min_size: int, id_col: str = "id", vec_col: str = "vec", strict: bool = False
) -> DataFrame:
    """Greedy threshold clusters of every page; a page is bounded, so its work is too.

    ``strict`` applies the strict head filter and the size filter again at once:
    a cluster lies in one page, so both need no further shuffle.
    """

    def run(page: pa.Table) -> pa.Table:
        ids = page.column(id_col).to_numpy()
        units = K.unit_rows(K.matrix(page.column(vec_col)))
        heads, members, scores = K.greedy_page(ids, units, threshold, min_size, strict)
        return pa.table(
            {
                "head_id": pa.array(heads, pa.int64()),
                "member_id": pa.array(members, pa.int64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    return _by_page(paged, id_col, vec_col, run, K.CLUSTER_SCHEMA)


def _by_page(paged: DataFrame, id_col: str, vec_col: str, run, schema: str) -> DataFrame:
    def page(table: pa.Table) -> pa.Table:
        return run(table)

    page.__annotations__ = {"table": pa.Table, "return": pa.Table}
    rows = paged.where(F.col(vec_col).isNotNull()).select("page", id_col, vec_col)
    return rows.groupBy("page").applyInArrow(page, schema)


# ---------------------------------------------------------------- sizes and order


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("head_id").agg(F.count(F.lit(1)).alias("size"))


def keep_large(clusters: DataFrame, min_size: int) -> DataFrame:
    """Clusters with at least ``min_size`` members."""
    if min_size <= 1:
        return clusters
    large = cluster_sizes(clusters).where(F.col("size") >= min_size).select("head_id")
    return clusters.join(large, "head_id", "left_semi").select(*CLUSTER_COLUMNS)


def topic_numbers(clusters: DataFrame) -> DataFrame:
    """``(head_id, size, topic)``: 0 for the largest cluster, equal sizes by lower head."""
    numbered = ordered_index(cluster_sizes(clusters), [F.desc("size"), F.asc("head_id")], "topic", "topics")
    return numbered.select("head_id", "size", F.col("topic").cast("int").alias("topic"))


def best_per_member(clusters: DataFrame) -> DataFrame:
    """One row per head and member, the one with the highest score."""
    return clusters.groupBy("head_id", "member_id").agg(F.max("score").alias("score"))


def member_ranks(clusters: DataFrame) -> DataFrame:
    """``(head_id, rank, member_id, score)``: 1 for the best score of a cluster, ties to the lower member.

    Ranks are positions in an order over all rows minus that of the cluster's
    first row, so a cluster with a third of all rows spreads over many tasks.
    """
    placed = ordered_index(
        clusters.select(*CLUSTER_COLUMNS), [F.asc("head_id"), F.desc("score"), F.asc("member_id")], "_at", "ranked"
    )
    starts = placed.groupBy("head_id").agg(F.min("_at").alias("_start"))
    rank = (F.col("_at") - F.col("_start") + 1).alias("rank")
    return placed.join(starts, "head_id").select("head_id", rank, "member_id", "score")


def remove_overlap(clusters: DataFrame) -> DataFrame:
    """Each member stays in its largest cluster, equal sizes by lower head."""
    sized = clusters.join(cluster_sizes(clusters), "head_id")
    best = sized.groupBy("member_id").agg(
        F.min_by(F.struct("head_id", "score"), F.struct(-F.col("size"), F.col("head_id"))).alias("best")
    )
    return best.select("best.head_id", "member_id", "best.score")


def coverage(vectors: DataFrame, clusters: DataFrame, id_col: str = "id") -> DataFrame:
    """Clustered and all ids and the clustered share in percent, one row."""
    inside = clustered_ids(clusters).distinct().withColumn("_in", F.lit(1))
    counted = vectors.select(F.col(id_col).alias("member_id")).join(inside, "member_id", "left").agg(
        F.count("_in").alias("clustered"), F.count(F.lit(1)).alias("total")
    )
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col("clustered") * 100.0 / F.col("total"), 2))
    return counted.withColumn("percent", share)


# ---------------------------------------------------------------- membership


def clustered_ids(clusters: DataFrame) -> DataFrame:
    """Ids that are members or heads, possibly more than once; heads are reduced first."""
    heads = clusters.select(F.col("head_id").alias("member_id")).distinct()
    return clusters.select("member_id").union(heads)


def unclustered(vectors: DataFrame, clusters: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is neither member nor head."""
    taken = clustered_ids(clusters).select(F.col("member_id").alias(id_col))
    return vectors.join(taken, id_col, "left_anti")


def union_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both cluster tables; where a head is in both, the old cluster stays."""
    heads = old.select("head_id").distinct()
    return old.select(*CLUSTER_COLUMNS).unionByName(
        new.join(heads, "head_id", "left_anti").select(*CLUSTER_COLUMNS)
    )


def heads_of(clusters: DataFrame, id_col: str = "id") -> DataFrame:
    """Head ids of clusters that hold their own head, found without a shuffle."""
    return clusters.where("head_id = member_id").select(F.col("head_id").alias(id_col))


def expand_heads(grouped: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of heads turned into clusters of the heads' members, as two cluster tables.

    The first table has rows whose score against the new head is known: the
    heads themselves, and members of an old head that leads the new cluster.  The
    second has the members that moved to another head, with a null score.  An old
    cluster with a third of all rows is one key here; the small head table is
    broadcast, or the adaptive skew join splits that key.
    """
    direct = grouped.select(*CLUSTER_COLUMNS)
    lead = grouped.select(F.col("head_id").alias("_new"), F.col("member_id").alias("_old"))
    inner = old.where(F.col("member_id") != F.col("head_id")).select(
        F.col("head_id").alias("_old"), "member_id", "score"
    )
    reached = inner.join(lead, "_old")
    stayed = reached.where(F.col("_new") == F.col("_old")).select(F.col("_new").alias("head_id"), "member_id", "score")
    moved = reached.where(F.col("_new") != F.col("_old")).select(
        F.col("_new").alias("head_id"), "member_id", F.lit(None).cast("double").alias("score")
    )
    return direct.unionByName(stayed), moved


def refilter(
    clusters: DataFrame,
    vectors: DataFrame,
    threshold: float,
    id_col: str = "id",
    vec_col: str = "vec",
    head_vectors: DataFrame | None = None,
) -> DataFrame:
    """Members whose cosine to their head is strictly above the threshold, with that score.

    ``head_vectors`` may name a smaller table that holds all heads.
    """
    vectors = vectors.where(F.col(vec_col).isNotNull())
    own = vectors.select(F.col(id_col).alias("member_id"), F.col(vec_col).alias("_member_vec"))
    heads = (vectors if head_vectors is None else head_vectors.where(F.col(vec_col).isNotNull())).select(
        F.col(id_col).alias("head_id"), F.col(vec_col).alias("_head_vec")
    )
    if head_vectors is None:
        heads = heads.join(clusters.select("head_id").distinct(), "head_id", "left_semi")
    paired = clusters.select("head_id", "member_id").join(own, "member_id").join(heads, "head_id")
    scored = paired.withColumn("score", pair_cosine(F.col("_head_vec"), F.col("_member_vec")))
    return scored.where(F.col("score") > threshold).select(*CLUSTER_COLUMNS)


def pair_cosine(a: Column, b: Column) -> Column:
    """Rounded cosine of two vector columns, one Arrow batch at a time."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(K.row_cosines(K.matrix(left), K.matrix(right)), pa.float64())

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return arrow_once(run, "double")(a, b)


# ---------------------------------------------------------------- nearest head


def assign_nearest(
    vectors: DataFrame,
    heads: DataFrame,
    threshold: float,
    id_col: str = "id",
    vec_col: str = "vec",
    limit: int = blocks.BROADCAST_BYTES,
) -> DataFrame:
    """Nearest head of every vector when its cosine reaches the threshold: a cluster table.

    ``heads`` has the columns ``id_col`` and ``vec_col``.  A head side within
    ``limit`` bytes goes to every task and the vectors stay where they are; a
    larger one goes in batches past shares of the vectors, in one job, and each
    share keeps the best head met so far.
    """
    vectors = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vec_col).alias("vec"))
    heads = heads.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vec_col).alias("vec"))
    side = blocks.fetch_small(heads, "_id", "vec", limit=limit)
    if side is not None:
        shared = vectors.sparkSession.sparkContext.broadcast((side.ids, K.unit_rows(side.rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head_ids, head_units = shared.value
            for batch in batches:
                if batch.num_rows and len(head_ids):
                    yield from _nearest_table(batch, head_ids, head_units, threshold).to_batches()

        return vectors.withColumnRenamed("_id", "member_id").mapInArrow(run, K.CLUSTER_SCHEMA)
    found = blocks.past(vectors, heads, "_id", "vec", _nearest_of_shares(threshold), K.CLUSTER_SCHEMA)
    best = found.groupBy("member_id").agg(
        F.max_by(F.struct("head_id", "score"), F.struct(F.col("score"), -F.col("head_id"))).alias("best")
    )
    return best.select("best.head_id", "member_id", "best.score")


def _nearest_of_shares(threshold: float):
    """Streams rows sorted by share, its vectors first; only one share and a batch of heads are held."""

    def best_of(parts: list[pa.RecordBatch]):
        ids = pa.concat_arrays([p.column("id") for p in parts])
        units = np.concatenate([K.unit_rows(K.matrix(p.column("vec"))) for p in parts])
        return ids, units, np.full(len(ids), -1, np.int64), np.full(len(ids), -2.0)

    def improve(own, heads: pa.RecordBatch) -> None:
        _, units, head, score = own
        heads = heads.take(pa.array(np.argsort(heads.column("id").to_numpy(), kind="stable")))
        head_units = K.unit_rows(K.matrix(heads.column("vec")))
        # such a head has no cosine, and must not hide that of the others
        head_units[~np.isfinite(head_units).all(axis=1)] = 0
        ids, scores = K.nearest_rows(units, heads.column("id").to_numpy(), head_units)
        over = (scores > score) | ((scores == score) & (ids < head))
        head[over], score[over] = ids[over], scores[over]

    def result(own) -> pa.RecordBatch:
        ids, _, head, score = own
        near = score >= threshold
        return pa.RecordBatch.from_arrays([pa.array(head[near]), ids.filter(pa.array(near)), pa.array(score[near])], ["head_id", "member_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, parts, own = None, [], None
        for batch in batches:
            numbers, asks = np.asarray(batch.column("share")), np.asarray(batch.column("asks"))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks) != 0)) + 1, [len(numbers)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if numbers[a] != share:
                    if own is not None:
                        yield result(own)
                    share, parts, own = numbers[a], [], None
                piece = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append(piece)
                    continue
                if own is None and parts:
                    own, parts = best_of(parts), []
                if own is not None:
                    improve(own, piece)
        if own is not None:
            yield result(own)

    return run


def _nearest_table(data: pa.RecordBatch | pa.Table, head_ids, head_units, threshold: float) -> pa.Table:
    best, scores = K.nearest_rows(K.unit_rows(K.matrix(data.column("vec"))), head_ids, head_units)
    near = scores >= threshold
    return pa.table(
        {
            "head_id": pa.array(best[near], pa.int64()),
            "member_id": pa.array(np.asarray(data.column("member_id"))[near], pa.int64()),
            "score": pa.array(scores[near], pa.float64()),
        }
    )


# ---------------------------------------------------------------- create and stack


def create_clusters(
    subset: DataFrame,
    threshold: float,
    min_size: int,
    page_size: int,
    seed: str = "0",
    old: DataFrame | None = None,
    vectors: DataFrame | None = None,
    rows: int | None = None,
    id_col: str = "id",
    vec_col: str = "vec",
    paging: str = "balanced",
) -> DataFrame:
    """Page the subset, cluster every page, take in the members of old clusters, filter again.

    ``balanced`` pages differ in size by at most one row; ``hash`` pages only on
    average, and save one shuffle of the vectors.  ``locality`` pages hold rows
    that are near each other more often.

    With ``old`` the subset holds heads of ``old``, and ``vectors`` must hold the
    vectors of all its members.  Pages share no rows and clusters of ``old`` share
    none either, so the result has no overlap to remove.
    """
    rows = subset.count() if rows is None else rows
    if paging == "balanced":
        paged = balanced_pages(subset, id_col, page_size, seed, rows)
    elif paging == "hash":
        paged = hash_pages(subset, id_col, page_count(rows, page_size), seed)
    elif paging == "locality":
        paged = locality_pages(subset, id_col, vec_col, page_size, seed)
    else:
        raise ValueError(f"paging must be 'balanced', 'hash' or 'locality', not {paging!r}")
    # Pages are few bytes but much work; a given number of partitions is not coalesced.
    paged = paged.repartition(_page_tasks(subset.sparkSession, page_count(rows, page_size)), "page")
    if old is None:
        return greedy_clusters(paged, threshold, min_size, id_col, vec_col, strict=True)
    fresh = stage_table(greedy_clusters(paged, threshold, min_size, id_col, vec_col), "fresh")
    known, moved = expand_heads(fresh, old)
    # Only members under another head need their vectors again.
    kept = known.where(F.col("score") > threshold).unionByName(
        refilter(moved, vectors, threshold, id_col, vec_col, subset)
    )
    if min_size <= 1:
        return kept
    return keep_large(stage_table(kept, "kept"), min_size)


#: Pages a task solves one after the other at most, so that its input stays bounded.
PAGES_PER_TASK = 32


def _page_tasks(spark: SparkSession, pages: int) -> int:
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, pages // PAGES_PER_TASK)
    return max(1, min(pages, most))


def stack(
    docs: DataFrame, clusters: DataFrame, columns: list[str], id_col: str = "doc_id", topics: DataFrame | None = None
) -> DataFrame:
    """The chosen columns of all rows with their topic number, -1 for unclustered rows."""
    topics = topic_numbers(clusters) if topics is None else topics
    member_topic = clusters.join(topics.select("head_id", "topic"), "head_id").select(
        F.col("member_id").alias(id_col), "topic"
    )
    return docs.join(member_topic, id_col, "left").select(*columns, F.coalesce("topic", F.lit(-1)).alias("topic"))
