"""The iterative clustering plan and its warm start."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as V
from topicloom.operators import clusters as C
from topicloom.operators import nearest as N
from topicloom.staging import stage


@dataclass(frozen=True)
class Settings:
    """``paging`` is ``balanced``, ``hash`` or ``locality``; ``nearest`` is ``scan`` or, for very many heads, ``pruned``."""

    threshold: float = 0.7
    min_size: int = 3
    page_size: int = 2500
    iterations: int = 15
    seed: str = "0"
    merge_page: int = V.MERGE_PAGE
    paging: str = "balanced"
    nearest: str = "scan"


def merge_heads(
    clusters: DataFrame,
    vectors: DataFrame,
    settings: Settings,
    seed: str,
    smallest: int = V.MERGE_KEEP,
    id_col: str = "id",
    vec_col: str = "vec",
) -> DataFrame:
    """Cluster the heads, take in their members, keep clusters of two or more.

    Every cluster must hold its own head.

    Repeats while there were at least ``merge_page`` heads and their number fell.
    The last result is cut to clusters of at least ``smallest`` members.
    """
    smallest = max(smallest, V.MERGE_KEEP)
    merged = clusters
    before = None
    turn = 0
    while True:
        turn += 1
        heads = C.heads_of(merged, id_col)
        count = heads.count()
        if count == 0 or count == before:
            return C.keep_large(merged, smallest)
        last = count < settings.merge_page
        merged = C.create_clusters(
            vectors.join(heads, id_col, "left_semi"), settings.threshold, 1, settings.merge_page, f"{seed}/m{turn}",
            old=merged, vectors=vectors, rows=count, id_col=id_col, vec_col=vec_col, paging=settings.paging,
        )
        merged = C.keep_large(stage(merged, "tight"), smallest if last else V.MERGE_KEEP)
        merged = stage(merged, "merged")
        if last:
            return merged
        before = count


def iterative_clusters(
    vectors: DataFrame,
    settings: Settings = Settings(),
    clusters: DataFrame | None = None,
    id_col: str = "id",
    vec_col: str = "vec",
) -> tuple[DataFrame, DataFrame]:
    """``(clusters, unclustered ids)`` after up to ``settings.iterations`` rounds.

    A round clusters what is left in random pages, merges the new heads, and
    gives left-over rows to their nearest head.  Rows that reached no old head
    before cannot reach one later, so after a round only its new heads are tried.
    The loop ends early when nothing is left, or when one page held everything
    left and brought no cluster: the next rounds would repeat that page.
    ``settings.paging="locality"`` finds small groups in a few rounds that random
    pages bring together only by chance.
    """
    assign = {"scan": C.assign_nearest, "pruned": N.assign_nearest_pruned}[settings.nearest]
    vectors = stage(vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col), "vectors")
    pieces = [C.no_clusters(vectors.sparkSession)]
    left = vectors

    def take_in(new: DataFrame, head_vectors: DataFrame) -> DataFrame:
        """Record new clusters, give left-over rows to their heads; returns what is still left."""
        rest = left.join(new.select(F.col("member_id").alias(id_col)), id_col, "left_anti")
        gained = stage(assign(rest, head_vectors, settings.threshold, id_col, vec_col), "gained")
        pieces.extend([new, gained])
        taken = new.unionByName(gained).select(F.col("member_id").alias(id_col))
        return stage(left.join(taken, id_col, "left_anti"), "left")

    if clusters is not None:
        given = stage(clusters.select(*C.CLUSTER_COLUMNS), "given")
        heads = given.select(F.col("head_id").alias(id_col)).distinct()
        left = C.unclustered(vectors, given, id_col)
        left = take_in(given, vectors.join(heads, id_col, "left_semi"))
    for turn in range(settings.iterations):
        left_count = left.count()
        if left_count == 0:
            break
        seed = f"{settings.seed}/{turn}"
        created = C.create_clusters(
            left, settings.threshold, settings.min_size, settings.page_size, seed,
            rows=left_count, id_col=id_col, vec_col=vec_col, paging=settings.paging,
        )
        # New clusters consist of left-over rows only, so no step below reads the other vectors.
        new = merge_heads(stage(created, "created"), left, settings, seed, settings.min_size, id_col, vec_col)
        if new.isEmpty():
            if left_count <= settings.page_size:
                break
            continue
        left = take_in(new, left.join(C.heads_of(new, id_col), id_col, "left_semi"))
    return reduce(DataFrame.unionByName, pieces), left.select(id_col)


def assign_incremental(
    vectors: DataFrame, clusters: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec"
) -> DataFrame:
    """Warm start without new clusters: old clusters plus newly reached rows."""
    left = C.unclustered(vectors, clusters, id_col)
    heads = clusters.select(F.col("head_id").alias(id_col)).distinct()
    gained = C.assign_nearest(left, vectors.join(heads, id_col, "left_semi"), threshold, id_col, vec_col)
    return clusters.select(*C.CLUSTER_COLUMNS).unionByName(gained)
