"""From a document table to ranked hits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as V
from topicloom.functions.encoders import Encoder, encode
from topicloom.operators import clusters as C
from topicloom.operators import docvectors as D
from topicloom.operators import keywords as W
from topicloom.operators import search as S
from topicloom.operators.fetch import save_buckets
from topicloom.plans.clustering import Settings, iterative_clusters
from topicloom.staging import stage, stage_path


@dataclass(frozen=True)
class Built:
    """Stage tables: documents with topic and keywords, their final vectors, the clusters."""

    docs: DataFrame
    vectors: DataFrame
    clusters: DataFrame


def build(
    docs: DataFrame,
    encoder: Encoder,
    text_col: str,
    columns: list[str],
    settings: Settings = Settings(),
    n_keywords: int = 10,
    stopwords: Sequence[str] = (),
    split: bool = True,
    blend: bool = True,
    gate: D.Gate = D.Gate(),
    weight: float = V.BLEND_WEIGHT,
    id_col: str = "doc_id",
) -> Built:
    """Encode, cluster, stack, find keywords and build the final vectors."""
    vectors = stage(encode(docs, encoder, text_col).select(F.col(id_col).alias("id"), "vec"), "docvecs")
    clusters, _ = iterative_clusters(vectors, settings)
    stacked = stage(C.stack(docs, stage(clusters, "final"), columns, id_col), "stacked")
    keywords = stage(
        W.topic_keywords(stacked, text_col, n_keywords, "topic", stopwords).select(
            "topic", F.array_join("keywords", ", ").alias("keywords")
        ),
        "keywords",
    )
    final = D.build_vectors(stacked, encoder, text_col, keywords, split, blend, gate, weight)
    final = stage(final.select(id_col, "vec"), "finalvecs")
    return Built(stacked.join(keywords, "topic", "left"), final, clusters)


def search(
    built: Built, queries: DataFrame, encoder: Encoder, k: int, columns: list[str], metric: str = "l2",
    id_col: str = "doc_id", query_text: str = "text", centroids: DataFrame | None = None, probes: int = 1,
) -> DataFrame:
    """Top ``k`` documents of every query text with the chosen document columns.

    With ``centroids`` only the ``probes`` nearest cells of a query are searched;
    the vectors of ``built`` must carry their cells (see ``with_cells``).
    Queries are encoded once and written, since a search reads them several times.
    """
    asked = stage(encode(queries, encoder, query_text).select("query_id", "vec"), "asked")
    if centroids is None:
        hits = S.search_flat(built.vectors, asked, k, metric, id_col)
    elif metric != "l2":
        raise ValueError("cells are searched by 'l2' only")
    else:
        hits = S.search_cells(built.vectors, centroids, asked, k, probes, id_col)
    return S.attach_documents(hits, built.docs, columns, id_col)


def with_cells(built: Built, centroids: DataFrame, id_col: str = "doc_id") -> Built:
    """``built`` with the nearest cell of every vector, written once by cell."""
    path = index_path(centroids.sparkSession)
    S.save_index(S.assign_cells(built.vectors, centroids, id_col=id_col), path)
    return replace(built, vectors=centroids.sparkSession.read.parquet(path))


def save(built: Built, folder: str, mode: str = "errorifexists", id_col: str = "doc_id") -> None:
    """Keep the stage tables, so that a later session can search without clustering again.

    Vectors with cells lie by cell, documents by bucket of their id, so that a
    search reads the cells it probes and the buckets of its hits.
    """
    for name in ("vectors", "clusters"):
        S.save_index(getattr(built, name), f"{folder.rstrip('/')}/{name}", mode)
    save_buckets(built.docs, f"{folder.rstrip('/')}/docs", id_col, mode=mode)


def load(spark: SparkSession, folder: str) -> Built:
    return Built(*[spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in ("docs", "vectors", "clusters")])


def index_path(spark: SparkSession) -> str:
    return stage_path(spark, "index")
