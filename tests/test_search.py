import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import random_vectors, vector_table
from topicloom.operators import blocks
from topicloom.operators import search as S


def brute(docs, doc_ids, asked, k, metric):
    values = -(asked @ docs.T) if metric == "ip" else ((asked[:, None, :] - docs[None]) ** 2).sum(axis=2)
    values = np.round(values, 6)
    out = {}
    for q in range(len(asked)):
        best = sorted(zip(values[q], doc_ids))[:k]
        out[q] = [d for _, d in best]
    return out


def by_query(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


@pytest.fixture(scope="module")
def data(spark):
    docs = random_vectors(11, 240, 6).astype(np.float32)
    docs[100:180] = docs[3]  # a third of all rows are copies
    asked = random_vectors(12, 7, 6).astype(np.float32)
    asked[0] = docs[3]
    ids = np.random.default_rng(1).permutation(5000)[:240]
    return docs, ids, asked


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_flat_search_equals_brute_force(spark, data, metric, monkeypatch):
    docs, ids, asked = data
    vectors = vector_table(spark, ids, docs, "doc_id").repartition(5)
    queries = vector_table(spark, range(len(asked)), asked, "query_id")
    want = brute(docs.astype(float), ids.tolist(), asked.astype(float), 6, metric)
    assert by_query(S.search_flat(vectors, queries, 6, metric)) == want
    assert by_query(S.search_flat(vectors, queries, 6, metric, limit=150)) == want


def test_cells_with_all_probes_equal_flat(spark, data):
    docs, ids, asked = data
    vectors = vector_table(spark, ids, docs, "doc_id")
    queries = vector_table(spark, range(len(asked)), asked, "query_id")
    centroids = S.train_cells(vectors, 6)
    celled = S.assign_cells(vectors, centroids)
    flat = by_query(S.search_flat(vectors, queries, 4))
    assert by_query(S.search_cells(celled, centroids, queries, 4, 6)) == flat
    assert by_query(S.search_cells(celled, centroids, queries, 4, 6, limit=150)) == flat


@pytest.mark.parametrize("probes", [1, 2])
def test_probed_cells_equal_brute_force(spark, data, probes):
    docs, ids, asked = data
    vectors = vector_table(spark, ids, docs, "doc_id")
    queries = vector_table(spark, range(len(asked)), asked, "query_id")
    centers = docs[[0, 40, 90, 200]].astype(float)
    centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>")
    home = np.argmin(np.round(((docs[:, None].astype(float) - centers[None]) ** 2).sum(2), 6), axis=1)
    celled = S.assign_cells(vectors, centroids)
    got = by_query(S.search_cells(celled, centroids, queries, 5, probes))
    for q, vec in enumerate(asked.astype(float)):
        near = np.argsort(np.round(((vec - centers) ** 2).sum(1), 6), kind="stable")[:probes]
        inside = np.isin(home, near)
        want = brute(docs[inside].astype(float), ids[inside].tolist(), vec[None], 5, "l2")[0]
        assert got.get(q, []) == want


def test_index_by_cell_prunes_folders(spark, data, tmp_path):
    docs, ids, asked = data
    vectors = vector_table(spark, ids, docs, "doc_id")
    centroids = S.train_cells(vectors, 5)
    S.save_index(S.assign_cells(vectors, centroids), str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    queries = vector_table(spark, [0], asked[:1], "query_id")
    hits = S.search_cells(stored, centroids, queries, 3, 1)
    assert hits.count() == 3
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_rank_follows_relevance_and_short_tables_give_fewer_hits(spark):
    vectors = vector_table(spark, [3, 7, 9], [[2.0, 0.0], [1.0, 0.0], [3.0, 0.0]], "doc_id")
    queries = vector_table(spark, [1], [[0.0, 0.0]], "query_id")
    rows = S.search_flat(vectors, queries, 5).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"], r["score"]) for r in rows] == [(1, 7, 1.0), (2, 3, 4.0), (3, 9, 9.0)]


def test_bad_arguments_and_empty_sides(spark):
    vectors = vector_table(spark, [1], [[1.0]], "doc_id")
    none = vector_table(spark, [], [], "query_id")
    with pytest.raises(ValueError):
        S.search_flat(vectors, none, 3, "cosine")
    with pytest.raises(ValueError):
        S.search_flat(vectors, none, 0)
    assert S.search_flat(vectors, none, 3).count() == 0
    queries = vector_table(spark, [1], [[1.0]], "query_id")
    assert S.search_flat(vectors.limit(0), queries, 3).count() == 0
    assert S.search_flat(vectors.select("doc_id", F.lit(None).cast("array<float>").alias("vec")), queries, 3).count() == 0


def test_hits_carry_document_columns(spark):
    docs = spark.createDataFrame([(1, "t1", 5), (2, "t2", 6)], "doc_id bigint, title string, topic int")
    hits = spark.createDataFrame([(0, 1, 2, 0.5)], "query_id bigint, rank int, doc_id bigint, score double")
    out = S.attach_documents(hits, docs, ["title", "topic"])
    assert tuple(out.first()) == (0, 1, 2, 0.5, "t2", 6)
    assert S.format_hits(out, "%d %s", ["rank", "title"]).first()["line"] == "1 t2"


def test_one_scan_stage_without_vector_shuffle(spark, data):
    docs, ids, asked = data
    vectors = vector_table(spark, ids, docs, "doc_id")
    queries = vector_table(spark, range(len(asked)), asked, "query_id")
    plan = S.search_flat(vectors, queries, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
