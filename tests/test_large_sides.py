"""Nearest heads through blocks and bounds, and cells of a trained tree, against exhaustive ways."""

import math

import numpy as np
import pytest
from conftest import random_vectors, vector_table
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.operators import celltree
from topicloom.operators import clusters as C
from topicloom.operators import nearest as N
from topicloom.operators import search as S


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.97])
def test_pruned_assignment_equals_the_exhaustive_one(spark, threshold):
    vectors = vector_table(spark, range(1200), random_vectors(3, 1200, 12, groups=40))
    heads = vectors.where("id % 3 = 0")
    want = rows(C.assign_nearest(vectors, heads, threshold))
    found = N.nearest_heads(vectors, heads, threshold, spread=math.inf)
    assert found.count() == 1200
    assert rows(found.where("head_id IS NOT NULL").select(*C.CLUSTER_COLUMNS)) == want
    work = found.agg(F.sum("compared"), F.sum("met")).first()
    assert work[0] <= work[1] <= 1200 * 400
    if threshold > 0.9:
        assert work[0] < 1200 * 400 / 10
    # too little is left out: the heads go part by part
    assert rows(N.assign_nearest_pruned(vectors, heads, threshold, spread=0)) == want


def test_blocks_cut_by_size_and_copies(spark, monkeypatch):
    """Many equal heads and vectors: blocks in pieces, several tasks per block, ties to the lower head."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "ROWS_PER_SALT", 50)
    monkeypatch.setattr(N, "MAX_CENTRES", 20)
    monkeypatch.setattr(celltree, "ROWS_PER_SALT", 30)
    monkeypatch.setattr(celltree, "TRAIN_ROWS", 64)
    base = random_vectors(5, 300, 6, groups=9)
    values = np.concatenate([base, np.repeat(base[7:8], 200, axis=0), np.zeros((3, 6), np.float32)])
    vectors = vector_table(spark, range(len(values)), values)
    heads = vectors.where("id % 2 = 1")
    want = rows(C.assign_nearest(vectors, heads, 0.9))
    assert rows(N.assign_nearest_pruned(vectors, heads, 0.9, spread=math.inf)) == want


def test_pruned_assignment_of_odd_tables(spark):
    vectors = vector_table(spark, range(5), random_vectors(1, 5, 4))
    none = vectors.limit(0)
    nulls = vectors.select("id", F.when(F.col("id") != 2, F.col("vec")).alias("vec"))
    assert rows(N.assign_nearest_pruned(none, vectors, 0.5, spread=math.inf)) == []
    assert rows(N.assign_nearest_pruned(vectors, none, 0.5)) == []
    assert N.nearest_heads(vectors, none, 0.5).count() == 5
    assert rows(N.assign_nearest_pruned(nulls, nulls, 0.99, spread=math.inf)) == rows(C.assign_nearest(nulls, nulls, 0.99))
    doubles = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    assert rows(N.assign_nearest_pruned(doubles, vectors, 0.5, spread=math.inf)) == rows(C.assign_nearest(doubles, vectors, 0.5))
    with pytest.raises(ValueError):
        N.nearest_heads(vectors, vectors, 0.0)


def test_bounds_are_never_under_the_cosine(spark):
    values = random_vectors(9, 400, 10, groups=7)
    heads = vector_table(spark, range(400), values).withColumnRenamed("id", "head_id")
    laid, bounds = N.head_blocks(heads)
    units = K.unit_rows(random_vectors(2, 150, 10, groups=7).astype(float))
    _, bound = bounds.of(units)
    assert laid.count() == bounds.size.sum() == 400
    for row in laid.groupBy("block").agg(F.collect_list("vec").alias("vecs")).collect():
        best = (units @ K.unit_rows(np.array(row["vecs"], float)).T).max(axis=1)
        assert (bound[:, row["block"]] >= best - 1e-9).all()


def tree_of(spark, count, cells, seed=4):
    vectors = vector_table(spark, range(count), random_vectors(seed, count, 8, groups=25), "doc_id")
    return vectors, celltree.train_cell_tree(vectors, cells)


def test_every_vector_has_the_nearest_leaf_of_its_top(spark):
    vectors, tree = tree_of(spark, 700, 30)
    laid = celltree.assign_tree_cells(vectors, tree).collect()
    assert len(laid) == 700
    tops = {r["cell"]: np.array(r["centroid"]) for r in tree.tops.collect()}
    leaves = tree.leaves.collect()
    assert sorted(r["cell"] for r in leaves) == list(range(len(leaves)))
    for r in laid:
        v = np.array(r["vec"], float)
        far = lambda c: round(float(((np.array(c) - v) ** 2).sum()), 6)
        top = min(tops, key=lambda t: (far(tops[t]), t))
        assert r["cell"] == min((x for x in leaves if x["top"] == top), key=lambda x: (far(x["centroid"]), x["cell"]))["cell"]


def test_tree_search_over_all_cells_is_exhaustive(spark, monkeypatch):
    monkeypatch.setattr(celltree, "ROWS_PER_SALT", 100)
    vectors, tree = tree_of(spark, 600, 20)
    laid = celltree.assign_tree_cells(vectors, tree)
    asked = vector_table(spark, range(40), random_vectors(6, 40, 8, groups=25), "query_id")
    exact = S.search_flat(vectors, asked, 4)
    hits = celltree.search_tree(laid, tree, asked, 4, tree.leaves.count(), tree.tops.count())
    assert rows(hits) == rows(exact)
    few = celltree.search_tree(laid, tree, asked, 4, 6, 3)
    share = celltree.recall(few, exact).first()
    assert share["wanted"] == 160 and 0.8 <= share["recall"] <= 1
    # queries sent in several parts
    assert rows(celltree.search_tree(laid, tree, asked, 4, tree.leaves.count(), tree.tops.count(), limit=2048)) == rows(exact)


def test_trees_of_few_rows(spark):
    vectors, tree = tree_of(spark, 3, 50)
    assert celltree.assign_tree_cells(vectors, tree).count() == 3
    same = vector_table(spark, range(30), np.ones((30, 8), np.float32), "doc_id")
    tree = celltree.train_cell_tree(same, 9)
    assert celltree.assign_tree_cells(same, tree).count() == 30
    with pytest.raises(ValueError):
        celltree.train_cell_tree(same, 0)


def test_lloyd_finds_separate_groups():
    groups = np.array([[0.0, 0], [10, 0], [0, 10]])
    rows_ = np.repeat(groups, 20, axis=0) + np.random.default_rng(1).normal(size=(60, 2)) * 0.1
    order = np.random.default_rng(2).permutation(60)
    found = K.lloyd(rows_[order], 6, 20)
    assert all(np.sqrt(((found - g) ** 2).sum(axis=1)).min() < 1 for g in groups)
    assert len(K.lloyd(np.ones((5, 2)), 3, 5)) == 1
