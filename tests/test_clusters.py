import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import random_vectors, vector_table
from topicloom.functions import kernels as K
from topicloom.operators import clusters as C
from topicloom.operators import paging
from topicloom.plans import clustering as plan


def sequential_greedy(ids, units, threshold, smallest):
    """The plain rule: walk candidates by size, take those that touch nothing taken."""
    near = np.round(units @ units.T, 6) >= threshold
    order = sorted(range(len(ids)), key=lambda i: (-near[i].sum(), ids[i]))
    taken, out = set(), {}
    for i in order:
        members = {ids[j] for j in np.flatnonzero(near[i])}
        if members and not members & taken:
            taken |= members
            if len(members) >= smallest:
                out[ids[i]] = members
    return out


def as_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["head_id"], set()).add(r["member_id"])
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("smallest", [1, 3])
def test_greedy_kernel_equals_sequential_rule(seed, smallest, monkeypatch):
    monkeypatch.setattr(K, "CELLS_PER_BLOCK", 500)
    rng = np.random.default_rng(seed)
    ids = rng.permutation(1000)[:70].astype(np.int64)
    units = K.unit_rows(random_vectors(seed, 70, 6, groups=9).astype(float))
    heads, members, scores = K.greedy_page(ids, units, 0.8, smallest)
    got = {}
    for h, m in zip(heads.tolist(), members.tolist()):
        got.setdefault(h, set()).add(m)
    assert got == sequential_greedy(ids.tolist(), units, 0.8, smallest)
    assert (scores >= 0.8).all()


def test_equal_candidates_go_to_the_lower_id():
    units = np.array([[1.0, 0], [1, 0], [0, 1]])
    heads, members, _ = K.greedy_page(np.array([9, 4, 7]), units, 0.9, 1)
    assert sorted(zip(heads.tolist(), members.tolist())) == [(4, 4), (4, 9), (7, 7)]


def test_member_at_the_threshold_is_assigned_but_not_refiltered(spark):
    rows = [[1.0, 0.0], [0.6, 0.8], [0.61, 0.8]]
    vectors = vector_table(spark, [1, 2, 3], rows)
    heads = vectors.where("id = 1")
    assert {r["member_id"] for r in C.assign_nearest(vectors, heads, 0.6).collect()} == {1, 2, 3}
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0)], K.CLUSTER_SCHEMA)
    kept = {r["member_id"]: r["score"] for r in C.refilter(pairs, vectors, 0.6).collect()}
    assert set(kept) == {1, 3} and kept[3] == pytest.approx(0.6063, abs=1e-4)
    one_page = C.create_clusters(vectors, 0.6, 2, 10)
    assert as_sets(one_page) == {1: {1, 3}} or as_sets(one_page) == {2: {2, 3}} or as_sets(one_page) == {3: {1, 2, 3}}


@pytest.mark.parametrize("count, size, sizes", [(10, 4, [3, 3, 4]), (0, 4, []), (8, 4, [4, 4]), (3, 5, [3])])
def test_balanced_pages(spark, count, size, sizes):
    paged = paging.balanced_pages(spark.range(count), "id", size)
    got = sorted(r["count"] for r in paged.groupBy("page").count().collect())
    assert got == sizes


def test_balanced_pages_use_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(paging, "ROWS_PER_BUCKET", 10)
    paged = paging.balanced_pages(spark.range(2003), "id", 100, "s").groupBy("page").count().collect()
    assert len(paged) == 21 and {r["count"] for r in paged} == {95, 96}


def test_cluster_of_copies_needs_no_pairs(spark):
    """A third of all rows are copies of one vector and still form one cluster per page."""
    rows = np.vstack([np.tile([[1.0, 0.0, 0.0]], (300, 1)), random_vectors(3, 600, 3)])
    vectors = vector_table(spark, range(900), rows)
    found, left = plan.iterative_clusters(vectors, plan.Settings(0.999, 3, 200, 4))
    sets = as_sets(found)
    home = [h for h, m in sets.items() if 0 in m]
    assert len(home) == 1 and set(range(300)) <= sets[home[0]]


def check_invariants(vectors, found, left, threshold, smallest):
    rows = found.collect()
    ids = {r["id"] for r in vectors.collect()}
    members = [r["member_id"] for r in rows]
    assert len(members) == len(set(members))
    outside = {r["id"] for r in left.collect()}
    assert outside | set(members) == ids and not outside & set(members)
    sets = {}
    for r in rows:
        sets.setdefault(r["head_id"], []).append(r)
        assert r["score"] >= threshold
    assert all(len(m) >= smallest and h in {r["member_id"] for r in m} for h, m in sets.items())


def test_loop_invariants_and_warm_start(spark):
    vectors = vector_table(spark, range(400), random_vectors(5, 400, 8, groups=20))
    settings = plan.Settings(0.85, 3, 90, 4, "z")
    found, left = plan.iterative_clusters(vectors, settings)
    check_invariants(vectors, found, left, 0.85, 3)
    again, left_again = plan.iterative_clusters(vectors, plan.Settings(0.85, 3, 90, 0), found)
    assert as_sets(again) == as_sets(found)
    assert left_again.count() == left.count()
    some = found.where(F.col("score") > 0.9)
    warm, left_warm = plan.iterative_clusters(vectors, settings, some)
    old = as_sets(some)
    new = as_sets(warm)
    assert all(members <= new[h] for h, members in old.items())
    assert len(set().union(*new.values())) + left_warm.count() == 400
    shares = C.coverage(vectors, found).first()
    assert shares["clustered"] + left.count() == shares["total"] == 400


def test_loop_on_hash_pages(spark):
    vectors = vector_table(spark, range(200), random_vectors(7, 200, 8, groups=10))
    found, left = plan.iterative_clusters(vectors, plan.Settings(0.85, 3, 60, 2, paging="hash"))
    check_invariants(vectors, found, left, 0.85, 3)
    assert found.count() > 0
    with pytest.raises(ValueError):
        C.create_clusters(vectors, 0.85, 3, 60, paging="random")


def test_result_does_not_depend_on_partitions_or_row_order(spark):
    rows = random_vectors(6, 200, 6, groups=12)
    results = []
    for parts, order in ((1, 1), (4, -1), (16, 1)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        vectors = vector_table(spark, list(range(200))[::order], rows[::order]).repartition(parts)
        found, _ = plan.iterative_clusters(vectors, plan.Settings(0.85, 3, 60, 2))
        results.append(as_sets(found))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_head_merging_repeats_over_pages(spark):
    vectors = vector_table(spark, range(300), random_vectors(8, 300, 4, groups=6))
    settings = plan.Settings(0.8, 2, 40, 1, merge_page=5)
    created = C.create_clusters(vectors, 0.8, 2, 40)
    merged = plan.merge_heads(created, vectors, settings, "s")
    heads = merged.select("head_id").distinct().count()
    assert 0 < heads <= created.select("head_id").distinct().count()
    check = merged.groupBy("member_id").count().where("count > 1").count()
    assert check == 0


def test_empty_and_hopeless_inputs(spark):
    none = vector_table(spark, [], [])
    found, left = plan.iterative_clusters(none)
    assert found.count() == 0 and left.count() == 0
    far = vector_table(spark, range(4), np.eye(4))
    found, left = plan.iterative_clusters(far, plan.Settings(0.9, 2, 10, 3))
    assert found.count() == 0 and left.count() == 4
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id bigint, t string")
    assert {r["topic"] for r in C.stack(docs, found, ["doc_id"]).collect()} == {-1}
    zero = vector_table(spark, [1, 2], np.zeros((2, 3)))
    assert plan.iterative_clusters(zero, plan.Settings(0.5, 1, 10, 1))[0].count() == 0


def test_union_keeps_old_and_overlap_goes_to_the_larger(spark):
    old = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9)], K.CLUSTER_SCHEMA)
    new = spark.createDataFrame([(1, 5, 0.8), (7, 7, 1.0), (7, 2, 0.9), (7, 8, 0.9)], K.CLUSTER_SCHEMA)
    both = C.union_clusters(old, new)
    assert as_sets(both) == {1: {1, 2}, 7: {7, 2, 8}}
    assert as_sets(C.remove_overlap(both)) == {1: {1}, 7: {7, 2, 8}}
    assert as_sets(C.keep_large(both, 3)) == {7: {7, 2, 8}}
    numbers = {r["head_id"]: r["topic"] for r in C.topic_numbers(both).collect()}
    assert numbers == {7: 0, 1: 1}


def test_head_expansion_takes_in_members_of_old_heads(spark):
    grouped = spark.createDataFrame([(1, 1, 1.0), (1, 4, 0.9), (1, 6, 0.9)], K.CLUSTER_SCHEMA)
    old = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (4, 4, 1.0), (4, 5, 0.9)], K.CLUSTER_SCHEMA)
    known, moved = C.expand_heads(grouped, old)
    assert as_sets(known) == {1: {1, 2, 4, 6}}
    assert as_sets(moved) == {1: {5}}
    assert {r["member_id"]: r["score"] for r in known.collect()} == {1: 1.0, 4: 0.9, 6: 0.9, 2: 0.9}


def test_nearest_head_by_parts_equals_broadcast(spark):
    vectors = vector_table(spark, range(130), random_vectors(9, 130, 5, groups=7))
    heads = vectors.where("id < 40")
    small = C.assign_nearest(vectors, heads, 0.7)
    large = C.assign_nearest(vectors, heads, 0.7, limit=400)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert small.count() > 40


def test_equally_near_heads_go_to_the_lower_id(spark):
    vectors = vector_table(spark, [1], [[1.0, 1.0]])
    heads = vector_table(spark, [8, 5], [[1.0, 0.0], [0.0, 1.0]])
    assert C.assign_nearest(vectors, heads, 0.5).first()["head_id"] == 5


def test_locality_pages_hold_every_row_once(spark):
    values = random_vectors(8, 500, 6, groups=5)
    values[100:300] = values[7]
    vectors = vector_table(spark, range(500), values)
    pages = paging.locality_pages(vectors, "id", "vec", 60, "3").select("id", "page").collect()
    assert sorted(r["id"] for r in pages) == list(range(500))
    sizes = collections.Counter(r["page"] for r in pages)
    shift = paging.page_shift("3", 60)
    assert sizes[0] == 60 - shift
    assert all(sizes[p] == 60 for p in range(1, max(sizes)))
    assert paging.locality_pages(vectors.limit(0), "id", "vec", 60).count() == 0


def test_locality_finds_small_groups_in_few_rounds(spark):
    """Thirty groups of three among 1,500 other rows, in pages of fifty."""
    base = random_vectors(1, 1590, 16)
    for g in range(30):
        for copy in (1, 2):
            base[1500 + 3 * g + copy] = base[1500 + 3 * g] + 0.1 * random_vectors(900 + 3 * g + copy, 1, 16)[0]
    vectors = vector_table(spark, range(1590), base)
    found = {}
    for kind, rounds in (("locality", 3), ("balanced", 15)):
        settings = plan.Settings(threshold=0.95, min_size=3, page_size=50, iterations=rounds, paging=kind, seed="4")
        clusters, left = plan.iterative_clusters(vectors, settings)
        found[kind] = clusters.select("head_id").distinct().count()
        assert clusters.count() + left.count() == 1590
    assert found["locality"] >= 18 > 2 * found["balanced"]


def test_many_heads_cost_no_more_jobs(spark, monkeypatch):
    """A bound of few heads: the jobs do not grow with the heads, ties go to the lower head, a share may meet many batches."""
    from topicloom.operators import blocks

    monkeypatch.setattr(blocks, "SHARE_BYTES", 8 * 5 * 20)
    values = random_vectors(9, 400, 5, groups=7)
    values[100:140] = values[0:40]
    vectors = vector_table(spark, range(400), values)
    tracker = spark.sparkContext.statusTracker()

    def jobs(heads):
        group = f"heads-{heads}"
        spark.sparkContext.setJobGroup(group, group)
        got = sorted(map(tuple, C.assign_nearest(vectors, vectors.where(F.col("id") < heads), 0.7, limit=400).collect()))
        spark.sparkContext.setJobGroup("rest", "rest")
        return got, len(tracker.getJobIdsForGroup(group))

    few, many = jobs(40), jobs(300)
    assert many[1] <= few[1] + 1
    assert many[0] == sorted(map(tuple, C.assign_nearest(vectors, vectors.where(F.col("id") < 300), 0.7).collect()))
