import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, random_vectors, vector_table
from topicloom.functions.encoders import hash_encoder
from topicloom.operators import clusters as C
from topicloom.plans import clustering as plan
from topicloom.plans import searching
from topicloom.staging import ordered_index, shared_folder, stage, stage_scope
from topicloom.streaming.assign import assign_stream
from topicloom.streaming.pages import clusters_so_far, heads_so_far, page_stream


def test_ordered_index_is_dense_and_ordered(spark):
    df = spark.range(500).selectExpr("id", "id % 7 AS k").repartition(9)
    rows = ordered_index(df, [df.k.desc(), df.id.asc()], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(500))
    assert [(r["k"], r["id"]) for r in rows] == sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))


def test_stage_keeps_rows_and_lives_in_the_shared_folder(spark):
    staged = stage(spark.range(5), "t")
    assert staged.count() == 5
    assert shared_folder(spark).removeprefix("file:") in staged.inputFiles()[0]


def test_shared_folder_must_be_set_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_scope_removes_its_tables_and_no_others(spark):
    outer = stage(spark.range(3), "outer")
    with stage_scope():
        inner = stage(spark.range(4), "inner")
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
        assert inner.count() == 4
    assert outer.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_whole_way_finds_the_text_itself(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    encoder = hash_encoder(64)
    built = searching.build(
        docs, encoder, "text", ["doc_id", "text", "lang"], plan.Settings(0.8, 3, 100, 2), 5, split=False, blend=False
    )
    first = docs.dropDuplicates(["text"]).limit(5).selectExpr("doc_id AS query_id", "text")
    hits = searching.search(built, first, encoder, 1, ["topic", "keywords", "lang", "text"])
    asked = {r["query_id"]: r["text"] for r in first.collect()}
    rows = hits.collect()
    assert len(rows) == 5
    assert all(r["text"] == asked[r["query_id"]] and r["score"] == 0.0 for r in rows)
    assert built.docs.count() == docs.count()
    assert built.docs.where("topic = -1").count() + built.clusters.count() == docs.count()


def test_stream_assigns_like_the_batch(spark, tmp_path):
    vectors = vector_table(spark, range(60), random_vectors(4, 60, 5, groups=4))
    vectors.write.parquet(str(tmp_path / "in"))
    heads = vectors.where("id < 6")
    arrivals = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "in"))
    stream = assign_stream(arrivals, heads, 0.8, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert stream.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select(*C.CLUSTER_COLUMNS)
    want = C.assign_nearest(vectors, heads, 0.8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = assign_stream(arrivals, heads, 0.8, str(tmp_path / "out2"), str(tmp_path / "cp2"), limit=80)
    assert again.awaitTermination(120)
    parts = spark.read.parquet(str(tmp_path / "out2")).select(*C.CLUSTER_COLUMNS)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, want.collect()))


def test_saved_stage_tables_search_alike(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 5} other{i % 3} text", "en") for i in range(30)], "doc_id bigint, text string, lang string")
    encoder = hash_encoder(32)
    built = searching.build(docs, encoder, "text", ["doc_id", "text"], plan.Settings(0.9, 2, 20, 2), 3)
    searching.save(built, str(tmp_path / "b"))
    asked = spark.createDataFrame([(1, "word1 text")], "query_id bigint, text string")
    once = searching.search(built, asked, encoder, 4, ["topic", "keywords"]).orderBy("rank").collect()
    again = searching.search(searching.load(spark, str(tmp_path / "b")), asked, encoder, 4, ["topic", "keywords"])
    assert once == again.orderBy("rank").collect() and len(once) == 4


CASES = [
    ("1", "n1", "m1", 19950101.0, "i" * 22 + ".", "s" * 25, "【주    문】" + "c" * 30 + "【이    유】" + "d" * 60 + " 주문과 같이 판결한다." + "주심"),
    ("2", "n2", "m2", 19910101.0, "j" * 30, "short", "x"),
    ("3", "n3", "m3", 19990101.0, "j" * 30, "t" * 40, "y"),
    ("4", "n4", "m4", 19800101.0, "k" * 30, "u" * 40, "z"),
    ("5", "n5", "m5", 19990101.0, None, "v" * 40, "z"),
]


def test_sentence_files(spark, tmp_path):
    from topicloom.plans import corpora
    from topicloom.sources.files import CASE_SCHEMA

    cases = spark.createDataFrame(CASES, CASE_SCHEMA)
    corpora.write_sentence_corpora(cases, str(tmp_path), sample=2)

    def lines(name):
        return [x for p in sorted((tmp_path / name).glob("part-*")) for x in p.read_text().splitlines()]

    small = ["i" * 22, "j" * 30, "j" * 30, "k" * 30, "s" * 25, "t" * 40, "u" * 40, "v" * 40]
    assert lines("small") == small
    assert lines("sample") == small[:2]
    assert lines("large")[:8] == small and len(lines("large")) == 9


def test_nested_record_files(spark, tmp_path):
    from topicloom.plans import corpora
    from topicloom.sources.files import CASE_SCHEMA

    corpora.write_nested_records(spark.createDataFrame(CASES, CASE_SCHEMA), str(tmp_path / "r"))
    rows = spark.read.json(str(tmp_path / "r")).collect()
    assert sorted(r["id"] for r in rows) == ["1", "2"]
    full = {r["id"]: r["law_case"]["full_text"] for r in rows}
    assert full["1"]["reasoning"].endswith("주문과 같이 판결한다.")


def test_registered_loops_run_the_rounds_of_the_plan():
    import __spark_entry__ as entry
    from topicloom.catalog import clustering as loops
    from topicloom.catalog import searching as ways

    rounds = plan.Settings().iterations
    assert loops.SETTINGS.iterations == rounds == ways.E2E.iterations
    for name in ("iterative_clusters", "warm_start_clusters", "e2e_search", "e2e_search_cells"):
        assert f"f{rounds} AS MATERIALIZED" in entry.oracle_sql()[name]


def streamed_by_hand(ids, vectors, threshold, smallest, size, order):
    """Clusters and page numbers of one lane, row by row."""
    units = {i: v / np.linalg.norm(v) for i, v in zip(ids, np.asarray(vectors, float))}
    heads, page, found, left, number = [], [], [], [], 0
    for i in order:
        near = sorted((-round(float(units[h] @ units[i]), 6), h) for h in heads)
        if near and -near[0][0] >= threshold:
            found.append((near[0][1], i, -near[0][0]))
            continue
        page.append(i)
        if len(page) == size:
            sims = {(a, b): round(float(units[a] @ units[b]), 6) for a in page for b in page}
            cover = {a: [b for b in page if sims[a, b] >= threshold] for a in page}
            taken = set()
            for a in sorted(page, key=lambda a: (-len(cover[a]), a)):
                if len(cover[a]) >= smallest and not taken & set(cover[a]):
                    taken |= set(cover[a])
                    own = [b for b in cover[a] if sims[a, b] > threshold]
                    if len(own) >= smallest:
                        found += [(a, b, sims[a, b]) for b in own]
                        heads.append(a)
            members = {m for _, m, _ in found}
            left += [i for i in page if i not in members]
            page, number = [], number + 1
    return sorted(found), sorted(left), sorted(page)


def test_page_stream_goes_on_from_its_state(spark, tmp_path):
    """Three runs of a stream, each with new files, end with what one look at all rows in order gives."""
    values = random_vectors(12, 330, 6, groups=14)
    order = np.random.default_rng(3).permutation(330)
    settings = plan.Settings(threshold=0.93, min_size=3, page_size=40)
    schema = "id bigint, vec array<float>, arrived bigint"
    lanes = 2
    for run, some in enumerate(np.array_split(order, 3)):
        start = sum(len(x) for x in np.array_split(order, 3)[:run])
        rows = [(int(i), [float(x) for x in values[i]], start + k) for k, i in enumerate(some)]
        rows += [(None, [0.0] * 6, 0), (9999, None, 0)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        lane = F.col("id") % lanes
        stream = page_stream(arrivals, settings, str(tmp_path / "out"), str(tmp_path / "cp"), lanes, order_col="arrived", lane=lane)
        assert stream.awaitTermination(200)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    for lane in range(lanes):
        mine = [int(i) for i in order if i % lanes == lane]
        found, left, waiting = streamed_by_hand(range(330), values, 0.93, 3, 40, mine)
        got = sorted((r["head_id"], r["member_id"], r["score"]) for r in out if r["lane"] == lane and r["head_id"] is not None)
        assert len(found) > 20 and waiting
        assert [g[:2] for g in got] == [f[:2] for f in found]
        assert np.allclose([g[2] for g in got], [f[2] for f in found], atol=2e-6)
        assert sorted(r["member_id"] for r in out if r["lane"] == lane and r["head_id"] is None) == left
    heads = heads_so_far(spark, str(tmp_path / "out"), vector_table(spark, range(330), values))
    assert {r["id"] for r in heads.collect()} == {r["head_id"] for r in clusters_so_far(spark, str(tmp_path / "out")).collect()}


def test_rows_that_no_head_takes_go_from_one_stream_to_the_other(spark, tmp_path):
    vectors = vector_table(spark, range(200), random_vectors(4, 200, 5, groups=12))
    vectors.write.parquet(str(tmp_path / "in"))
    heads = vectors.where("id < 6")
    arrivals = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "in"))
    first = assign_stream(arrivals, heads, 0.9, str(tmp_path / "out"), str(tmp_path / "cp"), left=str(tmp_path / "left"))
    assert first.awaitTermination(120)
    taken = {r["member_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    rest = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "left"))
    second = page_stream(rest, plan.Settings(0.9, 2, 25), str(tmp_path / "pages"), str(tmp_path / "cp2"), 3)
    assert second.awaitTermination(120)
    seen = [r["member_id"] for r in spark.read.parquet(str(tmp_path / "pages")).collect()]
    assert len(seen) == len(set(seen)) >= 50
    assert not taken & set(seen)


def test_a_stream_leaves_the_tables_of_other_threads(spark, tmp_path):
    """A scope that ends in one thread removes only what that thread has staged."""
    import threading

    entered, staged = threading.Event(), threading.Event()

    def scoped():
        with stage_scope():
            inner.append(stage(spark.range(4), "inner"))
            entered.set()
            staged.wait(60)

    inner = []
    thread = threading.Thread(target=scoped)
    thread.start()
    assert entered.wait(60)
    mine = stage(spark.range(7), "mine")
    staged.set()
    thread.join()
    assert mine.count() == 7
    with pytest.raises(Exception):
        spark.read.parquet(inner[0].inputFiles()[0])


def test_sentence_files_come_from_one_ordering(spark, tmp_path, monkeypatch):
    """Both files come out of one shuffle in corpus order; a file without lines is there too, an old one is kept."""
    from topicloom.plans import corpora
    from topicloom.sources.files import CASE_SCHEMA

    cases = [(str(i), "n", "m", 1.0, f"issue {i:04d} " + "i" * 20, f"summary {i:04d} " + "s" * 20, f"text {i:04d} " + "t" * 20) for i in range(1000, 3000)]
    table = spark.createDataFrame(cases, CASE_SCHEMA).repartition(7)
    monkeypatch.setattr(corpora, "stage", lambda *_: pytest.fail("lines are written to their files only"))
    ids = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lines", "lines")
    corpora.write_sentence_corpora(table, str(tmp_path / "a"), sample=3, sections=("(text.*)",))
    spark.sparkContext.setJobGroup("rest", "rest")

    def lines(name):
        return [x for p in sorted((tmp_path / name).glob("part-*")) for x in p.read_text().splitlines()]

    small = [c[4] for c in cases] + [c[5] for c in cases]
    assert lines("a/small") == small and lines("a/large") == small + [c[6] for c in cases] and lines("a/sample") == small[:3]
    assert len(ids.getJobIdsForGroup("lines")) <= 6
    with pytest.raises(FileExistsError):
        corpora.write_sentence_corpora(table, str(tmp_path / "a"))
    corpora.write_sentence_corpora(table.limit(0), str(tmp_path / "b"))
    assert spark.read.text([str(tmp_path / "b" / n) for n in ("small", "large", "sample")]).count() == 0
