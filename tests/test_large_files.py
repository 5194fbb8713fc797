"""CSV read in splits, one JSON array, documents by bucket, signed counts, the ordered fold and loaded models."""

import collections
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.functions.encoders import encode, factory_encoder
from topicloom.operators import fetch, folding
from topicloom.operators import keywords as W
from topicloom.operators import search as S
from topicloom.sources import arrays, files, splits

SCHEMA = "id bigint, text string, kind string, n bigint"


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of a few hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_rows(count, longest):
    r = random.Random(5)
    pieces = ["a", "b c", ",", '"', '""', "\n", "\n\n", "é", " x ", "\t", "end.\n", '\n"q"\n']
    return [(i, "".join(r.choice(pieces) for _ in range(r.randrange(1, longest))), r.choice(["k", "NaN", "l"]), r.choice([None, i])) for i in range(count)]


def test_csv_in_splits_equals_the_read_in_one_task(spark, small_splits, tmp_path):
    rows = odd_rows(300, 60) + [(900, "line\n" * 2000, "long", 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    files.write_csv(table.coalesce(2), str(tmp_path / "csv"))
    cut = spark.read.option("lineSep", "\n").text(str(tmp_path / "csv")).select("_metadata.file_block_start").distinct().count()
    assert cut > 20
    got = splits.read_csv_splits(spark, str(tmp_path / "csv"), SCHEMA)
    want = files.read_csv(spark, str(tmp_path / "csv"), SCHEMA)
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 301


def test_csv_in_splits_with_carriage_returns_and_chosen_columns(spark, small_splits, tmp_path):
    text = 'n,text,id\r\n' + "".join(f'{i},"a{i}\r\nb ""{i}""",{i * 2}\r\n' for i in range(200))
    (tmp_path / "f.csv").write_bytes(text.encode())
    got = splits.read_csv_splits(spark, str(tmp_path / "f.csv"), "id bigint, text string").collect()
    assert sorted((r["id"], r["text"]) for r in got) == sorted((i * 2, f'a{i}\r\nb "{i}"') for i in range(200))


def test_csv_in_splits_raises_on_broken_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n')
    with pytest.raises(ValueError, match="not closed"):
        splits.read_csv_splits(spark, str(tmp_path / "open.csv"), "a bigint")
    (tmp_path / "short.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception):
        splits.read_csv_splits(spark, str(tmp_path / "short.csv"), "a bigint, b string").collect()
    (tmp_path / "cell.csv").write_text("a,b\nx,1\n")
    with pytest.raises(Exception):
        splits.read_csv_splits(spark, str(tmp_path / "cell.csv"), "a bigint").collect()
    assert splits.read_csv_splits(spark, str(tmp_path / "cell.csv"), "a bigint", mode="null").collect()[0]["a"] is None
    with pytest.raises(ValueError, match="no column"):
        splits.read_csv_splits(spark, str(tmp_path / "cell.csv"), "z bigint")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two" / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="headers"):
        splits.read_csv_splits(spark, str(tmp_path / "two"), "a bigint")
    (tmp_path / "none.csv").write_text("a,b\n")
    assert splits.read_csv_splits(spark, str(tmp_path / "none.csv"), "a bigint").collect() == []


def test_json_array_is_one_ordered_array(spark, tmp_path):
    rows = [(i, f'te"xt,\n{i}]', None if i % 3 else {"k": [i]}) for i in range(500)]
    table = spark.createDataFrame(rows, "id bigint, t string, m map<string,array<int>>").repartition(9)
    arrays.write_json_array(table.withColumn("back", -F.col("id")), str(tmp_path / "a.json"), ["back"], ["id", "t", "m"])
    held = json.loads((tmp_path / "a.json").read_text())
    assert [h["id"] for h in held] == list(range(499, -1, -1))
    assert held[-1] == {"id": 0, "t": 'te"xt,\n0]', "m": {"k": [0]}} and held[0]["m"] is None
    with pytest.raises(FileExistsError):
        arrays.write_json_array(table, str(tmp_path / "a.json"), ["id"])
    arrays.write_json_array(table.limit(0), str(tmp_path / "b.json"), ["id"])
    assert json.loads((tmp_path / "b.json").read_text()) == []
    arrays.write_json_array(table.where("id = 7"), str(tmp_path / "c.json"), ["id"])
    assert [h["id"] for h in json.loads((tmp_path / "c.json").read_text())] == [7]


def test_fetch_reads_only_the_buckets_of_the_hits(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "id % 7 AS kind")
    path = str(tmp_path / "docs")
    assert fetch.save_buckets(docs, path, buckets=64) == 64
    kept = spark.read.parquet(path)
    wanted = spark.createDataFrame([(1, 1, 17, 0.5), (1, 2, 2500, 0.7), (2, 1, 17, 0.1), (2, 2, 99999, 0.2)], "query_id bigint, rank int, doc_id bigint, score double")
    hits = S.attach_documents(wanted, kept, ["text", "kind"])
    assert sorted(map(tuple, hits.collect())) == [(1, 1, 17, 0.5, "text 17", 3), (1, 2, 2500, 0.7, "text 2500", 1), (2, 1, 17, 0.1, "text 17", 3)]
    plan = hits._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "bucket_of_64" in plan

    def scanned(df):
        """Files that the scan of the documents has read."""
        node = df._jdf.queryExecution().executedPlan()
        df.collect()
        found = []

        def walk(n):
            if n.nodeName().startswith("AdaptiveSparkPlan"):
                return walk(n.executedPlan())
            if "QueryStage" in n.nodeName():
                return walk(n.plan())
            if n.nodeName().startswith("Scan parquet") and "text#" in n.toString():
                found.append(n.metrics().apply("numFiles").value())
            for k in range(n.children().length()):
                walk(n.children().apply(k))

        walk(node)
        return found

    assert max(scanned(fetch.fetch_rows(wanted, kept, ["text"]))) <= 3
    with pytest.raises(ValueError):
        fetch.fetch_rows(wanted, docs, ["text"])
    assert fetch.fetch_rows(wanted.limit(0), kept, ["text"]).count() == 0


def test_changed_counts_equal_a_recount(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(400):
        old, new = (r.choice([None, "a", "b", "c"]) for _ in range(2))
        rows.append((i, None if i % 50 == 0 else " ".join(r.choice(words) for _ in range(r.randrange(0, 12))), old, new))
    changes = spark.createDataFrame(rows, "id bigint, text string, old_topic string, new_topic string")

    def counted(column):
        return W.topic_term_counts(changes.where(F.col(column).isNotNull()), "text", column, ("w3",), (1, 2))

    got = W.changed_counts(counted("old_topic"), changes, "text", stopwords=("w3",), ngram_range=(1, 2))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, counted("new_topic").collect()))
    same = W.changed_counts(counted("old_topic"), changes.limit(0), "text")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, counted("old_topic").collect()))


@pytest.mark.parametrize("share", [0.5, 0.8, 0.0, 1.0])
def test_ordered_fold_over_rows_equals_the_fold_of_arrays(spark, share):
    rng = np.random.default_rng(1)
    lengths = {0: 1, 1: 2, 2: 3000, 3: 40, **{k: int(rng.integers(1, 9)) for k in range(4, 60)}}
    rows, want = [], {}
    for key, size in lengths.items():
        values = rng.normal(size=(size, 4)).astype(np.float32)
        rows += [(key, 10 * i - 5, [float(x) for x in v]) for i, v in enumerate(values)]
        want[key] = K.fold_rows(values.astype(float), np.array([size]), lambda a, b: share * a + (1 - share) * b)[0]
    random.Random(3).shuffle(rows)
    rows += [(None, 1, [0.0] * 4), (1, None, [0.0] * 4), (1, 5, None)]
    table = spark.createDataFrame(rows, "k bigint, at int, v array<float>").repartition(13)
    got = {r["k"]: r["vec"] for r in folding.fold_ordered(table, "k", "at", "v", share).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert folding.fold_ordered(table.limit(0), "k", "at", "v").count() == 0


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    marks = str(tmp_path / "loads")
    os.mkdir(marks)

    def load():
        open(f"{marks}/{os.getpid()}-{random.random()}", "w").close()
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    encoder = factory_encoder(load, 2)
    docs = spark.range(400).selectExpr("id", "repeat('x', cast(id % 9 AS int)) AS text").repartition(12)
    for _ in range(3):
        got = encode(docs, encoder, "text").collect()
        assert all(list(r["vec"]) == [len(r["text"]), 1.0] for r in got)
    loads = collections.Counter(name.split("-")[0] for name in os.listdir(marks))
    assert loads and max(loads.values()) == 1
