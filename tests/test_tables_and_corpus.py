import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as V
from topicloom.operators import corpus, tables


def test_keep_first_then_date_filter(spark):
    rows = [(1, "k", 19890101.0), (2, "k", 19950101.0), (3, "m", 19900000.0), (4, "n", 19900101.0), (5, "o", None)]
    df = spark.createDataFrame(rows, "pos bigint, judgment_issue string, date double")
    got = tables.clean_table(df, "judgment_issue", "date", 19900000.0, "pos").collect()
    assert [r["pos"] for r in got] == [4]


def test_keep_first_tells_null_and_empty_keys_apart(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, None, "b"), (4, "a", "bc"), (5, "ab", "c"), (6, "ab", "c")]
    df = spark.createDataFrame(rows, "pos bigint, k string, l string")
    got = tables.keep_first(df, ["k", "l"], [F.asc("pos")])
    assert sorted(r["pos"] for r in got.collect()) == [1, 2, 4, 5]
    assert "_key" not in got.columns


def test_year_window(spark):
    df = spark.createDataFrame([("J 2018",), ("2016",), ("2020",), ("vol",), (None,)], "ref string")
    got = tables.year_window(df, "ref", 2017, 2020).collect()
    assert sorted(r["year"] for r in got) == [2018, 2020]


def test_preview(spark):
    got = tables.preview(spark.range(9), [F.asc("id")]).collect()
    assert [(r["id"], r["total_rows"]) for r in got] == [(i, 9) for i in range(5)]


def test_inference_pairs(spark):
    rows = [("a", "b", "neutral"), ("a", "b", "neutral"), ("a", None, "neutral"), ("a", "c", "contradiction")]
    df = spark.createDataFrame(rows, "sentence1 string, sentence2 string, gold_label string")
    got = sorted((r["texts"], r["label"]) for r in corpus.inference_pairs(df).collect())
    assert got == [(["a", "b"], 2), (["a", "c"], 0)]
    bad = spark.createDataFrame([("a", "b", "maybe")], df.schema)
    with pytest.raises(PySparkException):
        corpus.inference_pairs(bad).collect()
    assert corpus.inference_pairs(bad, strict=False).first()["label"] is None


def test_similarity_pairs_are_distinct_on_all_columns(spark):
    rows = [("x", 5.0, "a", "b"), ("y", 5.0, "a", "b"), ("y", 5.0, "a", "b"), ("z", 0.0, "c", "d"), ("z", 2.5, "e", "f")]
    df = spark.createDataFrame(rows, "genre string, score double, sentence1 string, sentence2 string")
    got = sorted(r["label"] for r in corpus.similarity_pairs(df).collect())
    assert got == [0.0, 0.5, 1.0, 1.0]


def test_nested_records(spark):
    long_text = "【주    문】 원심 abc 판결【이    유】 상고 이유 주문과 같이 판결한다." + " 가" * 100
    rows = [("1", "n", "m", "法 쟁점!", "요지", long_text), ("2", "n", "m", "쟁점", "요지", "짧다")]
    df = spark.createDataFrame(rows, "i string, n string, m string, issue string, summary string, contents string")
    got = corpus.nested_records(df, "i", "n", "m", "issue", "summary", "contents", mapping={"法": "법"})
    first, second = got.orderBy("id").collect()
    assert first["law_case"]["issue"] == "법 쟁점"
    assert first["law_case"]["full_text"]["ruling"] == "원심 판결"
    assert first["law_case"]["full_text"]["reasoning"] == "상고 이유 주문과 같이 판결한다."
    assert second["law_case"]["full_text"]["ruling"] is None
    assert V.SHORTEST_FULL_TEXT == 100


def test_sentence_corpus_order_and_nulls(spark):
    rows = [(1, "a" * 21 + "." + "short", None), (2, None, "b" * 21 + "?" + "prec" * 6)]
    df = spark.createDataFrame(rows, "doc bigint, issue string, summary string")
    got = corpus.sentence_corpus(df, "doc", {"issue": F.col("issue"), "summary": F.col("summary")})
    lines = got.orderBy("field_no", "doc_id", "pos").collect()
    assert [(r["field"], r["doc_id"], r["pos"], r["sentence"]) for r in lines] == [
        ("issue", 1, 0, "a" * 21), ("summary", 2, 0, "b" * 21), ("summary", 2, 1, ""),
    ]
    assert corpus.corpus_sample(got, 2).count() == 2
    assert corpus.corpus_lines(got, ["issue"]).columns == ["sentence"]
