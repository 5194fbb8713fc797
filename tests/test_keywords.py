import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicloom.operators import keywords as W


@pytest.fixture
def docs(spark):
    rows = [(1, "red apple the apple", 0), (2, "green pear", 0), (3, "red car", 1), (4, None, 1), (5, "the the", 2), (6, "x", -1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, topic int")


def test_class_tf_idf_by_hand(docs):
    counts = W.topic_term_counts(docs, "text", stopwords=["the"])
    scored = {(r["topic"], r["term"]): r for r in W.class_tf_idf(counts, docs).collect()}
    assert scored[0, "apple"]["n"] == 2
    assert scored[0, "apple"]["score"] == pytest.approx(2 / 5 * math.log(6 / 2))
    assert scored[1, "red"]["score"] == pytest.approx(1 / 2 * math.log(6 / 2))
    assert (1, "apple") not in scored


def test_keywords_of_thin_topics(docs):
    got = {r["topic"]: r["keywords"] for r in W.topic_keywords(docs, "text", 10, stopwords=["the"]).collect()}
    assert got == {0: ["apple", "green", "pear", "red"], 1: ["car", "red"], 2: [], -1: []}


def test_attach(docs):
    words = W.topic_keywords(docs, "text", 1, stopwords=["the"])
    got = {r["doc_id"]: r["keywords"] for r in W.attach_keywords(docs.select("doc_id", "topic"), words).collect()}
    assert got[1] == "apple" and got[5] == ""


def test_border_ngrams_equal_joined_texts(spark, docs):
    rows = [(i, " ".join("w%d" % ((i * 7 + j) % 5) + "x" for j in range(i % 4)), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, topic int").repartition(6)
    got = W.topic_term_counts(df, "text", ngram_range=(1, 3), cross_docs=True, order_col="doc_id").collect()
    want = Counter()
    for topic in (0, 1):
        words = [w for i, t, p in rows if p == topic for w in t.split()]
        for n in (1, 2, 3):
            want.update((topic, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    assert {(r["topic"], r["term"]): r["n"] for r in got} == dict(want)


def test_cross_docs_needs_an_order(docs):
    with pytest.raises(ValueError):
        W.topic_term_counts(docs, "text", ngram_range=(2, 2), cross_docs=True)


def test_top_terms_limit_runs_before_the_shuffle(docs):
    counts = W.topic_term_counts(docs, "text")
    plan = W.top_terms(W.class_tf_idf(counts, docs), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stopword_table_equals_list(spark, docs):
    rows = [(i, " ".join("w%dx" % ((i * 7 + j) % 5) for j in range(i % 6)), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, topic int").repartition(6)
    stops = spark.createDataFrame([("w1x",), ("w3x",)], "word string")
    for grams in ((1, 1), (1, 2)):
        across = grams[1] > 1
        want = W.topic_term_counts(df, "text", stopwords=["w1x", "w3x"], ngram_range=grams, cross_docs=across, order_col="doc_id")
        got = W.topic_term_counts(df, "text", stopwords=stops, ngram_range=grams, cross_docs=across, order_col="doc_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3


def test_runs_of_any_topic_kind_in_bounded_tasks(spark, monkeypatch):
    """One row per place travels, counts leave a task early, a struct or null topic is a topic, short texts count."""
    from pyspark.sql import types as S

    monkeypatch.setattr(W, "COUNTED", 20)
    rows = [(i, " ".join("w%d" % ((i * 7 + j) % 5) + "x" for j in range(i % 7)), None if i % 3 == 2 else (i % 3, "a")) for i in range(60)]
    topic = S.StructType([S.StructField("k", S.IntegerType()), S.StructField("s", S.StringType())])
    df = spark.createDataFrame(rows, S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("topic", topic)]))
    for low, high in ((1, 2), (2, 3), (1, 4), (3, 3)):
        want = Counter()
        for _, text, t in rows:
            words = text.split()
            for n in range(low, high + 1):
                want.update((t and tuple(t), " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
        counts = W.topic_term_counts(df, "text", ngram_range=(low, high))
        assert {(r["topic"] and tuple(r["topic"]), r["term"]): r["n"] for r in counts.collect()} == dict(want)
        assert counts.count() == len(want)
        # partial counts leave the tasks as longest runs: one shuffle, no hash tables of n-grams before it
        plan = W.topic_term_counts(df, "text", ngram_range=(low, high))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")
    sent = W.run_counts(W.word_lists(df, "text", "topic", None, ()), 2, 3)
    assert sent.agg(F.sum("n")).first()[0] == sum(max(0, len(t.split()) - 1) for _, t, _ in rows)
