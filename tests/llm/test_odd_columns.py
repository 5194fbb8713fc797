"""Ids that are no longs, null item ids, rows equal in id and text, and columns with the names the operators use."""

import random

import pytest
from pyspark.sql import functions as F

from topicloom.llm import containment, dart_minhash, imatch, line_crf, log_bilinear, mixing, ngram_bayes

CLASHING = ["_key", "_mine", "_cut", "_k1", "_t1", "_turn", "_keep_id", "_text_key", "row", "key", "id", "t1", "o1", "turn", "source2", "hit", "mine", "_id"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def rows_of():
    rows = [(i, words(i, 40), f"s{i % 3}") for i in range(12)]
    rows += [(20, rows[3][1], "s0"), (21, words(21, 30) + " " + words(900, 30), "s1"), (22, None, None), (23, "", "s1"), (None, words(5, 40), "s2")]
    rows += [(30, words(30, 25), "s0")] * 3 + [(40, words(40, 60000), "s2")]
    return [(*r, *[f"{k}-{n}" for n in range(len(CLASHING))]) for k, r in enumerate(rows)]


def documents(spark, kind):
    rows = [(None if r[0] is None else str(r[0]) if kind == "string" else r[0], *r[1:]) for r in rows_of()]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(-1, words(4, 40)), (None, words(900, 30)), (7, words(999, 30)), (8, None)], "item_id int, text string")


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("kind", ["int", "string"])
def test_filters_keep_columns_of_clashing_names(spark, items, kind):
    docs = documents(spark, kind)
    given = {key(r) for r in docs.collect()}
    single = dart_minhash.drop_near_duplicates(docs)
    got = [key(r) for r in single.collect()]
    assert single.columns == docs.columns and set(got) <= given and len(set(got)) == len(got)
    ids = sorted(g[0] for g in got)
    assert ids == sorted(str(i) for i in [*range(12), 21, 22, 30, 40])
    assert sorted(got) == sorted(key(r) for r in dart_minhash.drop_near_duplicates(docs.repartition(7)).collect())
    clean = containment.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(key(r) for r in clean.collect()) == sorted(g for g in map(key, rows_of()) if g[0] not in ("4", "21"))


def test_mix_keeps_columns_of_clashing_names(spark):
    docs = documents(spark, "int")
    given = {(r["doc_id"], r["_key"]): r for r in docs.collect()}
    mixed = mixing.mixed_rows(docs)
    got = mixed.collect()
    assert mixed.columns == docs.columns and got
    for r in got:
        whole = given[r["doc_id"], r["_key"]]
        assert all(r[c] == whole[c] for c in docs.columns if c != "text") and f" {r['text']} " in f" {whole['text']} "
    assert sorted(map(key, got)) == sorted(map(key, mixing.mixed_rows(docs.repartition(5)).collect()))


def test_null_item_ids_stay_null(spark, items):
    got = containment.contained_items(documents(spark, "int"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(4, -1), (21, None)}


def test_scores_of_ids_that_are_no_longs(spark):
    for kind in ("int", "string"):
        docs = documents(spark, kind).withColumn("lang", F.col("source"))
        field = line_crf.train(docs, docs.select("doc_id", (F.length("text") % 2).alias("quality")), F.lit(True))
        model, counts = log_bilinear.train(docs.where("length(text) < 1000"), F.lit(True))
        found = [
            line_crf.score(docs, field),
            ngram_bayes.predict(docs, ngram_bayes.train(docs, F.lit(True))),
            log_bilinear.score(docs, model, counts),
            imatch.edit_report(docs, imatch.lexicon(docs)),
        ]
        want = sorted(str(r[0]) for r in rows_of())
        for table in found:
            assert sorted(str(r["doc_id"]) for r in table.select("doc_id").collect()) == want
