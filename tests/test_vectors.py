import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import random_vectors
from topicloom.functions import kernels as K
from topicloom.functions import vectors as X
from topicloom.functions.encoders import encode, hash_encoder, model_encoder
from topicloom.operators import docvectors as D


def two(spark, a, b, build):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(build(F.col("a"), F.col("b")).alias("r")).first()["r"]


def test_arithmetic_goldens(spark):
    assert two(spark, [0.0, 0.0], [1.0, 0.0], X.cosine) == 0.0
    assert two(spark, [0.0, 0.0], [3.0, 4.0], X.squared_distance) == 25.0
    assert two(spark, [1.0, 2.0], [3.0, 4.0], X.dot) == 11.0
    assert two(spark, [1.0, 0.0], [0.0, 1.0], lambda k, d: X.blend(k, d, 0.25)) == [0.25, 0.75]
    assert two(spark, [3.0, 4.0], [0.0], lambda a, b: X.unit(a)) == pytest.approx([0.6, 0.8])
    assert two(spark, [0.0, 0.0], [0.0], lambda a, b: X.unit(a)) == [0.0, 0.0]


def test_blend_weights_at_the_ends(spark):
    assert two(spark, [1.0, 2.0], [3.0, 4.0], lambda k, d: X.blend(k, d, 1.0)) == [1.0, 2.0]
    assert two(spark, [1.0, 2.0], [3.0, 4.0], lambda k, d: X.blend(k, d, 0.0)) == [3.0, 4.0]


def test_softmax_of_large_scores(spark):
    got = two(spark, [1000.0, 1001.0], [0.0], lambda a, b: X.softmax(a))
    assert got == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])


def test_constant_fold_column_and_kernel_agree(spark):
    df = spark.createDataFrame([([[4.0], [2.0], [1.0]],)], "v array<array<float>>")
    assert df.select(X.constant_gate_fold(F.col("v")).alias("r")).first()["r"] == [2.0]
    folded = K.fold_rows(np.array([[4.0], [2.0], [1.0], [5.0]]), np.array([3, 0, 1]), D.Gate(0.5).step())
    assert folded.tolist() == [[2.0], [0.0], [5.0]]


def test_dense_gate_equals_constant_gate_when_saturated_at_half():
    zero = D.Gate(weight=np.zeros((2, 4)))
    rows = random_vectors(1, 5, 2).astype(float)
    a = K.fold_rows(rows, np.array([5]), zero.step())
    b = K.fold_rows(rows, np.array([5]), D.Gate(0.5).step())
    assert np.allclose(a, b)


def test_dense_gate_mixes_slots():
    rng = np.random.default_rng(2)
    weight, bias, rows = rng.normal(size=(3, 6)), rng.normal(size=3), rng.normal(size=(4, 3))
    want = rows[0]
    for nxt in rows[1:]:
        gate = [1 / (1 + math.exp(-(weight[i] @ np.concatenate([want, nxt]) + bias[i]))) for i in range(3)]
        want = np.array([g * a + (1 - g) * b for g, a, b in zip(gate, want, nxt)])
    folded = K.fold_rows(rows, np.array([4]), D.Gate(weight=weight, bias=bias).step())
    assert np.allclose(folded[0], want)


def test_matrix_reads_sliced_arrays():
    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32()))
    assert K.matrix(column.slice(1, 2)).tolist() == [[3.0, 4.0], [5.0, 6.0]]
    assert K.matrix(pa.array([], pa.list_(pa.float32()))).shape[0] == 0


def length_encoder():
    """A tiny wrapped model: length of the text and its number of blanks."""
    return model_encoder(lambda texts: np.array([[len(t), t.count(" ")] for t in texts], float).reshape(len(texts), 2), 2)


def test_model_encoder_and_null_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, t string")
    got = {r["id"]: r["vec"] for r in encode(df, length_encoder(), "t").collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 0.0]}


def test_split_merge_encodes_each_sentence(spark):
    df = spark.createDataFrame([(1, "aaaa. b"), (2, ""), (3, None)], "id bigint, t string")
    got = {r["id"]: r["vec"] for r in D.split_merge(df, length_encoder(), "t").collect()}
    assert got == {1: [3.5, 0.0], 2: [1.0, 0.0], 3: [1.0, 0.0]}


def test_long_text_folds_in_pieces_like_in_one_go(spark, monkeypatch):
    text = ". ".join("word%d more" % i for i in range(57))
    df = spark.createDataFrame([(1, text), (2, "x1. y1"), (3, text[:90])], "id bigint, t string")
    whole = {r["id"]: r["vec"] for r in D.split_merge(df, hash_encoder(8), "t", D.Gate(0.7)).collect()}
    monkeypatch.setattr(K, "CELLS_PER_BLOCK", 80)
    pieces = {r["id"]: r["vec"] for r in D.split_merge(df, hash_encoder(8), "t", D.Gate(0.7)).collect()}
    assert whole.keys() == pieces.keys()
    assert all(np.allclose(whole[i], pieces[i]) for i in whole)


def test_hash_encoder_is_unit_or_zero(spark):
    df = spark.createDataFrame([("one two two",), ("",), ("?",)], "t string")
    sizes = sorted(round(float(np.linalg.norm(r["vec"])), 5) for r in encode(df, hash_encoder(16), "t").collect())
    assert sizes == [0.0, 0.0, 1.0]


def test_mean_pool_skips_null_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("a", None), ("b", None)], "k string, vec array<float>")
    assert [(r["k"], r["vec"]) for r in D.mean_pool(df, ["k"], "vec").collect()] == [("a", [2.0, 4.0])]


def test_build_vectors_variants(spark):
    docs = spark.createDataFrame([(1, "alpha beta. gamma", 0), (2, "delta", -1)], "doc_id bigint, text string, topic int")
    keys = spark.createDataFrame([(0, "alpha, beta")], "topic int, keywords string")
    enc = hash_encoder(32)

    def run(**kw):
        return {r["doc_id"]: np.array(r["vec"]) for r in D.build_vectors(docs, enc, "text", keys, **kw).collect()}

    plain, mixed = run(split=False, blend=False), run(split=False, blend=True)
    key = np.array(encode(spark.createDataFrame([("alpha beta",)], "t string"), enc, "t").first()["vec"])
    assert np.allclose(mixed[1], 0.25 * key + 0.75 * plain[1], atol=1e-6)
    assert np.allclose(mixed[2], plain[2])  # a topic without keywords keeps the document vector
    assert not np.allclose(run(split=True, blend=False)[1], plain[1])
    with pytest.raises(ValueError):
        D.build_vectors(docs, enc, "text")


def test_arrow_function_is_not_copied_by_filters(spark):
    df = encode(spark.createDataFrame([("a",)], "t string"), hash_encoder(4), "t")
    plan = df.where("vec IS NOT NULL").select(F.posexplode("vec"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("rows", [[[1.0] * 63, [1.0] * 65], [[1.0], None], [[1.0, None], [1.0, 2.0]]])
def test_unequal_and_null_vectors_raise(rows):
    with pytest.raises(ValueError):
        K.matrix(pa.array(rows, pa.list_(pa.float32())))


def _pool_tables(spark):
    rows = [(1, "red red blue"), (1, "blue green"), (2, "grey"), (3, None), (None, "green green red"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 1.0]), ("green", [2.0, 2.0]), ("blue", [0.0, 3.0])], "word string, vec array<float>")
    # a word with two vectors counts with both
    want = {1: [4 / 7, 10 / 7], None: [5 / 3, 4 / 3]}
    return docs, words, want


@pytest.mark.parametrize("held", [64 * 1024, 32, 16])
def test_pooled_words_sent_or_joined(spark, monkeypatch, held):
    docs, words, want = _pool_tables(spark)
    monkeypatch.setattr(D, "KEY_BYTES", held)
    got = {r["doc_id"]: r["vec"] for r in D.pooled_vectors(docs, words, "doc_id", "text").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_pooled_words_shuffle_one_vector_per_text(spark):
    docs, words, _ = _pool_tables(spark)
    plan = D.pooled_vectors(docs, words, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
