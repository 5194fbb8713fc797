"""Document vectors: gated sentence merging, keyword blending, mean pooling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as V
from topicloom.functions import kernels as K
from topicloom.functions import text as T
from topicloom.functions import vectors as X
from topicloom.functions.encoders import Encoder, arrow_once, encode
from topicloom.operators.skipgram import word_vectors
from topicloom.staging import stage

#: Key vectors sent to every task; more of them are joined by a merge.
KEY_BYTES = 64 * 1024 * 1024
TEXTS_PER_PARTITION = 50_000


@dataclass(frozen=True)
class Gate:
    """How a running document vector takes in the next sentence vector.

    Either one constant share for the running vector, or the weights of a dense
    sigmoid gate: ``weight`` is dim x 2 dim, ``bias`` has dim entries.
    """

    share: float = 0.5
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None

    def step(self):
        if self.weight is None:
            share = self.share
            return lambda left, right: share * left + (1.0 - share) * right
        weight = np.asarray(self.weight, np.float64)
        bias = np.zeros(weight.shape[0]) if self.bias is None else np.asarray(self.bias, np.float64)
        return lambda left, right: K.gate_step(left, right, weight, bias)


def split_merge(
    df: DataFrame, encoder: Encoder, text_col: str, gate: Gate = Gate(), out: str = "vec"
) -> DataFrame:
    """Sentence vectors of each text folded in order through the gate.

    Sentences stay inside their row, so nothing is shuffled.  A block of rows is
    encoded in one call; a very long text is folded piece by piece.
    """
    dim, matrix, step = encoder.dim, encoder.matrix, gate.step()
    limit = max(1, K.CELLS_PER_BLOCK // dim)

    def run(sentences: pa.Array) -> pa.Array:
        lengths = sentences.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = sentences.flatten()
        ends = np.cumsum(lengths)
        merged = np.zeros((len(lengths), dim))
        row = 0
        while row < len(lengths):
            start = ends[row] - lengths[row]
            last = max(row + 1, int(np.searchsorted(ends, start + limit, side="right")))
            if last == row + 1 and lengths[row] > limit:
                state = None
                for at in range(int(start), int(ends[row]), limit):
                    part = matrix(pieces.slice(at, min(limit, int(ends[row]) - at)))
                    if state is not None:
                        part = np.concatenate([state, part])
                    state = K.fold_rows(part, np.array([len(part)]), step)
                merged[row] = state
            else:
                part = matrix(pieces.slice(int(start), int(ends[last - 1] - start)))
                merged[row:last] = K.fold_rows(part, lengths[row:last], step)
            row = last
        return K.vector_array(merged)

    run.__annotations__ = {"sentences": pa.Array, "return": pa.Array}
    vector = arrow_once(run, "array<float>")
    sentences = T.split_sentences(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn(out, vector(F.transform(sentences, encoder.features)))


def mean_pool(df: DataFrame, keys: list[str], vec_col: str, out: str = "vec") -> DataFrame:
    """Mean vector per key; partial sums are built before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vec_col)))
    return df.where(F.col(vec_col).isNotNull()).groupBy(*keys).agg(vector_to_array(mean).alias(out))


def pooled_vectors(
    docs: DataFrame, words: DataFrame, id_col: str, text_col: str, word_col: str = "word", word_vec: str = "vec", out: str = "vec"
) -> DataFrame:
    """``(id, vec)``: mean of the word vectors of each text, as a token model with mean pooling gives.

    The commonest words, ``KEY_BYTES`` of vectors at most, are sent to every task,
    which leaves one vector per text; only the other words are joined, each with
    its vector.  Texts without any known word are left out.
    """
    spark = docs.sparkSession
    words = words.select(F.col(word_col).alias("_word"), F.col(word_vec).cast("array<double>").alias("_vec")).where("_word IS NOT NULL AND _vec IS NOT NULL")
    texts = docs.select(F.col(id_col), T.tokens(F.col(text_col)).alias("_words"))
    first = words.select(F.size("_vec").alias("dim")).first()
    dim = first["dim"] if first else 1
    allowed = max(1, KEY_BYTES // (8 * max(1, dim)))
    sent, rest = words.limit(allowed + 1).toArrow(), None
    if sent.num_rows > allowed:
        sent, rest = _commonest(texts, stage(words, "words"), allowed)
    shared = spark.sparkContext.broadcast(_word_table(sent, dim))
    kind = docs.select(F.col(id_col).alias("_id")).schema["_id"].dataType.simpleString()
    part = texts.withColumnRenamed(id_col, "_id").mapInArrow(_pooled(shared, rest is not None), f"_id {kind}, _mean array<double>, _n double, _rest array<string>")
    if rest is not None:
        part = stage(part, "pooled")
    means = part.where("_n > 0").select("_id", "_mean", "_n")
    if rest is not None:
        left = part.select("_id", F.explode("_rest").alias("_word")).join(rest, "_word")
        means = means.unionByName(left.select("_id", F.col("_vec").alias("_mean"), F.lit(1.0).alias("_n")))
    # rows of an id come together before they are added: a vector is smaller than the state of its sum
    mean = Summarizer.mean(array_to_vector(F.col("_mean")), F.col("_n"))
    return means.repartition("_id").groupBy("_id").agg(vector_to_array(mean, "float32").alias(out)).withColumnRenamed("_id", id_col)


def _commonest(texts: DataFrame, words: DataFrame, allowed: int) -> tuple[pa.Table, DataFrame]:
    """About ``allowed`` of the words met most often, by steps of their count, and a table of all others."""
    counts = texts.select(F.explode("_words").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    known = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_rows"))
    counts = stage(counts.join(known, "_word").withColumn("_level", F.floor(F.log2("_n") * 8).cast("int")), "counts")
    least, held = None, 0
    for level, rows in sorted(counts.groupBy("_level").agg(F.sum("_rows")).collect(), reverse=True):
        if held + rows > allowed:
            break
        least, held = level, held + rows
    if least is None:
        return words.limit(0).toArrow(), words
    common = counts.where(F.col("_level") >= least).select("_word")
    return words.join(common, "_word", "left_semi").toArrow(), words.join(common, "_word", "left_anti")


def _word_table(sent: pa.Table, dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and of each the sum and the number of its vectors."""
    coded = sent.column("_word").combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    rows = np.zeros((len(coded.dictionary), dim))
    if len(at):
        np.add.at(rows, at, K.matrix(sent.column("_vec")))
    return coded.dictionary, rows, np.bincount(at, minlength=len(rows)).astype(float)


def _pooled(shared, others: bool):
    """Mean over the known words of each text and their number; with ``others``, the words that are not known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, times = shared.value
        limit = max(1, K.CELLS_PER_BLOCK // max(1, rows.shape[1]))
        for batch in batches:
            lists = batch.column("_words")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            found = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            code = found[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
            text = np.repeat(np.arange(len(lengths)), lengths)
            met = np.flatnonzero(code >= 0)
            sums, number = np.zeros((len(lengths), rows.shape[1])), np.zeros(len(lengths))
            for start in range(0, len(met), limit):
                part = met[start : start + limit]
                row, own = text[part], code[part]
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                # a text may go on from the part before
                sums[row[cut]] += np.add.reduceat(rows[own], cut, axis=0)
                number[row[cut]] += np.add.reduceat(times[own], cut)
            means = np.divide(sums, number[:, None], out=sums, where=number[:, None] > 0)
            gone = np.flatnonzero(code < 0) if others else np.empty(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[gone], minlength=len(lengths)))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(gone)))
            offsets = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * rows.shape[1])
            vecs = pa.ListArray.from_arrays(offsets, pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), vecs, pa.array(number), rest], ["_id", "_mean", "_n", "_rest"])

    return run


def train_word_vectors(docs: DataFrame, text_col: str, dim: int, seed: int = 7, min_count: int = 5, partitions: int | None = None) -> DataFrame:
    """``(word, vec)`` learned by skip-gram with a Huffman tree from the texts themselves.

    ``partitions`` comes from the number of texts unless it is given.  Words
    seen fewer than ``min_count`` times are left out; a null text has no words.
    Each task holds two vectors of ``dim`` floats per word.
    """
    words = F.coalesce(T.tokens(F.col(text_col)), F.array().cast("array<string>"))
    partitions = partitions or max(8, docs.count() // TEXTS_PER_PARTITION)
    return word_vectors(docs, words, dim, seed, min_count, partitions)


def keyword_vectors(topics: DataFrame, encoder: Encoder, keywords_col: str, out: str = "key_vec") -> DataFrame:
    """One vector per topic from its joined keyword list."""
    words = topics.withColumn("_words", T.keywords_text(F.col(keywords_col)))
    return encode(words, encoder, "_words", out).drop("_words")


def build_vectors(
    docs: DataFrame,
    encoder: Encoder,
    text_col: str,
    topic_keywords: DataFrame | None = None,
    split: bool = True,
    blend: bool = True,
    gate: Gate = Gate(),
    weight: float = V.BLEND_WEIGHT,
    topic_col: str = "topic",
    keywords_col: str = "keywords",
) -> DataFrame:
    """Final vectors in column ``vec``; ``split`` and ``blend`` give the four variants.

    Keyword lists are encoded once per topic and joined to the rows by topic.
    """
    if split:
        with_vectors = split_merge(docs, encoder, text_col, gate)
    else:
        with_vectors = encode(docs, encoder, text_col)
    if not blend:
        return with_vectors
    if topic_keywords is None:
        raise ValueError("blending needs the keywords of the topics")
    keys = keyword_vectors(topic_keywords.select(topic_col, keywords_col), encoder, keywords_col)
    # Spark counts an array as one number, so the size of the key vectors is worked out here.
    fits = topic_keywords.count() * encoder.dim * 4 <= KEY_BYTES
    keys = keys.select(topic_col, "key_vec")
    joined = with_vectors.join(F.broadcast(keys) if fits else keys.hint("merge"), topic_col, "left")
    mixed = X.blend(F.col("key_vec"), F.col("vec"), weight)
    return joined.withColumn("vec", F.coalesce(mixed, F.col("vec"))).drop("key_vec")
