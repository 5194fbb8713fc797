"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and its two
neighbours; forward-backward gives each line's probability of being good, and
their mean, weighted by line length, is turned into the document's score.
Training texts carry one label, which all their lines take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import chunks, row_id

#: Labelled texts the field is fitted to: those with the least hash of their id.
TRAIN_DOCS = 4000
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
ACCEPT = 0.3

_KINDS = np.zeros((256, 6), np.float32)
_KINDS[ord("A") : ord("Z") + 1, 0] = 1
_KINDS[ord("a") : ord("z") + 1, 1] = 1
_KINDS[ord("0") : ord("9") + 1, 2] = 1
_KINDS[[ord(c) for c in "!#$%&*@^~_=+<>{}[]\\/"], 3] = 1
_KINDS[ord("|"), 4] = 1
_KINDS[128:, 5] = 1
#: Steps at which a ratio becomes a feature of its own.
_STEPS = ((0, 0.2), (0, 0.5), (2, 0.1), (3, 0.02), (3, 0.1), (4, 0.01), (6, 0.35), (6, 0.6), (6, 0.8), (7, 0.5))
OWN = 10 + len(_STEPS)
WIDTH = 3 * OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and the number of lines of each text (one at least)."""
    lines: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.split(b"\n")
        counts[k] = len(own)
        lines += own
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    x = np.zeros((len(lines), OWN), np.float32)
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    for j in range(6):
        x[:, j] = np.add.reduceat(_KINDS[data, j], start)
    letters = np.maximum(x[:, 0] + x[:, 1] + x[:, 5] / 2, 1)
    scale = np.maximum(size, 1)
    x[:, 0] /= letters
    x[:, 1] /= scale
    for j in (2, 3, 4, 5):
        x[:, j] /= scale
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            once = len(set(words))
            x[i, 6] = once / n
            same = sum(map(bytes.__eq__, words[1:], words)) if once < 0.9 * n else 0
            x[i, 7] = same / n
            x[i, 8] = n
        else:
            x[i, 6] = 1
    x[:, 9] = np.log1p(size / np.maximum(x[:, 8], 1)) / 3
    x[:, 8] = np.log1p(x[:, 8]) / 5
    for j, (of, step) in enumerate(_STEPS):
        x[:, 10 + j] = x[:, of] > step
    first = np.zeros(len(lines), bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else []] = True
    last = np.roll(first, -1)
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    out = np.concatenate([x, before, after, np.ones((len(x), 1)), first[:, None], last[:, None]], axis=1).astype(np.float32)
    return out, size, counts


@dataclass
class Field:
    """Weights of both labels (bad, good), of label pairs, and the two of the final step."""

    weights: np.ndarray
    pairs: np.ndarray
    slope: float = 4.0
    offset: float = 0.0


def _passes(unary: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums of every line, and each text's log of all paths.

    All texts advance together, line by line; texts are ordered by their
    number of lines, so those that still go on are always the first ones.
    """
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    going = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    ahead, back = unary.copy(), np.zeros_like(unary)
    for t in range(1, len(going)):
        at = start[: going[t]] + t
        old = ahead[at - 1]
        ahead[at] += np.logaddexp(old[:, :1] + pairs[0], old[:, 1:] + pairs[1])
    for t in range(len(going) - 1, 0, -1):
        at = start[: going[t]] + t
        new = back[at] + unary[at]
        back[at - 1] = np.logaddexp(pairs[:, 0] + new[:, :1], pairs[:, 1] + new[:, 1:])
    ends = np.cumsum(counts) - 1
    return ahead, back, np.logaddexp(ahead[ends, 0], ahead[ends, 1])


def marginals(field: Field, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of each line to be good."""
    unary = x.astype(np.float64) @ field.weights
    ahead, back, _ = _passes(unary, counts, field.pairs)
    both = ahead + back
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


def fit(x: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Field:
    """Greatest likelihood with a ridge, by Adam over all texts; then the two weights of the final step."""
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)))
    if not len(labels) or labels.min() == labels.max():
        # nothing to tell apart: every text gets the one label, or one half
        field.slope, field.offset = 0.0, (4.0 if labels[0] else -4.0) if len(labels) else 0.0
        return field
    x = x.astype(np.float64)
    owner = np.repeat(np.arange(len(counts)), counts)
    line = labels[owner]
    # both labels count alike, and a text of many lines no more than one of few
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean()) / counts
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - counts] = False
    inner = np.flatnonzero(inner)
    truth = np.stack([line == 0, line == 1], axis=1).astype(np.float64)
    moments = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        unary = x @ field.weights
        ahead, back, total = _passes(unary, counts, field.pairs)
        chance = np.exp(ahead + back - total[owner][:, None])
        gap = (truth - chance) * weight[owner][:, None]
        slope = x.T @ gap / len(counts) - RIDGE * field.weights
        joint = np.exp(ahead[inner - 1][:, :, None] + field.pairs + (unary + back)[inner][:, None, :] - total[owner[inner]][:, None, None])
        known = truth[inner - 1][:, :, None] * truth[inner][:, None, :]
        pair = ((known - joint) * weight[owner[inner]][:, None, None]).sum(axis=0) / len(counts) - RIDGE * field.pairs
        for value, g, m, v in ((field.weights, slope, moments[0], moments[1]), (field.pairs, pair, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    mean = text_means(marginals(field, x, counts), size, counts)
    z = _logit(mean)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((labels - p) * z).sum() - a, (labels - p).sum()])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    field.slope, field.offset = float(max(a, 1e-3)), float(b)
    return field


def text_means(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the lines' values, weighted by their lengths; empty lines weigh one."""
    starts = np.cumsum(counts) - counts
    weight = size + 1.0
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts) if len(counts) else np.empty(0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, texts in chunks(batch):
            x, size, counts = line_features(texts)
            ends = np.cumsum(counts)
            rows = [(x[e - n : e].tobytes(), size[e - n : e].tobytes()) for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_label").slice(start, stop - start), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                ["label", "x", "size"],
            )


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Field:
    """A field fitted to at most ``most`` labelled texts, those with the least hash of their id.

    ``allowed`` says of a row of ``docs`` whether it may be learned from.  An
    id with several labels takes the more frequent one, good if they tie.
    Null ids, labels and texts are not learned from.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    # only labelled ids, a bounded number of them, meet their texts
    own = docs.where(allowed & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_own"), F.col(text_col).alias("text"))
    first = marks.join(own.select("_own").distinct(), F.col("_id") == F.col("_own"))
    chosen = first.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", "_label")
    texts = own.join(F.broadcast(chosen), F.col("_own") == F.col("_id"))
    # rows that share an id count once
    once = Window.partitionBy("_id").orderBy(F.length("text"), F.xxhash64("text"))
    texts = texts.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_id", "_label", "text")
    packed = texts.select("_label", "text", "_id").mapInArrow(_pack, "label int, x binary, size binary").toArrow()
    rows = sorted(zip(*[packed.column(c).to_pylist() for c in ("label", "size", "x")]))
    size = [np.frombuffer(r[1], np.int64) for r in rows]
    x = np.concatenate([np.frombuffer(r[2], np.float32) for r in rows]).reshape(-1, WIDTH) if rows else np.empty((0, WIDTH))
    return fit(x, np.concatenate(size) if rows else np.empty(0), np.array([len(s) for s in size], np.int64), np.array([r[0] for r in rows], np.int64))


def _score(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            out = np.empty(batch.num_rows)
            bad = np.empty(batch.num_rows, np.int64)
            for start, stop, texts in chunks(batch):
                x, size, counts = line_features(texts)
                good = marginals(field, x, counts)
                mean = text_means(good, size, counts)
                out[start:stop] = 1 / (1 + np.exp(-np.clip(field.slope * _logit(mean) + field.offset, -500, 500)))
                bad[start:stop] = np.add.reduceat(good < 0.5, np.cumsum(counts) - counts)
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out), pa.array(bad)], [*names, "score", "bad_lines"])

    return run


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, bad_lines)``: one row per input row, from its whole text alone.

    ``score`` is between 0 and 1, higher where a good label is likelier.  A
    null text counts as empty, and an empty text is one empty line; both get a
    score like others.  An empty table gives no rows.
    """
    plain = docs.select(row_id(id_col), F.col(text_col).alias("text"))
    return plain.mapInArrow(_score(field), "doc_id long, score double, bad_lines long")


def keep_good(docs: DataFrame, field: Field, accept: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """The rows with a score of ``accept`` or more, with all their columns.

    The score is a scalar Arrow function of the text, so rows stay where they are.
    """
    run = _score(field)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return next(run(iter([batch]))).column("score") if len(texts) else pa.array([], pa.float64())

    return docs.where(scored.asNondeterministic()(F.col(text_col)) >= accept)
