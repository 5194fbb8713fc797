"""Hard negatives by exact integer scores.

Vectors become integer components; their inner products are found modulo
several small primes by float32 matrix products, which are exact as long as a
sum stays under 2**24, and put together again by Chinese remaindering.  Anchors
are a stated query set: they go to the tasks in bounded blocks, and every block
meets all rows where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.staging import stage, stage_path

SCALE = 256
#: Bytes of residues and of running best rows that one block of anchors may take in a task.
BLOCK_BYTES = 48 << 20
#: Scores held at once in a task.
CELLS = 2_000_000
#: Found rows that wait before the best ones are chosen anew.
WAITING = 1_000_000
#: Greatest sum that float32 holds exactly.
EXACT = 1 << 24
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def primes_for(bound: int) -> list[int]:
    """Largest primes under 256 whose product exceeds ``2 * bound + 1``: all scores within the bound differ modulo it."""
    small = [n for n in range(3, 256) if all(n % d for d in range(2, math.isqrt(n) + 1))]
    taken, product = [], 1
    while product <= 2 * bound + 1:
        taken.append(small.pop())
        product *= taken[-1]
    return taken


def residues(components: np.ndarray, primes: list[int]) -> np.ndarray:
    """``(primes, rows, dim)`` remainders around zero, one byte each, of whole numbers held as float64."""
    out = np.empty((len(primes), *components.shape), np.int8)
    for k, p in enumerate(primes):
        left = np.fmod(components, p)
        half = p // 2
        out[k] = left - p * (left > half) + p * (left < -half)
    return out


def products(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """``left @ right.T`` modulo ``p`` as int32, by float32 products over as many components as stay exact."""
    span = max(1, EXACT // (p // 2) ** 2)
    total = np.zeros((len(left), len(right)), np.int32)
    for at in range(0, left.shape[1], span):
        part = left[:, at : at + span].astype(np.float32) @ right[:, at : at + span].astype(np.float32).T
        total += part.astype(np.int32) % p
        if at:
            total %= p
    return total


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed scores from their remainders modulo the primes.

    Half of the product of all primes is added first, so that no score is
    negative; the digits of the mixed-radix form then add up modulo 2**64,
    which is exact for every score of 64 bits.
    """
    shift = math.prod(primes) // 2
    digits: list[np.ndarray] = []
    value = np.zeros(parts[0].shape, np.uint64)
    weight = 1
    for part, p in zip(parts, primes):
        digit = part + shift % p
        for earlier, q in zip(digits, primes):
            digit = (digit - earlier) * pow(q, -1, p) % p
        digit %= p
        digits.append(digit)
        value += digit.astype(np.uint64) * np.uint64(weight % (1 << 64))
        weight *= p
    return (value - np.uint64(shift % (1 << 64))).view(np.int64)


def exact_scores(left: np.ndarray, right: np.ndarray, primes: list[int]) -> np.ndarray:
    """Integer inner products of two residue stacks."""
    return remaindered([products(a, b, p) for a, b, p in zip(left, right, primes)], primes)


class Best:
    """The ``k`` best rows of each slot: highest score first, equal scores by the smaller id."""

    def __init__(self, slots: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        #: A row under this score cannot be among the best of its slot.
        self.floor = np.full(slots, _LEAST) if floor is None else floor.copy()
        self.held = [np.empty(0, np.int64)] * 3
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(slots):
            self.waiting.append((slots, scores, ids))
            self.count += len(slots)
            if self.count >= WAITING:
                self.choose()

    def choose(self) -> None:
        if not self.waiting:
            return
        slots, scores, ids = (np.concatenate(c) for c in zip(self.held, *self.waiting))
        order = np.lexsort((ids, ~scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        best = place < self.k
        self.held = [slots[best], scores[best], ids[best]]
        full = place == self.k - 1
        self.floor[slots[full]] = scores[full]
        self.waiting, self.count = [], 0


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Whole-number components as float64; shorter vectors end in zeros, longer ones are cut at ``dim``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes) and (sizes == sizes[0]).all():
        rows = flat.reshape(len(sizes), -1)[:, :dim]
        return rows if rows.shape[1] == dim else np.pad(rows, ((0, 0), (0, dim - rows.shape[1])))
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < dim
    out[row[inside], place[inside]] = flat[inside]
    return out


def _measure(scale: int):
    """Greatest squared length and number of components of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("vec")
                dim = int(np.diff(column.offsets.to_numpy()).max())
                rows = _matrix(column, dim, scale)
                yield pa.RecordBatch.from_arrays([pa.array([float((rows * rows).sum(axis=1).max(initial=0))]), pa.array([dim], pa.int32())], ["square", "dim"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column, is_anchor: Column) -> DataFrame:
    """``(id, label, vec, asks)`` of the rows that take part."""
    finite = F.forall(F.col(vec_col), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"),
        is_anchor.alias("asks"), finite.alias("finite"),
    )
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND finite").drop("finite")


def _in_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, task: Callable, schema: str) -> DataFrame:
    """Results of all rows against each block of anchors, written block by block; one block is held at a time."""
    spark = rows.sparkSession
    path = stage_path(spark, "anchor-blocks")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        asked = anchors.where(F.col("block") == block).drop("block").toArrow()
        if asked.num_rows:
            shared = spark.sparkContext.broadcast(asked)
            rows.mapInArrow(task(shared), schema).write.mode("append").parquet(path)
            shared.unpersist()
    return spark.read.schema(schema).parquet(path)


def _scored(batches, residue, labels, ids, dim, scale, primes):
    """``(anchors, scores, same label, other row, row ids)`` for pieces of all rows against pieces of the anchors.

    The first pieces are small, so that the running best rows soon keep most others out.
    """
    step = 64
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, step)
            at += step
            own = residues(_matrix(piece.column("vec"), dim, scale), primes)
            row_ids, row_labels = np.asarray(piece.column("id")), np.asarray(piece.column("label"))
            width = max(1, CELLS // piece.num_rows)
            for a in range(0, len(ids), width):
                some = slice(a, a + width)
                scores = exact_scores(residue[:, some], own, primes)
                yield some, scores, labels[some, None] == row_labels, ids[some, None] != row_ids, row_ids
            step = min(8192, 4 * step)


def _unpacked(asked: pa.Table, dim: int, scale: int, primes: list[int]):
    ids, labels = asked.column("id").to_numpy(), asked.column("label").to_numpy()
    vectors = asked.column("vec").combine_chunks()
    return residues(_matrix(vectors, dim, scale), primes), labels, ids


def _positives(k: int, dim: int, scale: int, primes: list[int]):
    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            residue, labels, ids = _unpacked(asked, dim, scale, primes)
            best = Best(len(ids), k)
            for some, scores, same, other, row_ids in _scored(batches, residue, labels, ids, dim, scale, primes):
                slot, row = np.nonzero(same & other & (scores >= best.floor[some, None]))
                best.add(slot + some.start, scores[slot, row], row_ids[row])
            best.choose()
            slot, score, row = best.held
            yield pa.RecordBatch.from_arrays([pa.array(asked.column("slot").to_numpy()[slot]), pa.array(row), pa.array(score)], ["slot", "positive_id", "positive_score"])

        return run

    return task


def _negatives(k: int, dim: int, scale: int, primes: list[int], low: int, high: int):
    def task(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            residue, labels, ids = _unpacked(asked, dim, scale, primes)
            lists = asked.column("positives").combine_chunks()
            most = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
            # window j of an anchor holds the scores that its j-th positive allows
            floor, roof = np.full((most, len(ids)), _MOST), np.full((most, len(ids)), _LEAST)
            for slot, found in enumerate(lists.to_pylist()):
                for j, one in enumerate(found):
                    floor[j, slot], roof[j, slot] = -(-low * one["positive_score"] // 100), high * one["positive_score"] // 100
            best = [Best(len(ids), k, floor[j]) for j in range(most)]
            for some, scores, same, other, row_ids in _scored(batches, residue, labels, ids, dim, scale, primes):
                apart = other & ~same
                for j in range(most):
                    slot, row = np.nonzero(apart & (scores >= best[j].floor[some, None]) & (scores <= roof[j, some, None]))
                    best[j].add(slot + some.start, scores[slot, row], row_ids[row])
            slots = asked.column("slot").to_numpy()
            for j in range(most):
                best[j].choose()
                slot, score, row = best[j].held
                yield pa.RecordBatch.from_arrays([pa.array(slots[slot]), pa.array(np.full(len(slot), j + 1, np.int32)), pa.array(row), pa.array(score)], ["slot", "place", "negative_id", "negative_score"])

        return run

    return task


def _first(rows: DataFrame, group: list[str], score: str, id_col: str, k: int, out: str) -> DataFrame:
    """The ``k`` best rows of each group, which has at most ``k`` rows from each task."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(id_col))
    return rows.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``; a score is the integer inner product
    of two rows.  An anchor's positives are the ``positives`` best other rows of
    its label.  For each of them, the ``negatives`` best rows of another label
    come out whose score is between ``low`` and ``high`` percent of the
    positive's score; equal scores go by the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite
    component take no part.  A row is another row if its id differs; rows that
    repeat an id are all kept, and each repeated anchor has rows of its own.  A
    vector shorter than another counts as if it ended in zeros.  An empty table,
    or one without anchors, gives no rows.  Scores beyond 64 bits raise.

    Every task holds one block of anchors (``BLOCK_BYTES``) and gives its best
    rows of each; a block meets the rows in one scan without shuffling them.
    """
    taking = usable(vectors, id_col, vec_col, F.col(label) if isinstance(label, str) else label, is_anchor)
    rows = taking.drop("asks")
    anchors = stage(taking.where("asks").drop("asks").withColumn("slot", F.monotonically_increasing_id()), "anchors")
    size = rows.select("vec").mapInArrow(_measure(scale), "square double, dim int").agg(F.max("square"), F.max("dim")).first()
    dim = size[1] or 1
    bound = math.ceil((size[0] or 0.0) * (1 + 1e-9)) + 1 if math.isfinite(size[0] or 0.0) else _MOST
    if bound >= _MOST // 100:
        raise ValueError("scores do not fit into 64 bits; use a smaller scale")
    primes = primes_for(bound)
    each = dim * len(primes) + 8 * dim + 24 * positives * negatives
    blocks = max(1, math.ceil(anchors.count() * each / BLOCK_BYTES))
    numbered = anchors.withColumn("block", F.pmod(F.xxhash64("slot"), F.lit(blocks)).cast("int"))
    near = _in_blocks(rows, numbered, blocks, _positives(positives, dim, scale, primes), "slot long, positive_id long, positive_score long")
    near = stage(_first(near, ["slot"], "positive_score", "positive_id", positives, "place").select("slot", F.struct("place", "positive_id", "positive_score").alias("one")), "positives")
    listed = near.groupBy("slot").agg(F.sort_array(F.collect_list("one")).alias("positives"))
    asked = stage(numbered.join(listed, "slot"), "asked")
    far = _in_blocks(rows, asked, blocks, _negatives(negatives, dim, scale, primes, low, high), "slot long, place int, negative_id long, negative_score long")
    best = _first(far, ["slot", "place"], "negative_score", "negative_id", negatives, "rank")
    pairs = asked.select("slot", F.col("id").alias("anchor_id"), F.inline("positives"))
    return best.join(pairs, ["slot", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

