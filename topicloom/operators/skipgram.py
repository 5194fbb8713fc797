"""Skip-gram word vectors with a Huffman tree (hierarchical softmax), learned by numpy in Spark tasks.

Every word is a leaf of a Huffman tree of the counts; an inner node holds a
vector, and a word's chance beside a context word is the product of the turns
on its path.  A step takes a run of tokens and adds up the slopes of all its
pairs.  The ``TOP`` commonest nodes, which lie on most paths, meet the
different words of the run as one matrix product; the other nodes meet all
contexts of a word at once.  Steps are those of Adagrad by rows,
so that a row met by many pairs of a run does not overshoot.

Each task learns from all its texts from the same start; a word's vector is
the mean over the tasks that met it beside another word.
"""

from __future__ import annotations

import hashlib
import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.staging import stage

WINDOW = 5
#: Rate of the first step, which falls in a line to almost none, and what a row's squares begin with.
RATE = 0.4
FIRST_SUM = 1.0
#: Words of a text that are learned as one run; windows do not cross its ends.
SENTENCE = 1000
#: Tokens coded together into one row.
CHUNK = 250_000
#: Tokens of a step; few texts take smaller steps, so that there are some hundred of them.
STEP_TOKENS = (256, 16384)
STEPS = 256
TOP = 128
#: Numbers of a table of slopes that is worked on at once.
CELLS = 60_000
#: Rows of a place that are added one after the other; what lies beyond is added at once.
ROUNDS = 16
#: Contexts of the words that are worked on together, at most; more go together with the most.
SIZES = [2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096]
ROWS_OUT = 50_000
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: One call at a time changes the session's batches, so that each puts back what was there.
_BATCHES = threading.Lock()
CODED = "mark bigint, words array<string>, counts array<bigint>, places array<int>, lengths array<int>"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of texts: their different words and counts, each token's place among them, and tokens per text."""
    for batch in batches:
        lists = batch.column("words")
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends, row = lists.flatten(), np.cumsum(lengths), 0
        while row < len(lengths):
            first = int(ends[row] - lengths[row])
            last = max(row + 1, int(np.searchsorted(ends, first + CHUNK, side="right")))
            held = flat.slice(first, int(ends[last - 1]) - first).dictionary_encode()
            places, words = held.indices.to_numpy(), held.dictionary
            if len(places):
                mark = hashlib.blake2b(places.tobytes(), digest_size=8)
                # lengths and letters of the words; equal runs have equal marks
                mark.update(pc.binary_length(words).to_numpy().tobytes())
                mark.update(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer())
                columns = [words, pa.array(np.bincount(places, minlength=len(words))), pa.array(places, pa.int32()), pa.array(lengths[row:last], pa.int32())]
                lists_of = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(mark.digest(), "little", signed=True)]), *lists_of], ["mark", "words", "counts", "places", "lengths"])
            row = last


@dataclass
class Tree:
    """Parent of each word and inner node, and the side it hangs on; nodes by falling weight, 0 is the root (parent -1)."""

    word_parent: np.ndarray
    word_side: np.ndarray
    node_parent: np.ndarray
    node_side: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    """The tree of words with falling counts; the lighter two are joined, leaves before nodes of equal weight."""
    size = len(counts)
    light = [*counts[::-1].tolist(), float("inf")]
    heavy: list[int] = []
    parent, side = [0] * (2 * size - 1), [0] * (2 * size - 1)
    leaf = node = 0
    for made in range(size - 1):
        weight = 0
        for turn in (0, 1):
            if node < len(heavy) and heavy[node] < light[leaf]:
                weight += heavy[node]
                at, node = size + node, node + 1
            else:
                weight += light[leaf]
                at, leaf = leaf, leaf + 1
            parent[at], side[at] = made, turn
        heavy.append(weight)
    above, turns = size - 2 - np.array(parent, np.int32), np.array(side, np.int8)
    above[-1] = -1
    return Tree(above[:size][::-1].copy(), turns[:size][::-1].copy(), above[size:][::-1].copy(), turns[size:][::-1].copy())


def start_rows(at: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """First vectors of words, the same wherever they are worked out (splitmix64 of seed, word and place)."""
    if len(at) > ROWS_OUT:
        rows = np.empty((len(at), dim), np.float32)
        for start in range(0, len(at), ROWS_OUT):
            rows[start : start + ROWS_OUT] = start_rows(at[start : start + ROWS_OUT], dim, seed)
        return rows
    with np.errstate(over="ignore"):
        x = np.uint64(seed) * np.uint64(0xD1342543DE82EF95) + (at.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(1, dim + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)) - np.float32(0.5)) / np.float32(dim)


def _sum_rows(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each place 0 .. ``size`` - 1: first rows of all places, then second ones, and long lists at once."""
    # sixteen bits sort in linear time
    order = np.argsort(at.astype(np.uint16) if size <= 1 << 16 else at, kind="stable")
    counts = np.bincount(at, minlength=size)
    place = np.argsort(-np.minimum(counts, ROUNDS + 1).astype(np.int8), kind="stable")
    sorted_counts = counts[place]
    first = (np.cumsum(counts) - counts)[place]
    sums = np.zeros((size, rows.shape[1]), rows.dtype)
    for turn in range(ROUNDS):
        some = int(np.searchsorted(-np.minimum(sorted_counts, ROUNDS + 1), -turn))
        if not some:
            break
        sums[:some] += rows.take(order[first[:some] + turn], axis=0)
    if many := int(np.searchsorted(-np.minimum(sorted_counts, ROUNDS + 1), -ROUNDS)):
        left = sorted_counts[:many] - ROUNDS
        sums[:many] += np.add.reduceat(rows.take(order[_ranges(first[:many] + ROUNDS, left)], axis=0), np.cumsum(left) - left, axis=0)
    total = np.empty_like(sums)
    total[place] = sums
    return total


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + lengths[i] - 1`` of all i in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)


class Trainer:
    def __init__(self, tree: Tree, dim: int, seed: int, task: int = 0, top: int = TOP):
        self.words, self.dim = len(tree.word_parent), dim
        self.random = np.random.default_rng([seed, task])
        self.word_rows = start_rows(np.arange(self.words), dim, seed)
        self.node_rows = np.zeros((max(0, self.words - 1), dim), np.float32)
        self.top = top = min(top, self.words - 1)
        self.met = np.zeros(self.words, bool)
        self.word_sums, self.node_sums = (np.full(self.words, FIRST_SUM, np.float32) for _ in range(2))
        self.number = np.empty(self.words, np.int32)
        # edges that leave the top, numbered, and the two places below each node of the top: a node or ``top`` + edge
        below = np.full((top, 2), -1)
        inner = np.arange(1, top)
        below[tree.node_parent[inner], tree.node_side[inner]] = inner
        edges = np.flatnonzero(below.ravel() < 0)
        below.ravel()[edges] = top + np.arange(len(edges))
        self.below, self.edges = below, len(edges)
        # climb from all words at once until the top is reached; what is passed is the deep part of the path
        at, turn = tree.word_parent.astype(np.int64), tree.word_side.astype(np.int64)
        deep = np.zeros(self.words, np.int64)
        while (low := at >= top).any():
            deep += low
            turn, at = np.where(low, tree.node_side[at], turn), np.where(low, tree.node_parent[at], at)
        self.edge = (below[at, turn] - top).astype(np.int32)
        self.deep, self.first = deep.astype(np.int32), np.cumsum(deep) - deep
        #: of each node of the deep part of a path, from the word up: twice the node, and the turn
        self.path = np.empty(deep.sum(), np.int32)
        at, turn = tree.word_parent.astype(np.int64), tree.word_side
        climbing = np.arange(self.words)
        step = 0
        while len(climbing := climbing[at[climbing] >= top]):
            own = at[climbing]
            self.path[self.first[climbing] + step] = 2 * own + turn[climbing]
            at[climbing], step = tree.node_parent[own], step + 1
            turn = turn.copy()
            turn[climbing] = tree.node_side[own]

    def step(self, words: np.ndarray, before: np.ndarray, after: np.ndarray, rate: float) -> None:
        """Learn from a run of tokens; each has so many tokens of its own text before and after it in the run."""
        reach = self.random.integers(1, WINDOW + 1, len(words))
        left, right = np.minimum(reach, before), np.minimum(reach, after)
        own, place = np.unique(words, return_inverse=True)
        held = self.word_rows.take(own, axis=0)
        # all slopes are taken at the rows from before the step
        top, d_held, d_top = self._top(place, words, left, right, held)
        node, d_node = self._deep(own, place, left, right, held, d_held)
        self._move(self.word_rows, self.word_sums, own, d_held, rate)
        self._move(self.node_rows, self.node_sums, top, d_top, rate)
        self._move(self.node_rows, self.node_sums, node, d_node, rate)
        self.met[words[(before > 0) | (after > 0)]] = True

    def _move(self, rows: np.ndarray, sums: np.ndarray, at: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """Adagrad by rows: a row's step is its slope by the root of the mean squares of its slopes so far."""
        squares = sums.take(at) + np.einsum("ij,ij->i", slope, slope) / np.float32(self.dim)
        sums[at] = squares
        slope *= (np.float32(rate) / np.sqrt(squares))[:, None]
        slope += rows.take(at, axis=0)
        rows[at] = slope

    def _top(self, place, words, left, right, held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of the top against the different words: pairs are counted by edge and word, and added up towards the root."""
        edge, size, top = self.edge[words] * len(held), len(held), self.top
        keys = [edge[t] + place[t + k] for k in range(1, WINDOW + 1) for t in [np.flatnonzero(right >= k)]]
        keys += [edge[t] + place[t - k] for k in range(1, WINDOW + 1) for t in [np.flatnonzero(left >= k)]]
        pairs = np.empty((top + self.edges, size), np.float32)
        pairs[top:] = np.bincount(np.concatenate(keys), minlength=self.edges * size).reshape(self.edges, size)
        for node in range(top - 1, -1, -1):
            np.add(pairs[self.below[node, 0]], pairs[self.below[node, 1]], out=pairs[node])
        rows = self.node_rows[:top]
        wrong = rows @ -held.T
        with np.errstate(over="ignore"):
            np.exp(wrong, out=wrong)
        wrong += 1
        np.divide(pairs[:top], wrong, out=wrong)
        np.subtract(pairs.take(self.below[:, 0], axis=0), wrong, out=wrong)
        return np.arange(top), wrong.T @ rows, wrong @ held

    def _deep(self, own, place, left, right, held, d_held) -> tuple[np.ndarray, np.ndarray]:
        """The other nodes of the paths of the different words against all contexts of each; adds to the words' slopes."""
        dim = self.dim
        lengths = self.deep[own]
        token = np.argsort(place, kind="stable")
        token = token[lengths[place[token]] > 0]
        before, pairs = left[token], left[token] + right[token]
        # contexts, in the order of the words that they are contexts of
        near = _ranges(token - before, pairs)
        target = np.repeat(token, pairs)
        near += near >= target
        near = np.append(place[near], len(own))
        met = np.bincount(place[token], pairs, len(own)).astype(np.int64)
        first = np.cumsum(met) - met
        # nodes of these paths; a node's number is the last of its places, so that its slopes are added up without sorting
        path = self.path.take(_ranges(self.first[own], lengths))
        node, number = path >> 1, np.arange(len(path))
        self.number[node] = number
        nodes = node[self.number[node] == number]
        self.number[nodes] = np.arange(len(nodes))
        # rows, and rows with the other sign for the other turn; rows of zeros are for the gaps
        rows = np.zeros((2, len(nodes) + 1, dim), np.float32)
        rows[0, :-1] = self.node_rows.take(nodes, axis=0)
        np.negative(rows[0], out=rows[1])
        rows = rows.reshape(-1, dim)
        number = np.append(self.number[node] + (path & 1) * (len(nodes) + 1), len(nodes))
        begin = np.cumsum(lengths) - lengths
        seen, d_near, d_path = np.append(held, np.zeros((1, dim), np.float32), axis=0), np.empty((len(near), dim), np.float32), np.zeros((len(number), dim), np.float32)
        # words of about as many nodes and contexts go together
        tall, width = -(-lengths // 4) * 4, np.array(SIZES)[np.searchsorted(SIZES, np.minimum(met, SIZES[-1]))]
        kind = np.where((met > 0) & (lengths > 0), tall * (2 * SIZES[-1]) + width, 0)
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order], prepend=0)).tolist()
        for start, stop in zip(cuts, [*cuts[1:], len(order)]):
            high = int(tall[order[start]])
            most = int(met[order[start:stop]].max())
            level, column = np.arange(high), np.arange(most)
            for at in range(start, stop, max(1, CELLS // (high * most))):
                # few words at once, so that they stay in the cache
                which = order[at : min(stop, at + max(1, CELLS // (high * most)))]
                places = np.where(level < lengths[which, None], begin[which, None] + level, len(path))
                context = np.where(column < met[which, None], first[which, None] + column, len(near) - 1)
                low, far = rows.take(number[places], axis=0), seen.take(near[context], axis=0)
                wrong = np.matmul(low, far.transpose(0, 2, 1))
                with np.errstate(over="ignore"):
                    np.exp(wrong, out=wrong)
                wrong += 1
                np.divide(1, wrong, out=wrong)
                d_path[places] = np.matmul(wrong, far)
                d_near[context] = np.matmul(wrong.transpose(0, 2, 1), low)
        d_held += _sum_rows(d_near[:-1], near[:-1], len(own))
        d_rows = _sum_rows(d_path[:-1], number[:-1], 2 * len(nodes) + 2)
        return nodes, d_rows[: len(nodes)] - d_rows[len(nodes) + 1 : -1]


def runs(words: np.ndarray, lengths: np.ndarray, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of whole sentences, ``tokens`` or somewhat more at once, and how many of its sentence lie before and after each."""
    pieces = -(-lengths // SENTENCE)
    sizes = np.full(pieces.sum(), SENTENCE)
    sizes[np.cumsum(pieces[pieces > 0]) - 1] = (lengths - (pieces - 1) * SENTENCE)[pieces > 0]
    ends = np.cumsum(sizes)
    before = _ranges(np.zeros(len(sizes), np.int64), sizes)
    after = np.repeat(sizes, sizes) - 1 - before
    start = 0
    while start < len(words):
        stop = int(ends[min(len(ends) - 1, np.searchsorted(ends, start + tokens))])
        yield words[start:stop], before[start:stop], after[start:stop]
        start = stop


def _learned(held, dim: int, seed: int):
    """Vectors of the words that a task met beside others."""
    columns = ["at", *(f"v{i}" for i in range(dim))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, done = None, 0.0
        for batch in batches:
            known, parts = held.value
            if len(known) == 1:
                # a single word has no path
                continue
            trainer = trainer or Trainer(Tree(*parts), dim, seed, batch.column("task")[0].as_py())
            total = batch.column("total")[0].as_py()
            tokens = int(np.clip(total / STEPS, *STEP_TOKENS))
            lists = batch.column("words")
            codes = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for row in range(len(batch)):
                places, lengths = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("places", "lengths"))
                words = codes[first[row] : first[row + 1]][places].astype(np.int64)
                kept = words >= 0
                sums = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(lengths)])]
                for some, before, after in runs(words[kept], np.diff(sums), tokens):
                    trainer.step(some, before, after, RATE * max(1e-4, 1 - done / total))
                    # words that are left out count too, as they do in the total
                    done += len(some) * len(words) / sums[-1]
            # else they stay while the next batch is read
            del batch, lists, codes, places, lengths
        if trainer is not None:
            met = np.flatnonzero(trainer.met)
            for start in range(0, len(met), ROWS_OUT):
                at = met[start : start + ROWS_OUT]
                yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, trainer.word_rows[at].T.copy())], columns)

    return run


def _named(held, dim: int, seed: int):
    """Words and vectors by the words' places; a word that no task met beside others keeps its first vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_numpy()
            rows = np.stack([batch.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(dim)], axis=1).astype(np.float32) if len(at) else np.empty((0, dim), np.float32)
            gone = np.isnan(rows[:, 0])
            rows[gone] = start_rows(at[gone], dim, seed)
            yield pa.RecordBatch.from_arrays([held.value[0].take(pa.array(at)), K.vector_array(rows)], ["word", "vec"])

    return run


@contextmanager
def _small_batches(spark) -> Iterator[None]:
    """Runs of texts reach Python few at once; beside the vectors there is little room for more of them."""
    with _BATCHES:
        before = spark.conf.get(BATCH_KEY)
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
        try:
            yield
        finally:
            spark.conf.set(BATCH_KEY, before)


def word_vectors(docs: DataFrame, words: Column, dim: int, seed: int, min_count: int, partitions: int) -> DataFrame:
    """``(word, vec)`` of all words seen ``min_count`` times or more, from all texts; ``words`` lists a text's words.

    The driver holds the words and their counts; a task holds them, and two
    vectors of ``dim`` floats and the path of each.
    """
    spark = docs.sparkSession
    coded = stage(docs.select(words.alias("words")).mapInArrow(_coded, CODED), "coded")
    seen = coded.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    seen = seen.where(F.col("n") >= min_count).toArrow()
    if not seen.num_rows:
        raise ValueError(f"no word occurs {min_count} times or more")
    seen = seen.sort_by([("n", "descending"), ("word", "ascending")])
    counts = seen.column("n").to_numpy()
    tree = huffman(counts)
    held = spark.sparkContext.broadcast((seen.column("word").combine_chunks(), (tree.word_parent, tree.word_side, tree.node_parent, tree.node_side)))
    # runs of texts are dealt out by their size and learned in the order of their marks, so that every call learns alike
    found = coded.select("mark", F.size("places").alias("n")).collect()
    sizes, copies = {r["mark"]: r["n"] for r in found}, Counter(r["mark"] for r in found)
    ranked, totals = sorted(sizes, key=lambda m: (-sizes[m], m)), [0] * partitions
    for rank, mark in enumerate(ranked):
        totals[rank % partitions] += sizes[mark] * copies[mark]
    tasks = spark.createDataFrame([(mark, rank % partitions, totals[rank % partitions]) for rank, mark in enumerate(ranked)], "mark bigint, task int, total bigint")
    texts = coded.drop("counts").join(F.broadcast(tasks), "mark").repartitionById(partitions, F.col("task")).sortWithinPartitions("mark")
    columns = [f"v{i}" for i in range(dim)]
    learned = texts.mapInArrow(_learned(held, dim, seed), "at bigint, " + ", ".join(f"{c} float" for c in columns))
    means = learned.groupBy("at").agg(*(F.avg(c).alias(c) for c in columns))
    every = spark.range(len(counts)).join(means, F.col("id") == F.col("at"), "left").select("id", *columns)
    with _small_batches(spark):
        return stage(every.mapInArrow(_named(held, dim, seed), "word string, vec array<float>"), "vectors")
