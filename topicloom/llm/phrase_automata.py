"""Repeated passages: confirmed by hash, located by sharded Aho-Corasick automata.

1. Every window of ``window`` words picks the least hashed run of ``GRAM``
   words in it (winnowing).  Equal windows pick equal runs, so only windows
   whose run occurs in two texts can recur; a few per cent of all positions
   are shuffled to find these runs.
2. The windows around such runs are hashed; those that start in two texts are
   confirmed, and the earliest text of each owns it.  Neighbouring windows of
   one owner are its passages; where else they occur is not known yet.
3. Passages are cut into phrases of half a window.  Whatever recurs holds at
   least one whole phrase, so automata over the phrases find every occurrence.
   Passages belong to the shard of the run that their windows pick.  Every text
   is streamed through the shards of the runs it picks, as far as a confirmed
   window has such a run; a text without one holds no passage.  Each hit is
   extended word by word in both directions, and counts for an earlier owner.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import WordHasher, chunks, rolled, small, split_words, text_keys
from topicloom.staging import stage

WINDOW = 50
GRAM = 10
#: Confirmed windows whose passages make a shard, on average.
SHARD_WINDOWS = 100_000
#: Text of passages in one automaton; a shard with more is split, and its texts meet each part.
PASSAGE_BYTES = 4 * 1024 * 1024
#: Text streamed through one automaton; a shard with more is searched by several tasks.
SEARCH_BYTES = 8 * 1024 * 1024
#: A phrase that stands in more places has its passage chosen by the window around it.
PLACES = 4


def _anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The picked run of each window of one text."""
    runs = rolled(hashes, GRAM)
    width = window - GRAM + 1
    return sliding_window_view(runs, width).min(axis=1) if len(runs) >= width else np.empty(0, np.uint64)


def _each_text(batches: Iterator[pa.RecordBatch]):
    """``(node, words, hashes)`` of each text of the batches."""
    hasher = WordHasher()
    for batch in batches:
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        for start, _, texts in chunks(batch):
            words, sizes = split_words(texts)
            hashes = hasher.hash(words)
            ends = np.cumsum(sizes)
            for k, (end, n) in enumerate(zip(ends, sizes)):
                yield nodes[start + k], words, hashes, end - n, end


def _pick(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = [], []
        for node, _, hashes, a, b in _each_text(batches):
            picked = _anchors(hashes[a:b], window)
            if len(picked):
                picked = np.unique(picked)
                held.append(picked)
                names.append(np.full(len(picked), node))
            if len(held) >= 2000:
                yield _columns(["gram", "node"], np.concatenate(held).view(np.int64), np.concatenate(names))
                held, names = [], []
        if held:
            yield _columns(["gram", "node"], np.concatenate(held).view(np.int64), np.concatenate(names))

    return run


def _columns(names: list[str], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names)


def _windows(window: int):
    """Hashes and places of the windows of each text that hold a recurring run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            ids = batch.column("first_id").to_numpy()
            at = {k: i for i, k in enumerate(batch.column("node").to_pylist())}
            held, names, places, firsts, runs = [], [], [], [], []
            for node, _, hashes, a, b in _each_text(iter([batch])):
                wanted = np.array(grams[at[node]].as_py(), np.int64).view(np.uint64)
                picked = _anchors(hashes[a:b], window)
                start = np.flatnonzero(np.isin(picked, wanted))
                if len(start):
                    held.append(rolled(hashes[a:b], window)[start])
                    names.append(np.full(len(start), node))
                    places.append(start)
                    firsts.append(np.full(len(start), ids[at[node]]))
                    runs.append(picked[start])
            if held:
                yield _columns(
                    ["hash", "node", "start", "first_id", "gram"],
                    np.concatenate(held).view(np.int64), np.concatenate(names), np.concatenate(places).astype(np.int32), np.concatenate(firsts), np.concatenate(runs).view(np.int64),
                )

    return run


def _pieces(window: int, shards: int):
    """By shard: the passages that a text owns, and its stretches of windows that pick a confirmed run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {k: i for i, k in enumerate(batch.column("node").to_pylist())}
            first = batch.column("first_id").to_pylist()
            rows: list[tuple[int, bool, int, int, int, bytes]] = []
            for node, words, hashes, a, b in _each_text(iter([batch])):
                i = at[node]
                picked = _anchors(hashes[a:b], window)
                search = np.isin(picked, np.array(batch.column("grams")[i].as_py(), np.int64).view(np.uint64))
                parts = picked.view(np.int64) % shards
                for c in batch.column("passages")[i].as_py() or ():
                    rows.append((c["owner"], True, node, first[i], c["low"], b" ".join(words[a + c["low"] : a + c["high"]])))
                    # what a text owns stands in no earlier one
                    search[c["low"] : c["high"] - window + 1] = False
                starts = np.flatnonzero(search)
                if not len(starts):
                    continue
                new = np.flatnonzero((np.diff(starts) != 1) | (np.diff(parts[starts]) != 0)) + 1
                for stretch in np.split(starts, new):
                    low, high = int(stretch[0]), int(stretch[-1]) + window
                    rows.append((int(parts[low]), False, node, first[i], low, b" ".join(words[a + low : a + high])))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "own", "node", "first_id", "low", "words"])

    return run


class Automaton:
    """Phrases of the passages of a shard, and where each stands."""

    def __init__(self, window: int):
        self.window = window
        self.phrase = max(1, window // 2)
        #: words of each passage, and the least id of the text that owns it
        self.passages: list[tuple[int, list[int]]] = []
        self.found: dict[tuple, list[tuple[int, int]]] = {}
        self.codes: dict[bytes, int] = {}
        #: passage and place of the windows around phrases with many places; a confirmed window has one owner
        self.around: dict[int, tuple[int, int]] = {}
        self.tree = None

    def add(self, first_id: int, words: bytes) -> None:
        own = [self.codes.setdefault(w, len(self.codes)) for w in words.split()]
        for at in range(0, len(own) - self.phrase + 1, self.phrase):
            self.found.setdefault(tuple(own[at : at + self.phrase]), []).append((len(self.passages), at))
        self.passages.append((first_id, own))

    def compile(self) -> None:
        if not self.found:
            return
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, where in self.found.items():
            if len(where) > PLACES:
                for number, at in where:
                    own = self.passages[number][1]
                    for low in range(max(0, at + self.phrase - self.window), min(at, len(own) - self.window) + 1):
                        self.around[hash(tuple(own[low : low + self.window]))] = (number, low)
            self.tree.add_word(key, where)
        self.tree.make_automaton()

    def locate(self, first_id: int, words: bytes) -> Iterator[tuple[int, int]]:
        """Stretches of at least a window that also stand in a passage of a text with a smaller id."""
        if self.tree is None:
            return
        unknown = len(self.codes)
        own = tuple(self.codes.get(w, unknown) for w in words.split())
        done: dict[tuple[int, int], int] = {}
        looked = 0
        for end, where in self.tree.iter(own):
            start = end - self.phrase + 1
            if len(where) > PLACES:
                last = min(start, len(own) - self.window)
                yield from self._chosen(own, first_id, max(looked, end + 1 - self.window), last)
                looked = max(looked, last + 1)
                continue
            for number, at in where:
                owner, other = self.passages[number]
                line = (number, start - at)
                if owner >= first_id or done.get(line, -1) >= end:
                    continue
                low, high, shift = start, end + 1, at - start
                while low and low + shift and own[low - 1] == other[low - 1 + shift]:
                    low -= 1
                while high < len(own) and high + shift < len(other) and own[high] == other[high + shift]:
                    high += 1
                done[line] = high - 1
                if high - low >= self.window:
                    yield low, high


    def _chosen(self, own: tuple, first_id: int, low: int, last: int) -> Iterator[tuple[int, int]]:
        """Windows that start in ``low`` to ``last`` and stand in the one passage that has them."""
        begin = None
        for at in range(low, last + 1):
            here = own[at : at + self.window]
            number, place = self.around.get(hash(here), (-1, 0))
            owner, other = self.passages[number]
            same = number >= 0 and owner < first_id and tuple(other[place : place + self.window]) == here
            if same and begin is None:
                begin = at
            elif not same and begin is not None:
                yield begin, at - 1 + self.window
                begin = None
        if begin is not None:
            yield begin, last + self.window


def _locate(window: int):
    """Runs over rows sorted by ``(slot, own desc)``: first the passages of a slot, then the stretches to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, machine = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("slot", "own", "node", "first_id", "low", "words")]
            found: set[tuple[int, int, int]] = set()
            for s, own, node, first_id, low, words in zip(*columns):
                if s != slot:
                    slot, machine = s, Automaton(window)
                if own:
                    machine.add(first_id, words)
                    continue
                if machine.tree is None:
                    machine.compile()
                found.update((node, low + a, low + b) for a, b in machine.locate(first_id, words))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["node", "low", "high"])

    return run


def _runs(windows: DataFrame, window: int) -> DataFrame:
    """Stretches of neighbouring windows of one text with one owner: ``(node, owner, low, high)``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            node, owner, start = (batch.column(c).to_numpy() for c in ("node", "owner", "start"))
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            rows = [(int(node[i]), int(owner[i]), int(start[i]), int(start[j - 1])) for i, j in zip(at, np.append(at[1:], len(node)))]
            if open_ is not None and rows and rows[0][:2] == open_[:2] and rows[0][2] == open_[3] + 1:
                rows[0] = (*open_[:3], rows[0][3])
            elif open_ is not None:
                rows.insert(0, open_)
            open_ = rows.pop() if rows else open_
            yield whole(rows)
        if open_ is not None:
            yield whole([open_])

    def whole(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))] + [pa.array([r[3] + window for r in rows], pa.int32())],
            ["node", "owner", "low", "high"],
        )

    dealt = windows.repartition("node").sortWithinPartitions("node", "start")
    return dealt.select("node", "owner", "start").mapInArrow(fold, "node long, owner long, low int, high int")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(texts, ranges)``: what to remove from each distinct text.

    ``texts`` has ``(node, _h1, _h2, first_id)``, one row per distinct text
    with the least id it has; ``ranges`` has ``(node, low, high)``, word ranges
    of that text whose windows also start in a text with a smaller least id.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = plain.select("doc_id", "text", *text_keys(F.col("text")))
    texts = stage(keyed.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).select(F.col("_h1").alias("node"), "_h1", "_h2", "first_id", "n"), "texts")
    named = keyed.select(F.col("_h1").alias("node"), "text")
    # copies pick the same runs, which the distinct folds before the shuffle's end
    picks = stage(named.mapInArrow(_pick(window), "gram long, node long"), "picks")
    often = picks.groupBy("gram").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b").select("gram")
    # runs wanted of each text; its other windows cannot recur
    wanted = picks.join(small(stage(often, "grams")), "gram").groupBy("node").agg(F.collect_set("gram").alias("grams"))
    wanted = stage(wanted, "wanted")
    once = wanted.join(texts.groupBy("node").agg(F.min("first_id").alias("first_id")), "node").where("first_id is not null")
    held = keyed.select(F.col("_h1").alias("_n"), F.col("doc_id").alias("_d"), "text")
    # the row with the least id stands for its copies; repeated rows are dropped by their key
    chosen = once.join(held, (F.col("node") == F.col("_n")) & (F.col("first_id") == F.col("_d"))).select("node", "first_id", "grams", "text")
    chosen = stage(chosen.dropDuplicates(["node"]), "chosen")
    windows = "hash long, node long, start int, first_id long, gram long"
    ordered = stage(chosen.mapInArrow(_windows(window), windows), "windows")
    owners = ordered.groupBy("hash").agg(F.min(F.struct("first_id", "node", "start", "gram")).alias("_own"), F.max("node").alias("_b"), F.min("node").alias("_a"))
    owners = stage(owners.where("_a <> _b").select("_own.node", "_own.start", "_own.gram"), "owners")
    shards = max(1, -(-owners.count() // SHARD_WINDOWS))
    runs = _runs(owners.select("node", F.pmod("gram", F.lit(shards)).cast("long").alias("owner"), "start"), window)
    passages = runs.groupBy(F.col("node").alias("_p")).agg(F.collect_list(F.struct("owner", "low", "high")).alias("passages"))
    confirmed = stage(owners.select(F.col("gram").alias("_gram")).distinct(), "confirmed")
    routed = wanted.select("node", F.explode("grams").alias("gram")).join(small(confirmed), F.col("gram") == F.col("_gram"))
    routed = routed.groupBy(F.col("node").alias("_r")).agg(F.collect_list("gram").alias("grams"))
    routed = stage(routed.join(passages, F.col("_r") == F.col("_p"), "left").select("_r", "grams", "passages"), "routed")
    streamed = chosen.drop("grams").join(routed, F.col("node") == F.col("_r")).select("node", "first_id", "text", "grams", "passages")
    kinds = "shard long, own boolean, node long, first_id long, low int, words binary"
    pieces = stage(streamed.mapInArrow(_pieces(window, shards), kinds), "pieces")
    # a shard is a grid of parts of its passages against parts of the stretches; nearly all are one by one
    size = F.octet_length("words")
    parts = lambda kept, limit: F.greatest(F.ceil(F.coalesce(F.sum(F.when(kept, size)), F.lit(0)) / limit), F.lit(1)).cast("int")
    grid = stage(pieces.groupBy(F.col("shard").alias("_s")).agg(parts(F.col("own"), PASSAGE_BYTES).alias("_down"), parts(~F.col("own"), SEARCH_BYTES).alias("_across")), "grid")
    split = pieces.join(small(grid), F.col("shard") == F.col("_s"))
    place = lambda count: F.pmod(F.xxhash64("node", "low"), F.col(count)).cast("int")
    down = F.when(F.col("own"), F.array(place("_down"))).otherwise(F.sequence(F.lit(0), F.col("_down") - 1))
    across = F.when(F.col("own"), F.sequence(F.lit(0), F.col("_across") - 1)).otherwise(F.array(place("_across")))
    split = split.withColumn("_i", F.explode(down)).withColumn("_j", F.explode(across))
    sent = split.select(F.xxhash64("shard", "_i", "_j").alias("slot"), "own", "node", "first_id", "low", "words")
    sent = sent.repartition("slot").sortWithinPartitions("slot", F.col("own").desc())
    ranges = sent.mapInArrow(_locate(window), "node long, low int, high int")
    return texts, stage(ranges, "ranges")


def _strip(window: int):
    """Counts and kept words of each row, all words of a later copy being repeated."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, copy = batch.column("ranges"), batch.column("copy").to_pylist()
            n_words, n_removed, digest, kept = [], [], [], []
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = text.split()
                n = len(words)
                if copy[k] and n >= window:
                    left = []
                else:
                    mark = np.zeros(n + 1, np.int32)
                    for r in ranges[k].as_py() or ():
                        mark[r["low"]] += 1
                        mark[r["high"]] -= 1
                    gone = np.cumsum(mark)[:n] > 0
                    left = [w for w, g in zip(words, gone) if not g] if gone.any() else words
                clean = b" ".join(left)
                n_words.append(n), n_removed.append(n - len(left)), digest.append(hashlib.sha256(clean).hexdigest())
                kept.append(clean if len(left) < n else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)``: one row per input row.

    A word goes if a window of ``window`` words around it also starts in a
    document with a smaller id, judged on the input.  ``kept_sha256`` is the
    digest of the kept words joined by one space; ``kept`` is that text, or the
    text as it was if nothing went.

    Equal texts are one text with their least id: of its copies, all words go
    wherever there is a window at all, except in rows with that least id.  Null
    texts have no words.  A row with a null id is a later copy of an equal text
    that has an id; a text that only null ids hold is left alone and takes
    nothing from others.  Rows that share an id and a
    text are treated alike; of two texts with one id neither takes from the
    other.  An empty table gives no rows.
    """
    texts, ranges = repeated_ranges(docs, id_col, text_col, window)
    gone = ranges.groupBy(F.col("node").alias("_node")).agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = plain.select("doc_id", "text", *text_keys(F.col("text")))
    facts = texts.select("_h1", "_h2", "first_id", "node", "n").join(gone, F.col("node") == F.col("_node"), "left")
    # texts that stand once and repeat nothing need no facts
    facts = stage(facts.where("n > 1 or ranges is not null").select(F.col("_h1").alias("_f1"), F.col("_h2").alias("_f2"), "first_id", "ranges"), "facts")
    joined = keyed.join(facts, (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2")), "left")
    copy = (F.col("first_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    return joined.select("doc_id", "text", copy.alias("copy"), "ranges").mapInArrow(
        _strip(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
