"""Benchmark items inside documents, found by size-partitioned MinHash and verified exactly.

A short item and a long document have a tiny Jaccard similarity, however fully
the item is contained.  Items are therefore partitioned by size (powers of two
of their shingles), and for each size class a document is read as overlapping
windows of twice that size, so that the window around a contained item is
similar to it.  A coordinate of the MinHash of a window is the minimum of two
neighbouring blocks, and blocks of a class are merged from the class below, so
one pass over the shingles serves all classes.  An item and a window with an
equal coordinate are a candidate; it counts if the document holds the wanted
share of the item's distinct shingles, which is checked exactly.

Items with fewer distinct shingles than a quarter of their window, very short or
full of repeats, would be too unlike the window.  They are looked up by their
shingles themselves, as many as cannot all be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import WordHasher, chunks, mixed, packed, row_id, shingles

COORDINATES = 32
SMALLEST = 8
#: Items searched in one pass over the documents; more items take more passes.
ITEM_BLOCK = 20_000
ITEM_BYTES = 64 * 1024 * 1024


def _mask(count: int) -> np.ndarray:
    """Odd multipliers, one per coordinate."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)


def _block_minima(values: np.ndarray, width: int, multipliers: np.ndarray) -> np.ndarray:
    """``(blocks, coordinates)`` minima of neighbouring runs of ``width`` values, the last one shorter."""
    starts = np.arange(0, len(values), width)
    out = np.empty((len(starts), len(multipliers)), np.uint64)
    for j, a in enumerate(multipliers):
        out[:, j] = np.minimum.reduceat(values * a, starts)
    return out


def _sorted(values: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in order, the item of each, and the low bits that occur among them."""
    order = np.argsort(values)
    seen = np.zeros(1 << 22, bool)
    seen[(values & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    return values[order], item[order], seen


def _met(table: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    """The items of each of the values that the table has."""
    flat, item, seen = table
    values = values[seen[(values & np.uint64((1 << 22) - 1)).astype(np.int64)]]
    if not len(values):
        return []
    values = np.unique(values)
    low, high = np.searchsorted(flat, values, "left"), np.searchsorted(flat, values, "right")
    return [item[a:b] for a, b in zip(low, high) if b > a]


class Items:
    """The coordinates and shingles of a block of items, as a task searches them."""

    def __init__(self, rows: list[tuple[int | None, bytes]], coordinates: int, threshold: float):
        hasher = WordHasher()
        names, owner = shingles([t for _, t in rows], hasher, 5)
        words = np.array([len(t.split()) for _, t in rows], np.int64)
        fit = words[owner] >= 5
        names, owner = names[fit], owner[fit]
        order = np.lexsort((names, owner))
        names, owner = names[order], owner[order]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        self.names, self.owner = names[new], owner[new]
        self.ids = np.array([i or 0 for i, _ in rows], np.int64)
        self.unnamed = np.array([i is None for i, _ in rows], bool)
        self.sizes = np.bincount(self.owner, minlength=len(rows))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        # a window must hold an item with the shingles of its whole span, repeats included
        span = np.maximum(words - 4, 1)
        self.level = np.maximum(0, np.ceil(np.log2(np.maximum(span, 1) / SMALLEST))).astype(np.int64)
        self.multipliers = _mask(coordinates)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        few = self.sizes * 4 < 2 * SMALLEST * 2**self.level
        # a document with the wanted share has one of any so many shingles
        need = np.minimum(np.maximum(1, self.sizes - np.ceil(threshold * self.sizes - 1e-9).astype(np.int64) + 1), self.sizes)
        turn = np.arange(len(self.names)) - self.starts[self.owner]
        asked = few[self.owner] & (turn < need[self.owner])
        self.exact = _sorted(self.names[asked], self.owner[asked])
        for level in np.unique(self.level[(self.sizes > 0) & ~few]):
            own = np.flatnonzero((self.level == level) & (self.sizes > 0) & ~few)
            values = np.stack([(self.names[self.starts[i] : self.starts[i + 1], None] * self.multipliers).min(axis=0) for i in own])
            values = values ^ mixed(np.arange(coordinates, dtype=np.uint64))
            self.tables[int(level)] = _sorted(values.ravel(), np.repeat(own, coordinates))
        self.salt = mixed(np.arange(coordinates, dtype=np.uint64))

    def candidates(self, names: np.ndarray) -> np.ndarray:
        """Items with a coordinate in common with some window of a document's shingles, or looked up by one of them."""
        found = _met(self.exact, names) if len(self.exact[0]) else []
        minima = _block_minima(names, SMALLEST, self.multipliers) if self.tables else None
        for level in range(max(self.tables, default=-1) + 1):
            if level:
                even = minima[0::2]
                odd = minima[1::2]
                minima = even.copy()
                minima[: len(odd)] = np.minimum(even[: len(odd)], odd)
            if level in self.tables:
                window = minima.copy()
                window[:-1] = np.minimum(minima[:-1], minima[1:])
                found += _met(self.tables[level], (window ^ self.salt).ravel())
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _search(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            at, found, held, sizes = [], [], [], []
            for start, _, texts in chunks(batch):
                names, owner = shingles(texts, hasher)
                border = np.searchsorted(owner, np.arange(len(texts) + 1))
                for k in range(len(texts)):
                    own = names[border[k] : border[k + 1]]
                    if not len(own):
                        continue
                    candidates = items.candidates(own)
                    if not len(candidates):
                        continue
                    distinct = np.unique(own)
                    for i in candidates:
                        wanted = items.names[items.starts[i] : items.starts[i + 1]]
                        place = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
                        inside = int((distinct[place] == wanted).sum())
                        if inside >= threshold * len(wanted) - 1e-9:
                            at.append(start + k), found.append(i), held.append(inside), sizes.append(len(wanted))
            found = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items.ids[found], pa.int64(), mask=items.unnamed[found]), pa.array(held, pa.int64()), pa.array(sizes, pa.int64())],
                ["doc_id", "item_id", "n_found", "n_shingles"],
            )

    return run


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
    coordinates: int = COORDINATES,
    block: int = ITEM_BLOCK,
) -> DataFrame:
    """``(doc_id, item_id, n_found, n_shingles, containment)`` of each item that a document contains.

    Containment is the share of the item's distinct shingles (five words) that
    the document has, ``threshold`` or more.  Items are the stated query set:
    they are read in blocks of at most ``block`` rows and 64 MB of text, each
    block sent to all tasks and searched in one pass over the documents, which
    are never shuffled.  For 32 coordinates, a window misses a wholly contained
    item with a probability of 1e-4 at most and one at 0.8 with at most 1.2e-3.
    Items with fewer distinct shingles than a quarter of their window are never
    missed.

    Items under five words, empty or null have no shingle and are never found;
    null or empty documents contain nothing.  Items with equal texts are all
    found; of rows with the same item id each counts; a null item id stays null.
    Repeated document rows give repeated result rows.
    """
    spark = docs.sparkSession
    plain = docs.select(row_id(id_col), F.col(text_col).alias("text")).where("text is not null")
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long, n_found long, n_shingles long")
    for rows in _item_blocks(wanted, block):
        found = plain.mapInArrow(_search(Items(rows, coordinates, threshold), threshold), "doc_id long, item_id long, n_found long, n_shingles long")
        out = found if out.isLocal() else out.union(found)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def _item_blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks bounded in rows and bytes, in a fixed order."""
    held, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = row["text"].encode()
        if held and (len(held) >= block or size + len(text) > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.

    A row is judged by its text, so rows with a null or repeated id are safe.
    """
    key, text = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.col(text_col)
    asked = docs.select(key.alias("key"), text.alias("text"))
    hit = contained_items(asked, items, "key", "text", **settings).select(F.col("doc_id").alias("hit")).distinct()
    return packed(docs, key=key).join(hit, F.col("key") == F.col("hit"), "left_anti").select("row.*")
