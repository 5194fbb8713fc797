"""Helpers shared by the operators: words, hashes, row chunks, checked broadcasts, ranks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.staging import stage

#: Rows that a side may have to be sent to every task; its size is counted before.
BROADCAST_ROWS = 1_000_000
#: Text handled at once inside a task.
CHUNK_BYTES = 1 << 21
#: Words remembered with their hash inside a task; then the memory starts afresh.
REMEMBERED = 400_000
SHINGLE = 5
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHasher(dict):
    """64-bit hash of each word, computed once per task and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def hash(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A second well spread 64-bit value from a first."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= MIX2
    x ^= x >> np.uint64(32)
    return x


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """``(start, stop, texts)`` of a batch in pieces of about ``limit`` bytes; null texts are empty."""
    column = batch.column(text).cast(pa.binary())
    texts, start, held = [], 0, 0
    for k in range(len(column)):
        value = column[k].as_py() or b""
        texts.append(value)
        held += len(value)
        if held >= limit:
            yield start, k + 1, texts
            texts, start, held = [], k + 1, 0
    if texts:
        yield start, len(column), texts


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in a row, and the number of words of each."""
    words: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.split()
        sizes[k] = len(own)
        words += own
    return words, sizes


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring word hashes."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    last = len(hashes) - k + 1
    out = hashes[:last].copy()
    for j in range(1, k):
        out *= MIX
        out += hashes[j : last + j]
    return mixed(out)


def shingles(texts: list[bytes], hasher: WordHasher, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts in a row, and the text each comes from.

    A text of one to ``k - 1`` words has one shingle, all its words.
    """
    words, sizes = split_words(texts)
    hashes = hasher.hash(words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = rolled(hashes, k)
    whole = owner[: len(out)] == owner[k - 1 :] if len(out) else np.empty(0, bool)
    out, owner = out[whole], owner[: len(whole)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        ends = np.cumsum(sizes)
        extra = np.array([xxhash.xxh3_64_intdigest(hashes[ends[i] - sizes[i] : ends[i]].tobytes()) for i in short], np.uint64)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def row_id(id_col: str) -> Column:
    """The id as a long, as the tasks expect it; an id that is no whole number raises."""
    return F.col(id_col).cast("long").alias("doc_id")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, beside ``keys``, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[key.alias(name) for name, key in keys.items()])


def row_order(docs: DataFrame) -> list[Column]:
    """Two hashes of all columns, which tell rows apart that share id and text; maps count by their entries."""
    columns = [F.map_entries(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return [F.xxhash64(*columns), F.xxhash64(*columns, F.lit("second"))]


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text in shuffles."""
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit("second")).alias("_h2")]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` narrow rows; else as it is, for a shuffle join.

    ``df`` should be a staged table, whose count is read from its footers.
    """
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, label: str, chunks_per_group: int | None = None) -> DataFrame:
    """Add ``name`` = 0.. within each group in an order that depends only on the rows.

    Rows are dealt to chunks of their group by the hash of the order columns;
    a row's rank is its place in its chunk plus the rows of the chunks before.
    No window spans a whole group, so a group may hold any share of the rows.
    """
    spark = df.sparkSession
    parts = chunks_per_group or 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = stage(df.withColumn("_chunk", F.pmod(F.xxhash64(*order, F.lit(label)), F.lit(parts))), label)
    own = Window.partitionBy(*group, "_chunk").orderBy(*order)
    sizes = dealt.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_chunk") == F.col("_c")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(offsets, same)
        .withColumn(name, F.col("_offset") + F.col("_own"))
        .drop("_chunk", "_own", "_offset", "_c", *[f"_g_{g}" for g in group])
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(id, root)``: each end of an edge ``(a, b)`` with the least id it is connected to.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a
    minimum per node and a join, until the edges no longer change; every step
    is a written table.  Only counts reach the driver.
    """
    pairs = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    before = _mark(pairs)
    while before[0]:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        pairs = stage(
            joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(),
            label,
        )
        now = _mark(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


