"""Near-duplicate documents by DartMinHash signatures (Christiani, 2020) and banding.

Each distinct shingle of a text is an element with a weight.  Darts of unit
density are thrown by hashing into the plane (weight, rank) of every element;
those under the element's weight count, and each signature coordinate keeps
the dart of lowest rank dealt to it.  Two texts agree in a coordinate with a
probability of their weighted Jaccard similarity, and a text of any length
needs only about ``k ln k + 2k`` darts.

Equal band keys make candidates; every link is verified by the exact
similarity.  Copies of a text are one node, so a group of copies of any size
costs one signature row per copy and no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import MIX, SHINGLE, WordHasher, chunks, components, mixed, packed, row_id, row_order, shingles, small, text_keys
from topicloom.staging import stage

BANDS, ROWS = 26, 5
#: Darts handled at once inside a task.
DART_CHUNK = 400_000
#: Rank borders between which darts are thrown together: 0, 1/16, 1/8, 1/4, ...
FIRST_SLAB = 1 / 16
#: Members of a bucket that one task compares with as many others.
BLOCK = 512


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... for an inverse draw."""
    top = int(mean + 12 * math.sqrt(mean) + 12)
    logs = np.array([-mean + n * math.log(mean) - math.lgamma(n + 1) for n in range(top)])
    return np.cumsum(np.exp(logs))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(elements, weights, owner, low: float, high: float, k: int, best: np.ndarray) -> None:
    """Lower ``best[owner, coordinate]`` by the darts with ranks in ``[low, high)`` under the weights."""
    bottom, top = 0.0, 1.0
    while len(elements):
        area = (top - bottom) * (high - low)
        cell = mixed(elements ^ np.uint64((hash((bottom, low)) * int(MIX)) & 0xFFFFFFFFFFFFFFFF))
        count = np.searchsorted(_poisson_steps(area), _unit(cell), side="right")
        hit = np.flatnonzero(count)
        per = max(1, int(DART_CHUNK / max(1.0, area + 1)))
        for at in range(0, len(hit), per):
            rows = hit[at : at + per]
            n = count[rows]
            row = np.repeat(rows, n)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            dart = mixed(cell[row] + (turn.astype(np.uint64) + np.uint64(1)) * MIX)
            if weights is not None:
                under = bottom + _unit(dart) * (top - bottom) < weights[row]
                dart, row = dart[under], row[under]
            spread = mixed(dart + MIX)
            rank = (low + _unit(spread) * (high - low)).astype(np.float32)
            name = mixed(dart ^ MIX)
            value = (rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name >> np.uint64(32))
            slot = owner[row] * k + (name & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            np.minimum.at(best, slot, value)
        if weights is None:
            return
        more = np.flatnonzero(weights > top)
        elements, weights, owner = elements[more], weights[more], owner[more]
        bottom, top = top, 2 * top


def signatures(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(n, k)`` coordinates of ``n`` weighted sets, and which sets have any element.

    ``elements`` are 64-bit names sorted by ``owner``, distinct within a set if
    ``weights`` are given; without weights each is 1 and repeats do not matter.
    Ranks are searched slab by slab until every coordinate of a set has a dart.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * k, empty, np.uint64)
    total = np.bincount(owner, weights, minlength=n)
    some = total > 0
    darts = k * math.log(k) + 2 * k
    reach = np.where(some, darts / np.maximum(total, 1e-12), 0.0)
    low, high = 0.0, FIRST_SLAB
    open_ = some.copy()
    while open_.any():
        rows = np.flatnonzero(open_[owner])
        _throw(elements[rows], None if weights is None else weights[rows], owner[rows], low, high, k, best)
        full = (best.reshape(n, k) != empty).all(axis=1)
        # a set goes on until its expected darts are thrown and no coordinate is left without one
        open_ &= ~(full & (high >= np.minimum(reach, high)))
        low, high = high, 2 * high
    return best.reshape(n, k), some


def band_keys(coordinates: np.ndarray, some: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(n, bands)`` keys, each of ``rows`` neighbouring coordinates and the band's number."""
    parts = coordinates.reshape(len(coordinates), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(rows):
        key = mixed(key * MIX + parts[:, :, j])
    return key


def _weighted(names: np.ndarray, owner: np.ndarray, weights: str):
    if weights == "ones":
        return names, None, owner
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return names[at], np.diff(np.append(at, len(names))).astype(np.float64), owner[at]


def _check_weights(weights: str) -> None:
    if weights not in ("ones", "counts"):
        raise ValueError(f"weights must be ones or counts, not {weights}")


def _sign(weights: str, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start, stop, texts in chunks(batch):
                names, owner = shingles(texts, hasher)
                names, weight, owner = _weighted(names, owner, weights)
                coordinates, some = signatures(names, weight, owner, len(texts), bands * rows)
                keys = band_keys(coordinates, some, bands, rows).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_h1"), part.column("_h2"), pa.ListArray.from_arrays(offsets, pa.array(keys[some].ravel(), pa.int64()))],
                    ["doc_id", "_h1", "_h2", "bands"],
                )

    return run


def _sets(weights: str):
    """Sorted shingles of each text; with counts, one entry per occurrence number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start, stop, texts in chunks(batch):
                names, owner = shingles(texts, hasher)
                order = np.lexsort((names, owner))
                names, owner = names[order], owner[order]
                new = np.ones(len(names), bool)
                new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
                if weights == "ones":
                    names, owner = names[new], owner[new]
                else:
                    at = np.flatnonzero(new)
                    turn = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
                    names = mixed(names + turn.astype(np.uint64) * MIX)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.ListArray.from_arrays(offsets, pa.array(names.view(np.int64), pa.int64()))], ["node", "items"]
                )

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    weights: str = "ones",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, class_id, copies, keep, _h1, _h2)``: one row per input row.

    A link joins two texts whose shingles of five words have a (weighted)
    Jaccard similarity of ``threshold`` or more: with ``weights="ones"`` each
    distinct shingle counts once, with ``"counts"`` as often as it occurs.
    A class is what links and equal texts connect; ``class_id`` is its least
    id, ``copies`` the rows of the class, and ``keep`` marks one row of it.

    Candidates are texts with an equal band key; at 0.8 a pair is missed with
    a probability of 3e-5 for 26 bands of 5 rows.  In each bucket all members
    are compared with its earliest one first.  Buckets that then still hold
    several classes are compared in full, block by block of their members, and
    only links that join two classes leave a task, so no candidate link is
    lost and no group is written out as pairs or gathered in one task.

    Null texts count as empty.  Empty texts are equal to each other only.
    Texts under five words have one shingle, all their words.  Null ids are
    kept; a class of only null ids has a null ``class_id``.  Repeated rows
    are copies.  An empty table gives no rows.
    """
    _check_weights(weights)
    plain = docs.select(row_id(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = plain.select("doc_id", "text", *text_keys(F.col("text")))
    signed = stage(keyed.mapInArrow(_sign(weights, bands, rows), "doc_id long, _h1 long, _h2 long, bands array<long>"), "darts")
    nodes = signed.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("first_id"))
    # the bands of one row stand for all copies of a text
    key = signed.select(F.col("_h1").alias("node"), F.explode("bands").alias("key")).distinct()
    order = nodes.groupBy(F.col("_h1").alias("node")).agg(F.min("first_id").alias("first_id"))
    buckets = key.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = key.join(buckets, "key")
    members = stage(shared.join(order, "node").select("key", "n", "node", F.coalesce("first_id", F.lit(2**63 - 1)).alias("first_id")), "buckets")
    root = _link(keyed, members, threshold, weights)
    joined = signed.select("doc_id", "_h1", "_h2").join(small(root), F.col("_h1") == F.col("id"), "left")
    rooted = joined.select("doc_id", "_h1", "_h2", F.coalesce("root", "_h1").alias("_root"))
    rooted = stage(rooted, "rooted")
    classes = rooted.groupBy("_root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h1", "_h2")).alias("_kept"))
    many = stage(classes.where("copies > 1"), "classes")
    out = rooted.join(many.withColumnRenamed("_root", "_r"), F.col("_root") == F.col("_r"), "left")
    out = out.select(
        F.coalesce("class_id", "doc_id").alias("class_id"), "doc_id", F.coalesce("copies", F.lit(1)).alias("copies"), "_h1", "_h2",
        (F.col("copies").isNull() | (F.col("doc_id").eqNullSafe(F.col("_kept.doc_id")) & (F.col("_h1") == F.col("_kept._h1")) & (F.col("_h2") == F.col("_kept._h2")))).alias("keep"),
    )
    return out


def _link(keyed: DataFrame, members: DataFrame, threshold: float, weights: str) -> DataFrame:
    """``(id, root)`` of the nodes that are linked to another node."""
    nodes = stage(members.select("node").distinct(), "candidates")
    # one text per node; equal texts come as one row after the distinct
    texts = keyed.join(small(nodes), F.col("_h1") == F.col("node")).select("node", "text")
    sets = stage(texts.mapInArrow(_sets(weights), "node long, items array<long>").dropDuplicates(["node"]), "sets")
    least = members.groupBy("key").agg(F.min(F.struct("first_id", "node")).alias("_least"))
    pairs = members.join(least.select("key", F.col("_least.node").alias("lead")), "key").where("lead <> node")
    pairs = pairs.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    links = stage(two.where(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both) - F.lit(1e-9)).select("a", "b"), "links")
    root = stage(components(links, "linked"), "roots")
    # buckets that still hold several classes: blocks of their members against blocks
    rooted = members.join(small(root), F.col("node") == F.col("id"), "left").select("key", "n", "node", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rooted.join(split, "key").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "node", "root")
    held = dealt.join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    more = stage(held.select("key", "low", "high", "own", "node", "root", "items").mapInArrow(_compare(threshold), "a long, b long"), "links")
    if more.isEmpty():
        return root
    return stage(components(links.union(more), "linked"), "roots")


def _compare(threshold: float):
    """Links between different classes inside each run of rows with equal ``(key, low, high)``.

    A run has at most two blocks.  Only links that join classes not yet joined
    in the run come out, so there are fewer of them than rows.
    """

    def links(own, node, root, items) -> list[tuple[int, int]]:
        size = np.fromiter(map(len, items), np.int64, len(items))
        starts = np.cumsum(size) - size
        codes = np.unique(np.concatenate(items), return_inverse=True)[1]
        label = np.unique(root, return_inverse=True)[1]
        across = own.min() != own.max()
        mark = np.zeros(int(codes.max()) + 1, bool)
        out = []
        for i in range(len(node) - 1):
            apart = label[i + 1 :] != label[i]
            if across:
                apart &= own[i + 1 :] != own[i]
            if not apart.any():
                continue
            mine = codes[starts[i] : starts[i] + size[i]]
            mark[mine] = True
            both = np.add.reduceat(mark[codes[starts[i + 1] :]].astype(np.int32), starts[i + 1 :] - starts[i + 1])
            mark[mine] = False
            near = np.flatnonzero(apart & (both >= threshold * (size[i] + size[i + 1 :] - both) - 1e-9)) + i + 1
            for j in near:
                if label[j] != label[i]:
                    out.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            yield from done(rest, False)
            key = np.stack([rest.column(c).to_numpy() for c in ("key", "low", "high")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if len(change):
                rest = rest.slice(change[-1] + 1)
        if rest is not None:
            yield from done(rest, True)

    def done(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Links of the runs that are complete: all but the last one, or all."""
        if not len(rows):
            return
        key = np.stack([rows.column(c).to_numpy() for c in ("key", "low", "high")])
        cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(rows)] if last else []]).astype(int)
        own, node, root = (rows.column(c).to_numpy() for c in ("own", "node", "root"))
        column = rows.column("items").combine_chunks()
        ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        found = []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                found += links(own[a:b], node[a:b], root[a:b], [values[ends[i] : ends[i + 1]] for i in range(a, b)])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return run


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, of each class only the row that ``keep`` marks, with all their columns.

    Rows equal in id and text are copies of each other, so one of them stays:
    the one with the least hash of all columns, on every run.
    """
    found = near_duplicates(docs, id_col, text_col, **settings)
    kept = found.where("keep").select(F.col("doc_id").alias("keep_id"), F.col("_h1").alias("k1"), F.col("_h2").alias("k2")).distinct()
    t1, t2 = text_keys(F.coalesce(F.col(text_col), F.lit("")))
    first, second = row_order(docs)
    mine = packed(docs, id=row_id(id_col), t1=t1, t2=t2, o1=first, o2=second)
    joined = mine.join(kept, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & F.col("id").eqNullSafe(F.col("keep_id")))
    place = Window.partitionBy("t1", "t2", "id").orderBy("o1", "o2")
    return joined.withColumn("turn", F.row_number().over(place)).where("turn = 1").select("row.*")
