"""Nearest head for a head table of any size: heads in blocks, and exact bounds that leave most blocks out.

Heads are put to the cells of a tree; a block keeps its centre, the angles of
its nearest and farthest head to it, and a ball around its heads in the
directions in which heads differ most.  Both bound the cosine that any head of
the block can have with a vector.  A vector goes first to the block of the
nearest centre, and then only to blocks that can beat the score it has met
there; inside a block the bound of each single head comes before its cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.functions import vectors as X
from topicloom.operators import blocks
from topicloom.operators import celltree
from topicloom.operators import clusters as C
from topicloom.staging import stage

MAX_CENTRES = 65_536
#: Heads of a block at least before it is cut; a block of more heads becomes several around the same centre.
BLOCK_ROWS = 4096
#: Scans of the vectors that cost as much as sending each of them to one block.
SCANS_PER_BLOCK = 0.25
SAMPLE = 4096
#: Rows that meet one block in one task; more are dealt to several, each with the block's heads.
ROWS_PER_SALT = 10_000
#: Scores are compared after rounding, so a bound this much below a score may still reach it.
MARGIN = 2 * K.HALF_UNIT + 1e-9

_TODO = "array<struct<bound:float,block:int>>"
_FOUND = "member_id long, head_id long, score double, met long, compared long"


@dataclass(frozen=True)
class Bounds:
    """What tells how near a block's heads can be to a vector; one entry per block, but for the basis."""

    basis: np.ndarray
    middle: np.ndarray
    size: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    centre: np.ndarray
    ball: np.ndarray
    rest: np.ndarray

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles to the blocks' centres, and upper bounds of the cosine of each row with any head of each block."""
        apart = np.arccos(np.clip(units @ self.middle.T, -1, 1))
        bound = np.cos(np.maximum(np.maximum(apart - self.outer, self.inner - apart), 0))
        inside, outside = projected(units, self.basis)
        length = np.sqrt((inside * inside).sum(axis=1))
        ball = inside @ self.centre.T + length[:, None] * self.ball + outside[:, None] * self.rest
        return apart, np.minimum(bound, ball)


def projected(units: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in the basis and the length of what lies outside of it."""
    inside = units @ basis
    return inside, np.sqrt(np.maximum(0, (units * units).sum(axis=1) - (inside * inside).sum(axis=1)))


def _nonzero(df: DataFrame, id_col: str, vec_col: str, name: str, kind: str) -> DataFrame:
    """Ids and vectors, without null and all-zero vectors, whose cosine never reaches a positive threshold."""
    vec = F.col(vec_col).cast(kind).alias("vec")
    return df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), vec).where(F.exists("vec", lambda x: x != 0))


def _kind(df: DataFrame, vec_col: str = "vec") -> str:
    return "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            units = K.unit_rows(K.matrix(batch.column("vec")))
            total = units.T @ units + (0 if total is None else total)
    if total is not None:
        size = len(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total))], ["row", "sums"])


def _basis(heads: DataFrame, dim: int) -> np.ndarray:
    """The three eighths of the directions that hold most of the heads' length; only a dim by dim matrix leaves the tasks."""
    parts = heads.select("vec").mapInArrow(_moments, "row int, sums array<double>")
    rows = parts.select("row", F.posexplode("sums")).groupBy("row", "pos").agg(F.sum("col").alias("sum")).toArrow()
    square = np.zeros((dim, dim))
    square[rows.column("row").to_numpy(), rows.column("pos").to_numpy()] = rows.column("sum").to_numpy()
    return np.linalg.eigh(square)[1][:, ::-1][:, : max(1, 3 * dim // 8)]


def _block_sizes(basis: np.ndarray):
    def run(block: pa.Table) -> pa.Table:
        units = K.unit_rows(K.matrix(block.column("vec")))
        inside, outside = projected(units, basis)
        centre = inside.mean(axis=0)
        middle = K.unit_rows(units.mean(axis=0)[None])[0]
        angles = np.arccos(np.clip(units @ middle, -1, 1))
        ball = np.sqrt(((inside - centre) ** 2).sum(axis=1).max())
        return pa.table(
            {
                "block": block.column("block").slice(0, 1), "size": pa.array([len(units)], pa.int64()), "middle": [middle.tolist()],
                "inner": [float(angles.min())], "outer": [float(angles.max())], "centre": [centre.tolist()], "ball": [float(ball)], "rest": [float(outside.max())],
            }
        )

    run.__annotations__ = {"block": pa.Table, "return": pa.Table}
    return run


_SIZES = "block int, size long, middle array<double>, inner double, outer double, centre array<double>, ball double, rest double"


def head_blocks(heads: DataFrame, limit: int = blocks.BROADCAST_BYTES) -> tuple[DataFrame, Bounds] | None:
    """``(head_id, vec, block)`` as a written table, and the bounds of the blocks; None without heads.

    Blocks are the leaves of a cell tree over the heads' directions, about two
    for the root of the number of heads, and at most ``MAX_CENTRES`` or as many
    as ``limit`` bytes hold; larger ones are cut by a hash, which adds half as
    many again at most.
    """
    spark = heads.sparkSession
    count = heads.count()
    if not count:
        return None
    dim = heads.select(F.size("vec").alias("dim")).first()["dim"]
    most = max(1, min(MAX_CENTRES, limit // (16 * dim)))
    basis = _basis(heads, dim)
    directions = heads.select("head_id", X.unit(F.col("vec")).alias("vec"))
    tree = celltree.train_cell_tree(directions, min(most, math.ceil(2 * math.sqrt(count))), "head_id")
    cells = celltree.tree_cells(directions, tree, 1, min(2, tree.tops.count()), "head_id").select("head_id", F.col("cells")[0].alias("cell"))
    near = stage(heads.join(cells, "head_id"), "celled")
    pieces = near.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(BLOCK_ROWS, -(-2 * count // most)))).cast("int").alias("pieces"))
    # blocks are numbered without gaps; there is one row per block in the window
    cut = near.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("head_id", F.lit("piece")), F.col("pieces")))
    cut = stage(cut.select("head_id", "vec", "cell", "piece"), "pieces")
    numbers = cut.select("cell", "piece").distinct().withColumn("block", F.row_number().over(Window.orderBy("cell", "piece")) - 1)
    laid = stage(cut.join(F.broadcast(numbers), ["cell", "piece"]).select("head_id", "vec", "block"), "blocks")
    known = laid.groupBy("block").applyInArrow(_block_sizes(basis), _SIZES).toArrow()
    known = known.take(pa.array(np.argsort(known.column("block").to_numpy())))
    size, inner, outer, ball, rest = (known.column(c).to_numpy() for c in ("size", "inner", "outer", "ball", "rest"))
    bounds = Bounds(basis, K.matrix(known.column("middle")), size, inner, outer, K.matrix(known.column("centre")), ball, rest)
    return laid, bounds


def _first_look(shared, threshold: float):
    """Each vector with the blocks that can hold a head near enough: the one of the nearest centre, then by bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = K.unit_rows(K.matrix(batch.column("vec")))
            for some in K.row_blocks(len(units), len(bounds.size)):
                apart, bound = bounds.of(units[some])
                can = bound >= threshold - MARGIN
                nearest = np.argmin(np.where(can, apart, np.inf), axis=1)
                row, block = np.nonzero(can)
                value = bound[row, block]
                best_first = np.lexsort((block, -value, nearest[row] != block, row))
                row, block, value = row[best_first], block[best_first], value[best_first]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(bound)))]).astype(np.int32)
                # rounded up, since a bound must not get smaller
                upper = np.nextafter(value.astype(np.float32), np.float32(2))
                todo = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(upper), pa.array(block.astype(np.int32))], ["bound", "block"]))
                kept = [batch.column(c).slice(some.start, len(bound)) for c in ("member_id", "vec")]
                yield pa.RecordBatch.from_arrays([*kept, todo], ["member_id", "vec", "todo"])

    return run


def _met(basis: np.ndarray, threshold: float, going_on: bool):
    """Streams rows sorted by block, heads first; only one block's heads are held."""

    def against(own, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, heads, inside, outside = own
        units = K.unit_rows(K.matrix(rows.column("vec")))
        vec_in, vec_out = projected(units, basis)
        best = np.asarray(rows.column("score").fill_null(-2.0)).copy()
        head = np.asarray(rows.column("head_id").fill_null(-1)).copy()
        compared = np.zeros(len(units), np.int64)
        for some in K.row_blocks(len(units), len(ids)):
            bound = vec_in[some] @ inside.T + np.outer(vec_out[some], outside)
            # the most promising head of each vector first; its score leaves out most others
            likely = np.argmax(bound, axis=1)
            rows_of = np.arange(len(likely))
            got = np.round(np.einsum("ij,ij->i", units[some], heads[likely]), K.ROUND)
            _improve(best[some], head[some], rows_of, got, ids[likely])
            compared[some] += 1
            bound[rows_of, likely] = -2
            row, other = np.nonzero(bound >= np.maximum(best[some], threshold)[:, None] - MARGIN)
            compared[some] += np.bincount(row, minlength=len(likely))
            step = max(1, K.CELLS_PER_BLOCK // max(1, heads.shape[1]))
            for at in range(0, len(row), step):
                r, o = row[at : at + step], other[at : at + step]
                got = np.round(np.einsum("ij,ij->i", units[some][r], heads[o]), K.ROUND)
                _improve(best[some], head[some], r, got, ids[o])
        near = best >= threshold
        met = pa.array(np.full(len(units), len(ids)))
        out = [rows.column("member_id"), pa.array(head, mask=~near), pa.array(best, mask=~near), met, pa.array(compared)]
        names = ["member_id", "head_id", "score", "met", "compared"]
        if going_on:
            out, names = out + [rows.column("vec"), rows.column("todo")], names + ["vec", "todo"]
        yield pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, own = None, [], None
        for batch in batches:
            numbers, asks = np.asarray(batch.column("block")), np.asarray(batch.column("asks"))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks) != 0)) + 1, [len(numbers)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if numbers[a] != block:
                    block, parts, own = numbers[a], [], None
                if not asks[a]:
                    parts.append((np.asarray(piece.column("member_id")), K.unit_rows(K.matrix(piece.column("vec")))))
                    continue
                if own is None:
                    ids, heads = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    own, parts = (ids, heads, *projected(heads, basis)), []
                yield from against(own, piece)

    return run


def _improve(best: np.ndarray, head: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Better scores take over; equal ones go to the lower head id."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, bool)
    rows, scores, ids = rows[first], scores[first], ids[first]
    over = (scores > best[rows]) | ((scores == best[rows]) & (ids < head[rows]))
    best[rows[over]], head[rows[over]] = scores[over], ids[over]


def _meet(asks: DataFrame, laid: DataFrame, basis: np.ndarray, threshold: float, going_on: bool) -> DataFrame:
    """Rows of ``asks`` (with ``block``) against the heads of their block, in one shuffle of both.

    A block that many vectors ask for is held by several tasks, each with a
    share of the vectors, so no block makes one task long.
    """
    spark = asks.sparkSession
    counted = asks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts"))
    counted = stage(counted, "asked")
    salted = asks.join(F.broadcast(counted.where("salts > 1")), "block", "left")
    salt = F.pmod(F.xxhash64("member_id"), F.coalesce("salts", F.lit(1))).cast("int")
    left = salted.withColumn("salt", salt).select("block", "salt", F.lit(1).alias("asks"), "member_id", "vec", "head_id", "score", "todo")
    heads = laid.join(F.broadcast(counted), "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    null = F.lit(None)
    right = heads.select(
        "block", "salt", F.lit(0).alias("asks"), F.col("head_id").alias("member_id"), "vec", null.cast("long").alias("head_id"),
        null.cast("double").alias("score"), null.cast(asks.schema["todo"].dataType).alias("todo"),
    )
    both = right.unionByName(left).repartition(max(_tasks(spark), 1), "block", "salt").sortWithinPartitions("block", "salt", "asks", "member_id")
    schema = f"{_FOUND}, vec {_kind(asks)}, todo {_TODO}" if going_on else _FOUND
    return both.mapInArrow(_met(basis, threshold, going_on), schema)


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def nearest_heads(
    vectors: DataFrame, heads: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec",
    limit: int = blocks.BROADCAST_BYTES, spread: float | None = None,
) -> DataFrame:
    """``(member_id, head_id, score, met, compared)``: one row per vector that is not all zeros.

    ``head_id`` is the head of the greatest cosine, null if none reaches
    ``threshold``, which must be positive; equal scores go to the lower id.
    ``met`` counts the heads of the blocks a vector was sent to, ``compared``
    those whose cosine was computed in full; the centres of all blocks, with
    which every vector is compared, are in neither.

    Nothing but centres and bounds of blocks is sent to all tasks (``limit``
    bytes).  The vectors are scanned once whatever the size of the head table,
    and go to blocks by shuffles.  Where bounds leave out too little, that is
    where a sample of vectors may meet more than ``spread`` blocks on average,
    the heads are sent part by part instead, with the same result.  By default
    that is where one scan of the vectors per part of the heads costs less.
    """
    if threshold <= 0:
        raise ValueError("bounds need a positive threshold")
    spark = vectors.sparkSession
    kind = max(_kind(vectors, vec_col), _kind(heads, vec_col), key=len)
    asked = _nonzero(vectors, id_col, vec_col, "member_id", kind)
    heads = stage(_nonzero(heads, id_col, vec_col, "head_id", kind), "heads")
    made = head_blocks(heads, limit)
    if made is None:
        return asked.select("member_id", *[F.lit(None).cast(k).alias(c) for c, k in (("head_id", "long"), ("score", "double"))], *[F.lit(0).cast("long").alias(c) for c in ("met", "compared")])
    laid, bounds = made
    shared = spark.sparkContext.broadcast(bounds)
    look, schema = _first_look(shared, threshold), f"member_id long, vec {kind}, todo {_TODO}"
    if spread is None:
        dim = bounds.middle.shape[1]
        spread = math.ceil(2 * 8 * dim * int(bounds.size.sum()) / limit) / SCANS_PER_BLOCK
    if math.isfinite(spread):
        sample = asked.limit(SAMPLE).mapInArrow(look, schema).agg(F.avg(F.size("todo"))).first()[0] or 0.0
        if sample > spread:
            return _by_parts(asked, heads, threshold, limit)
    seen = asked.mapInArrow(look, schema)
    seen = stage(seen.withColumn("vec", F.when(F.size("todo") > 0, F.col("vec"))), "looked")
    zero = F.lit(0).cast("long")
    none = [F.lit(None).cast("long").alias("head_id"), F.lit(None).cast("double").alias("score")]
    first = seen.where(F.size("todo") > 0).select("member_id", "vec", *none, F.col("todo")[0]["block"].alias("block"), "todo")
    one = stage(_meet(first, laid, bounds.basis, threshold, True), "first-blocks")
    least = F.greatest(F.coalesce("score", F.lit(-2.0)), F.lit(threshold)) - F.lit(MARGIN)
    left = F.filter(F.slice("todo", 2, F.greatest(F.size("todo"), F.lit(1))), lambda t: t["bound"] >= least)
    second = one.withColumn("todo", left).select("member_id", "vec", "head_id", "score", F.explode("todo").alias("next"))
    second = second.select("member_id", "vec", "head_id", "score", F.col("next.block").alias("block"), F.array().cast(_TODO).alias("todo"))
    two = _meet(second, laid, bounds.basis, threshold, False)
    narrow = ["member_id", "head_id", "score", "met", "compared"]
    found = seen.select("member_id", *none, zero.alias("met"), zero.alias("compared")).unionByName(one.select(*narrow)).unionByName(two)
    best = found.groupBy("member_id").agg(
        F.max_by(F.struct("head_id", "score"), F.when(F.col("head_id").isNotNull(), F.struct(F.col("score"), -F.col("head_id")))).alias("best"),
        F.sum("met").alias("met"), F.sum("compared").alias("compared"),
    )
    return best.select("member_id", "best.head_id", "best.score", "met", "compared")


def _by_parts(asked: DataFrame, heads: DataFrame, threshold: float, limit: int) -> DataFrame:
    known = C.assign_nearest(
        asked.withColumnRenamed("member_id", "id"), heads.withColumnRenamed("head_id", "id"), threshold, "id", "vec", limit
    )
    count = F.lit(heads.count()).cast("long")
    return asked.select("member_id").join(known, "member_id", "left").select("member_id", "head_id", "score", count.alias("met"), count.alias("compared"))


def assign_nearest_pruned(
    vectors: DataFrame, heads: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec",
    limit: int = blocks.BROADCAST_BYTES, spread: float | None = None,
) -> DataFrame:
    """The cluster table of ``assign_nearest``, for head tables of any size; see ``nearest_heads``."""
    found = nearest_heads(vectors, heads, threshold, id_col, vec_col, limit, spread)
    return found.where(F.col("head_id").isNotNull()).select(*C.CLUSTER_COLUMNS)
