"""Numpy kernels that run inside Spark tasks on Arrow data.

All of them work on one Arrow batch or one bounded group at a time.  Scores are
compared after rounding to ``ROUND`` digits, which is done by moving the
threshold half a unit instead of rounding whole score matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from topicloom.functions.vectors import ROUND

HALF_UNIT = 0.5 * 10.0**-ROUND
CELLS_PER_BLOCK = 4_000_000

CLUSTER_SCHEMA = "head_id bigint, member_id bigint, score double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a float64 matrix.

    Rows of unequal lengths, null rows and null items raise: their numbers
    would land in other rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count:
        raise ValueError(f"{column.null_count} vectors are null")
    sizes = np.diff(column.offsets.to_numpy()) if rows and not pa.types.is_fixed_size_list(column.type) else np.empty(0, int)
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError(f"vectors of {sizes.min()} and {sizes.max()} numbers in one column; they must be equally long")
    items = column.flatten()
    if items.null_count:
        raise ValueError(f"{items.null_count} numbers of the vectors are null")
    flat = items.to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1 if rows else 0)


def vector_array(rows: np.ndarray) -> pa.Array:
    """A float matrix as an Arrow list column."""
    count, dim = rows.shape
    offsets = np.arange(0, (count + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(count + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.float32).ravel()))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; all-zero rows stay zero, so their cosine is 0."""
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def row_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(np.einsum("ij,ij->i", unit_rows(a), unit_rows(b)), ROUND)


def row_blocks(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows so that one block of scores stays small."""
    step = max(1, CELLS_PER_BLOCK // max(1, columns))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def similar_pairs(ids: np.ndarray, units: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Pairs ``id_a < id_b`` with cosine at or above the threshold, block by block."""
    order = np.argsort(ids, kind="stable")
    ids, units = ids[order], units[order]
    for block in row_blocks(len(ids), len(ids)):
        scores = units[block] @ units.T
        left, right = np.nonzero(scores >= threshold - HALF_UNIT)
        above = right > left + block.start
        left, right = left[above], right[above]
        yield ids[left + block.start], ids[right], np.round(scores[left, right], ROUND)


def candidate_sizes(ids: np.ndarray, units: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For every row: how many rows of the page it covers, and the sum of their scores."""
    sizes = np.zeros(len(ids), np.int64)
    totals = np.zeros(len(ids))
    for block in row_blocks(len(ids), len(ids)):
        scores = np.round(units[block] @ units.T, ROUND)
        near = scores >= threshold - HALF_UNIT
        sizes[block] = near.sum(axis=1)
        totals[block] = np.where(near, scores, 0.0).sum(axis=1)
    return sizes, totals


def greedy_page(
    ids: np.ndarray, units: np.ndarray, threshold: float, min_size: int, strict: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy clusters of one page: large candidates first, equal sizes by lower id.

    Every row is a candidate that covers all rows at or above the threshold.  A
    candidate is taken when none of its rows is taken yet.  Neighbourhoods are
    kept as bits, so a page of ``n`` rows needs ``n * n / 8`` bytes.  Candidates
    under ``min_size`` come last and can block none, so they are left out.
    """
    order = np.argsort(ids, kind="stable")
    ids, units = ids[order], units[order]
    rows = len(ids)
    sizes = np.zeros(rows, np.int64)
    bits = np.zeros((rows, (rows + 7) // 8), np.uint8)
    for block in row_blocks(rows, rows):
        near = units[block] @ units.T >= threshold - HALF_UNIT
        sizes[block] = near.sum(axis=1)
        bits[block] = np.packbits(near, axis=1)
    taken = np.zeros(bits.shape[1], np.uint8)
    heads, members, scores = [], [], []
    for row in np.lexsort((ids, -sizes)):
        if sizes[row] < max(1, min_size):
            break
        if np.bitwise_and(bits[row], taken).any():
            continue
        taken |= bits[row]
        inside = np.flatnonzero(np.unpackbits(bits[row], count=rows))
        values = np.round(units[inside] @ units[row], ROUND)
        if strict:
            inside, values = inside[values > threshold], values[values > threshold]
            if len(inside) < min_size:
                continue
        heads.append(np.full(len(inside), ids[row]))
        members.append(ids[inside])
        scores.append(values)
    if not heads:
        return np.array([], np.int64), np.array([], np.int64), np.array([])
    return np.concatenate(heads), np.concatenate(members), np.concatenate(scores)


def nearest_rows(units: np.ndarray, head_ids: np.ndarray, head_units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best head of every row; equal rounded scores go to the lower head id.

    ``head_ids`` must be ascending.
    """
    best_ids = np.empty(len(units), head_ids.dtype)
    best_scores = np.empty(len(units))
    for block in row_blocks(len(units), len(head_ids)):
        scores = units[block] @ head_units.T
        top = np.round(scores.max(axis=1), ROUND)
        first = np.argmax(scores >= (top - HALF_UNIT)[:, None], axis=1)
        best_ids[block] = head_ids[first]
        best_scores[block] = top
    return best_ids, best_scores


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Query by row values where smaller is better: squared L2, or the negative inner product."""
    products = queries @ rows.T
    if metric == "ip":
        return -products
    lengths = (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1)[None, :]
    return np.maximum(lengths - 2 * products, 0.0)


def lloyd(rows: np.ndarray, count: int, steps: int) -> np.ndarray:
    """At most ``count`` k-means centers of the rows, starting from the first ones; empty ones are left out."""
    centers = rows[: max(1, count)].copy()
    for _ in range(steps):
        nearest = np.empty(len(rows), np.int64)
        for block in row_blocks(len(rows), len(centers)):
            nearest[block] = np.argmin((centers * centers).sum(axis=1) - 2 * (rows[block] @ centers.T), axis=1)
        order = np.argsort(nearest, kind="stable")
        kinds, starts = np.unique(nearest[order], return_index=True)
        sizes = np.diff(np.append(starts, len(rows)))
        moved = np.add.reduceat(rows[order], starts, axis=0) / sizes[:, None]
        if len(moved) == len(centers) and np.array_equal(moved, centers[kinds]):
            break
        centers = moved
    return centers


class TopK:
    """Running best ``k`` rows of each query; ties go to the lower id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.array([], np.int64) for _ in range(queries)]
        self.values = [np.array([]) for _ in range(queries)]
        self.worst = np.full(queries, np.inf)

    def add(self, which: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """``values`` has one row per query index in ``which``, one column per id."""
        near = values <= (self.worst[which] + 2 * HALF_UNIT)[:, None]
        for at in np.flatnonzero(near.any(axis=1)):
            slot = which[at]
            keep = np.flatnonzero(near[at])
            row = values[at, keep]
            if len(row) > self.k:
                cut = np.partition(row, self.k - 1)[self.k - 1]
                closest = row <= cut + 2 * HALF_UNIT
                row, keep = row[closest], keep[closest]
            all_ids = np.concatenate([self.ids[slot], ids[keep]])
            all_values = np.concatenate([self.values[slot], np.round(row, ROUND)])
            best = np.lexsort((all_ids, all_values))[: self.k]
            self.ids[slot], self.values[slot] = all_ids[best], all_values[best]
            if len(best) == self.k:
                self.worst[slot] = all_values[best[-1]]

    def table(self, query_ids: np.ndarray, metric: str) -> pa.RecordBatch:
        counts = [len(i) for i in self.ids]
        values = np.concatenate(self.values) if counts else np.array([])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, counts), pa.int64()),
                pa.array(np.concatenate(self.ids) if counts else [], pa.int64()),
                pa.array((-values if metric == "ip" else values) + 0.0, pa.float64()),
            ],
            names=["query_id", "doc_id", "score"],
        )


def gate_step(left: np.ndarray, right: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``g * left + (1 - g) * right`` with ``g = sigmoid(W [left; right] + c)``, row by row."""
    gate = 1.0 / (1.0 + np.exp(-(np.concatenate([left, right], axis=1) @ weight.T + bias)))
    return gate * left + (1.0 - gate) * right


def fold_rows(rows: np.ndarray, lengths: np.ndarray, step) -> np.ndarray:
    """Fold consecutive groups of rows from left to right; all groups advance together."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    folded = np.zeros((len(lengths), rows.shape[1]))
    some = np.flatnonzero(lengths > 0)
    folded[some] = rows[starts[some]]
    for position in range(1, int(lengths.max(initial=0))):
        some = np.flatnonzero(lengths > position)
        folded[some] = step(folded[some], rows[starts[some] + position])
    return folded
