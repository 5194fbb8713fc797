"""Vector arithmetic on ``ARRAY<FLOAT>`` columns with built-in functions.

Arithmetic runs in double; ``ROUND`` digits make comparisons and ties stable
whatever order the partial sums were added in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when a nested lambda uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _total(F.zip_with(a, b, term))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when one of them is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    def scaled(size: Column) -> Column:
        return F.transform(a, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size))

    return let(norm(a), scaled)


def blend(keys: Column, docs: Column, weight: float) -> Column:
    """``weight`` parts keyword vector, the rest document vector."""
    return F.zip_with(
        keys, docs, lambda k, d: (k.cast("double") * weight + d.cast("double") * (1 - weight)).cast("float")
    )


def softmax(scores: Column) -> Column:
    """Softmax shifted by the maximum so that large scores do not overflow."""
    raised = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x.cast("double") - top)))
    return let(raised, lambda r: let(_total(r), lambda total: F.transform(r, lambda e: e / total)))


def constant_gate_fold(vectors: Column, gate: float = 0.5) -> Column:
    """Ordered fold ``gate * sum so far + (1 - gate) * next`` over an array of vectors."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    rest = F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0)))
    folded = F.aggregate(
        rest, first, lambda acc, v: F.zip_with(acc, v, lambda a, b: a * gate + b.cast("double") * (1 - gate))
    )
    return F.transform(folded, lambda x: x.cast("float"))
