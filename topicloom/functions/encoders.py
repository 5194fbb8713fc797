"""The encoder slot: text in, ``ARRAY<FLOAT>`` out.

An encoder has two halves.  ``features`` is a column expression that Spark runs
on the JVM side; ``matrix`` turns one Arrow batch of features into a float
matrix.  A wrapped external model uses the text itself as its feature.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import kernels as K
from topicloom.functions import text as T


@dataclass(frozen=True)
class Encoder:
    dim: int
    features: Callable[[Column], Column]
    matrix: Callable[[pa.Array], np.ndarray]


def hash_encoder(dim: int = 64) -> Encoder:
    """Signed bag of hashed words, scaled to length one.

    The first eight hex digits of the word's md5 give ``h``: slot ``h % dim``,
    counted up when ``h // dim`` is even and down when it is odd.  A counted-down
    slot travels as ``-slot - 1``.
    """

    def features(text: Column) -> Column:
        hashed = F.transform(T.tokens(text), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"))

        def slot(h: Column) -> Column:
            place = (h % dim).cast("int")
            return F.when(F.floor(h / dim) % 2 == 0, place).otherwise(-place - 1)

        return F.transform(hashed, slot)

    def matrix(batch: pa.Array) -> np.ndarray:
        lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        slots = batch.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(batch)), lengths)
        places = np.where(slots >= 0, slots, -slots - 1)
        signs = np.where(slots >= 0, 1.0, -1.0)
        counts = np.bincount(rows * dim + places, weights=signs, minlength=len(batch) * dim)
        return K.unit_rows(counts.astype(np.float64).reshape(len(batch), dim))

    return Encoder(dim, features, matrix)


def model_encoder(encode: Callable[[Sequence[str]], np.ndarray], dim: int) -> Encoder:
    """Wrap a model that maps a list of texts to a float matrix; null text is empty text."""
    return Encoder(
        dim,
        lambda text: F.coalesce(text, F.lit("")),
        lambda batch: np.asarray(encode(batch.to_pylist()), np.float64).reshape(len(batch), dim),
    )


def factory_encoder(load: Callable[[], Callable[[Sequence[str]], np.ndarray]], dim: int) -> Encoder:
    """Wrap a model that is too large to travel with a plan: ``load()`` gives it, once in each Python worker.

    Only the loader is sent with the plan; it reads the weights from a shared
    folder, say.  A worker keeps the model for all later tasks and queries.
    """
    name = f"topicloom_model_{uuid.uuid4().hex}"

    def matrix(batch: pa.Array) -> np.ndarray:
        # modules outlive the tasks of a worker; functions of a plan do not
        held = sys.modules.get(name)
        if held is None:
            held = types.ModuleType(name)
            held.model = load()
            sys.modules[name] = held
        return np.asarray(held.model(batch.to_pylist()), np.float64).reshape(len(batch), dim)

    return Encoder(dim, lambda text: F.coalesce(text, F.lit("")), matrix)


def encode(df: DataFrame, encoder: Encoder, text_col: str, out: str = "vec") -> DataFrame:
    """Add the vector of a text column; nothing is shuffled."""
    matrix = encoder.matrix

    def run(features: pa.Array) -> pa.Array:
        return K.vector_array(matrix(features))

    run.__annotations__ = {"features": pa.Array, "return": pa.Array}
    return df.withColumn(out, arrow_once(run, "array<float>")(encoder.features(F.col(text_col))))


def arrow_once(run: Callable, returns: str):
    """An Arrow function that the optimizer may not copy.

    Filters on its result would otherwise be pushed below it together with a
    second copy of the call.
    """
    return F.arrow_udf(run, returns).asNondeterministic()
