import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "topicloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of ``build(column)`` for one string value."""

    def run(build, x):
        return spark.createDataFrame([(x,)], "x string").select(build(F.col("x")).alias("r")).first()["r"]

    return run


def vector_table(spark, ids, rows, id_col="id"):
    data = [(int(i), [float(x) for x in r]) for i, r in zip(ids, rows)]
    return spark.createDataFrame(data, f"{id_col} bigint, vec array<float>")


def random_vectors(seed, count, dim, groups=0):
    """Random rows; with groups, noisy copies of that many centers."""
    rng = np.random.default_rng(seed)
    if not groups:
        return rng.normal(size=(count, dim)).astype(np.float32)
    centers = rng.normal(size=(groups, dim))
    return (centers[rng.integers(groups, size=count)] + 0.35 * rng.normal(size=(count, dim))).astype(np.float32)
