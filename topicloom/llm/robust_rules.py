"""Quality rules: text statistics whose joint outliers are rejected.

Every text becomes a vector of transformed statistics.  For each language and
source the minimum covariance determinant gives a centre and a covariance that
outliers cannot move: of several starts, concentration steps go to the rows
nearest to the last estimate, and the start with the least determinant wins.
Texts too far from the centre by Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import SHINGLE, WordHasher, chunks, mixed, rolled, small, split_words
from topicloom.staging import stage

MIN_WORDS = 10
#: A text fails when more than so many percent of its words are in repeated windows.
REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?=+~^@_{}[]\\/"
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
DIM = len(COUNTS)
#: Words of average text that a text's rates are mixed with, so that short texts do not stand out by chance.
PRIOR_WORDS = 50
#: Steps per unit of a transformed statistic; statistics are whole numbers, so that their sums do not depend on an order.
UNITS = 1024
#: Greatest transformed statistic; one beyond it counts as this, which keeps all sums within 64 bits.
MOST = 16 * UNITS
#: Differences in a transformed statistic that never matter.
FLOOR = 0.06 * UNITS
#: Share of the rows that a concentration step goes to, and the most steps.
INSIDE, STEPS = 0.75, 12
#: Random starts besides the one of medians, each from one of so many shares of the rows.
STARTS, SHARES = 2, 8
#: Languages and sources with fewer rows are put together by language, these once more over all languages.
MIN_GROUP = 50
#: Distances are compared in so many steps to an octave.
OCTAVE = 32
#: Groups whose estimates may be sent to every task; more of them are joined by a shuffle.
SENT_GROUPS = 50_000
#: Share of normally distributed rows that the limit keeps.
KEPT = 0.9999

_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
STATS_SCHEMA = "n_words long, " + ", ".join(f"{c} long" for c in COUNTS)


def chi_square_share(x: float, freedom: int) -> float:
    """Share of a chi-square distribution of even freedom below ``x``."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(freedom // 2))


def chi_square_limit(share: float, freedom: int) -> float:
    low, high = 0.0, 10.0 * freedom + 40 * abs(NormalDist().inv_cdf(share))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, freedom) < share else (low, mid)
    return (low + high) / 2


_CLASSES = np.zeros((256, 4), np.int64)
_CLASSES[:, 0] = [b not in b" \t\n\x0b\x0c\r" and b & 0xC0 != 0x80 for b in range(256)]
_CLASSES[list(SYMBOLS), 1] = 1
_CLASSES[ord("A") : ord("Z") + 1, 2] = 1
_CLASSES[list(MARKS), 3] = 1


def text_counts(texts: list[bytes], hasher: WordHasher) -> np.ndarray:
    """``(texts, 1 + DIM)``: words, then the counts of ``COUNTS``."""
    out = np.zeros((len(texts), 1 + DIM), np.int64)
    words, sizes = split_words(texts)
    out[:, 0] = sizes
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    some = np.flatnonzero(length)
    if len(some):
        data = np.frombuffer(b"".join(texts), np.uint8)
        start = (np.cumsum(length) - length)[some]
        for column, kind in ((1, 0), (2, 1), (5, 2), (6, 3)):
            out[some, column] = np.add.reduceat(_CLASSES[:, kind][data], start)
    for k, text in enumerate(texts):
        if b"\n" in text:
            lines = text.split(b"\n")
            if len(set(lines)) < len(lines):
                full = [line for line in lines if line.strip(b" \t\n\x0b\x0c\r")]
                out[k, 3] = len(full) - len(set(full))
    windows = rolled(hasher.hash(words), SHINGLE)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(owner[: len(windows)] == owner[SHINGLE - 1 :]) if len(windows) else np.empty(0, np.int64)
    keys = windows[whole] ^ mixed(owner[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = whole[twice]
    edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + SHINGLE, minlength=len(words) + 1)
    out[:, 4] = np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(texts))
    return out


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        for start, stop, texts in chunks(batch):
            counts = text_counts(texts, hasher)
            columns = [batch.column(c).slice(start, stop - start) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in counts.T]], [*others, "n_words", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``(doc_id, lang, source, n_words, ...COUNTS, base_failed)``; null texts have no words."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(groups[0]).cast("string").alias("lang"), F.col(groups[1]).cast("string").alias("source"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    counted = own.mapInArrow(_counting, f"doc_id {kind}, lang string, source string, {STATS_SCHEMA}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``g``, the group whose estimate a row is held against.

    A language and source with at least ``MIN_GROUP`` rows is a group; the rest
    of a language is one if it has as many, and what then is left is the last.
    """
    sizes = stage(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("base_failed")).alias("fit")), "group-sizes")
    rest = sizes.where(F.col("fit") < MIN_GROUP).groupBy("lang").agg(F.sum("fit").alias("left"))
    named = sizes.alias("s").join(rest.alias("r"), F.expr("s.lang <=> r.lang"), "left").select(
        F.col("s.lang").alias("_lang"), F.col("s.source").alias("_source"),
        F.when(F.col("fit") >= MIN_GROUP, F.to_json(F.struct(F.lit(2).alias("k"), "s.lang", "s.source")))
        .when(F.col("left") >= MIN_GROUP, F.to_json(F.struct(F.lit(1).alias("k"), "s.lang")))
        .otherwise(F.to_json(F.struct(F.lit(0).alias("k")))).alias("g"),
    )
    named = stage(named, "groups")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(small(named, SENT_GROUPS), same).drop("_lang", "_source")


def vectors(rows: DataFrame) -> DataFrame:
    """Adds ``x0..``: square roots of rates per word, each mixed with ``PRIOR_WORDS`` words at its group's rate."""
    totals = rows.groupBy("g").agg(F.sum("n_words").alias("_words"), *[F.sum(c).alias(f"_{c}") for c in COUNTS])
    totals = stage(totals.withColumnRenamed("g", "_g"), "rates")
    joined = rows.join(small(totals, SENT_GROUPS), F.col("g") == F.col("_g"))
    made = {}
    for k, c in enumerate(COUNTS):
        average = F.col(f"_{c}") / F.greatest(F.col("_words"), F.lit(1))
        rate = (F.col(c) + PRIOR_WORDS * average) / (F.col("n_words") + PRIOR_WORDS)
        made[f"x{k}"] = F.least(F.round(F.sqrt(rate) * UNITS), F.lit(float(MOST))).cast("long")
    return joined.withColumns(made).drop("_g", "_words", *[f"_{c}" for c in COUNTS])


def _sums() -> list[Column]:
    """Number, sums and sums of products of the vectors, all of them whole numbers."""
    first = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)]
    second = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _PAIRS]
    return [F.count(F.lit(1)).alias("n"), *first, *second]


SUM_NAMES = ["n", *[f"s{i}" for i in range(DIM)], *[f"p{i}_{j}" for i, j in _PAIRS]]
ESTIMATE_SCHEMA = "g string, start int, centre array<double>, white array<double>, logdet double, mark long"


def estimate(sums: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, whitening matrices and log determinants from rows of ``SUM_NAMES``."""
    n = sums[:, 0, None].astype(np.float64)
    centre = sums[:, 1 : 1 + DIM] / n
    cover = np.empty((len(sums), DIM, DIM))
    for k, (i, j) in enumerate(_PAIRS):
        cover[:, i, j] = cover[:, j, i] = sums[:, 1 + DIM + k] / n[:, 0] - centre[:, i] * centre[:, j]
    return centre, *_whitened(cover * factor)


def _whitened(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    floored = cover + np.eye(DIM) * FLOOR**2
    root = np.linalg.cholesky(floored)
    return np.linalg.inv(root), 2 * np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1)


def _estimating(factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = np.stack([np.asarray(batch.column(c)) for c in SUM_NAMES], axis=1)
                centre, white, logdet = estimate(sums, factor)
                yield _packed(batch, centre, white, logdet, sums @ np.arange(1, 1 + sums.shape[1]))

    return run


def _packed(batch, centre, white, logdet, mark) -> pa.RecordBatch:
    flat = [white[:, i, j] for i, j in _PAIRS]
    return pa.RecordBatch.from_arrays(
        [batch.column("g"), batch.column("start"), pa.array(list(centre)), pa.array(list(np.stack(flat, axis=1))), pa.array(logdet), pa.array(mark)],
        ["g", "start", "centre", "white", "logdet", "mark"],
    )


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            quarters = np.array([batch.column(f"q{k}").to_pylist() for k in range(DIM)])
            spread = ((quarters[:, :, 2] - quarters[:, :, 0]) / 1.349).T
            white, logdet = _whitened(spread[:, :, None] ** 2 * np.eye(DIM))
            yield _packed(batch, quarters[:, :, 1].T, white, logdet, np.zeros(len(logdet), np.int64))


def squared_distance() -> Column:
    """Squared Mahalanobis distance of the vector to the estimate beside it."""
    shifted = [F.col(f"x{i}") - F.col("centre")[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("white")[_PAIRS.index((i, j))] * shifted[j]
        total = total + part * part
    return total


def _concentrated(rows: DataFrame, estimates: DataFrame, factor: float) -> DataFrame:
    """New estimates from the ``INSIDE`` share of each group that is nearest to the old ones.

    Rows are counted and summed by steps of their distance; the steps up to the
    one that fills the share are taken whole, so no group is ever sorted.
    """
    near = rows.join(small(estimates.select(F.col("g").alias("_g"), "start", "centre", "white"), SENT_GROUPS), F.col("g") == F.col("_g"))
    step = F.floor(F.log2(squared_distance() + 2.0**-10) * OCTAVE).cast("int")
    summed = near.withColumn("step", step).groupBy("g", "start", "step").agg(*_sums())
    ahead = Window.partitionBy("g", "start").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("g", "start")
    taken = summed.withColumn("_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("_all", F.sum("n").over(whole))
    taken = taken.where(F.col("_before") < F.ceil(F.col("_all") * INSIDE))
    added = taken.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in SUM_NAMES])
    return added.mapInArrow(_estimating(factor), ESTIMATE_SCHEMA)


def covariance_estimates(rows: DataFrame) -> DataFrame:
    """``(g, centre, white)`` of the least determinant over all starts, one row per group of ``rows``."""
    kept = stage(rows.where(~F.col("base_failed")).select("g", "doc_id", *[f"x{k}" for k in range(DIM)]), "vectors")
    quarters = [F.percentile(f"x{k}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{k}") for k in range(DIM)]
    medians = kept.groupBy("g").agg(*quarters).withColumn("start", F.lit(0)).mapInArrow(_medians, ESTIMATE_SCHEMA)
    share = F.pmod(F.xxhash64("doc_id", *[f"x{k}" for k in range(DIM)]), F.lit(SHARES)).cast("int") + 1
    drawn = kept.withColumn("start", share).where(F.col("start") <= STARTS).groupBy("g", "start").agg(*_sums())
    factor = INSIDE / chi_square_share(chi_square_limit(INSIDE, DIM), DIM + 2)
    now = stage(medians.unionByName(drawn.mapInArrow(_estimating(1.0), ESTIMATE_SCHEMA)), "estimates")
    before = None
    for _ in range(STEPS):
        now = stage(_concentrated(kept, now, factor), "estimates")
        mark = now.agg(F.sum(F.xxhash64("g", "start", "mark").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            break
        before = mark
    best = now.groupBy("g").agg(F.min_by(F.struct("centre", "white"), F.struct("logdet", "start")).alias("b"))
    return best.select("g", "b.centre", "b.white")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``(doc_id, lang, source, n_words, ...COUNTS, base_failed, distance, kept)``, one row per row of ``docs``.

    Base rules first: a text of fewer than ``MIN_WORDS`` words, or with more
    than ``REPEAT_PERCENT`` percent of its words in repeated five-word windows,
    fails.  The others are kept if their Mahalanobis distance to the estimate
    of their language and source is within the limit that keeps ``KEPT`` of
    normally distributed rows.

    The covariance is scaled for the share of rows it comes from and gets
    ``FLOOR`` squared on its diagonal: most texts have no symbols or repeated
    lines at all, and without it the first one would be infinitely far away.
    Null languages and sources are values of their own.  Null and empty texts
    have no words and fail.  Null ids are kept, repeated rows are judged alike,
    a table without rows gives none, and other columns are not read.
    """
    rows = stage(grouped(stage(statistics(docs, id_col, text_col, groups), "statistics")), "grouped")
    made = stage(vectors(rows), "rated")
    found = stage(covariance_estimates(made).withColumnRenamed("g", "_g"), "estimate")
    joined = made.join(small(found, SENT_GROUPS), F.col("g") == F.col("_g"), "left")
    limit = math.sqrt(chi_square_limit(KEPT, DIM))
    far = F.when(~F.col("base_failed"), F.sqrt(squared_distance()))
    judged = joined.withColumn("distance", far).withColumn("kept", F.coalesce(F.col("distance") <= limit, F.lit(False)))
    return judged.select("doc_id", "lang", "source", "n_words", *COUNTS, "base_failed", "distance", "kept")
