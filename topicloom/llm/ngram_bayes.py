"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams per language are gathered over all training texts;
their logarithms form one matrix, sent to all tasks, and a batch of texts is
scored by gathering the rows of its n-grams and adding them up per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import chunks, row_id

ORDERS = (1, 2, 3)
BITS = 15
SMOOTH = 0.5
UNKNOWN = "und"
CHUNK = 1 << 19
#: Bytes that the matrix may have; it is languages x 2**bits doubles, whatever the corpus.
MATRIX_BYTES = 256 * 1024 * 1024


_HELD: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters; found once and kept."""
    if not _HELD:
        _HELD["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _HELD["letters"]


def ngrams(texts: list[bytes], bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per order the buckets of all n-grams and the text of each; and which texts have a letter.

    Texts are lower-cased; whatever is no letter is a gap, neighbouring gaps are one.
    """
    plain = [t.decode("utf-8", "replace").lower() for t in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(plain), dtype=np.int32), sizes)
    letter = _letters()[code]
    some = np.zeros(len(plain), bool)
    some[owner[letter]] = True
    keep = letter.copy()
    # a gap belongs to the word before it in its own text, whatever text came before
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    code, owner = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep]
    out = []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            out.append((np.empty(0, np.int64), np.empty(0, np.int32)))
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ code[j : m + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        same = owner[:m] == owner[n - 1 :]
        out.append(((h >> np.uint64(64 - bits)).astype(np.int64)[same], owner[:m][same]))
    return out, some


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: ``(2**bits, languages)`` logarithms of the chances of the n-grams.
    matrix: np.ndarray
    bits: int


def _count(index: dict[str, int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        total = np.zeros(len(index) * size, np.int64)
        for batch in batches:
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for start, stop, texts in chunks(batch, limit=CHUNK):
                for bucket, owner in ngrams(texts, bits)[0]:
                    total += np.bincount(lang[start:stop][owner] * size + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


def train(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> Model:
    """Counts over all rows that ``allowed`` admits and that have a language and a text.

    Languages are few; the matrix has a row of ``2**bits`` for each, and its
    size is checked before anything is counted.
    """
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    most = MATRIX_BYTES // (8 << bits)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages; lower bits to make room for them")
    languages = sorted(sizes)
    cells = rows.mapInArrow(_count({x: i for i, x in enumerate(languages)}, bits), "cell long, n long")
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) << bits)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(len(languages), 1 << bits) + SMOOTH
    prior = np.log(np.array([sizes[x] for x in languages], float) / max(1, sum(sizes.values())))
    return Model(languages, prior, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T), bits)


def posteriors(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(texts, languages)`` chances, and which texts have a letter."""
    grams, some = ngrams(texts, model.bits)
    total = np.tile(model.prior, (len(texts), 1))
    for bucket, owner in grams:
        if len(bucket):
            at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[at]] += np.add.reduceat(model.matrix[bucket], at, axis=0)
    total = np.exp(total - total.max(axis=1, keepdims=True)) if total.size else total
    return total / total.sum(axis=1, keepdims=True) if total.size else total, some


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``: one row per input row, from its whole text alone.

    ``score`` is the chance of the predicted language; ties go to the first by
    name.  A null or empty text, or one without a letter, is ``und`` with score
    0, and so is every text if nothing was learned.  An empty table gives no
    rows.
    """
    # plain values, which executors read without this package
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.matrix, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for start, stop, texts in chunks(batch, limit=CHUNK):
                if not own.languages:
                    continue
                chance, some = posteriors(own, texts)
                lang[start:stop] = np.where(some, chance.argmax(axis=1), len(names) - 1)
                score[start:stop] = np.where(some, chance.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[lang], pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "lang_pred", "score"])

    plain = docs.select(row_id(id_col), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")
