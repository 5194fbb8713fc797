"""Document fingerprints by I-Match with randomised lexicons (Chowdhury et al., 2002; Kolcz et al., 2004).

Terms within a band of inverse document frequency form the lexicon.  Random
subsets of it are drawn at several rates; of each subset, a text's distinct
terms are sorted and hashed.  A text changed in part keeps the hashes of the
subsets that the change does not touch; sparse subsets serve long texts and
dense ones short texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import MIX, REMEMBERED, WordHasher, chunks, mixed, row_id, split_words, text_keys
from topicloom.staging import stage

#: Band: terms in at least one of so many texts, and in at most this share of them.
RAREST = 2000
COMMONEST = 0.1
RATES = (1, 4, 16, 64)
SUBSETS = 16
#: Terms that the lexicon may have to be sent to every task as hashes of 8 bytes.
LEXICON_TERMS = 4_000_000
#: Terms a task counts before it passes them on.
COUNTED = 500_000
EDGE = b".,;:!?\"'()[]{}|*#&%$"


class Terms(WordHasher):
    """Hash of a word in lower case without marks at its ends; 0 outside the lexicon or for marks alone."""

    def __init__(self, lexicon: np.ndarray | None = None):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        term = word.lower().strip(EDGE)
        value = xxhash.xxh3_64_intdigest(term) if term else 0
        if value and self.lexicon is not None:
            at = np.searchsorted(self.lexicon, np.uint64(value))
            if at == len(self.lexicon) or int(self.lexicon[at]) != value:
                value = 0
        self[word] = value
        return value


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each term, passed on whenever enough terms are counted."""
    terms, held = Terms(), {}
    for batch in batches:
        for _, _, texts in chunks(batch):
            for text in texts:
                for h in {terms[w] for w in set(text.split())}:
                    held[h] = held.get(h, 0) + 1
            if len(held) > COUNTED:
                yield _counts(held)
                held = {}
    yield _counts(held)


def _counts(held: dict[int, int]) -> pa.RecordBatch:
    held.pop(0, None)
    names = np.fromiter(held.keys(), np.uint64, len(held)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.fromiter(held.values(), np.int64, len(held)))], ["term", "n"])


def lexicon(docs: DataFrame, text_col: str = "text", rarest: int = RAREST, commonest: float = COMMONEST) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all texts.

    A term of the band is in at least one of ``rarest`` texts, so the lexicon
    has at most ``rarest`` times as many terms as a text has on average,
    however large the corpus.  Its size is counted before it is fetched.
    """
    total = docs.count()
    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_document_counts, "term long, n long")
    sums = counted.groupBy("term").agg(F.sum("n").alias("n"))
    band = stage(sums.where((F.col("n") >= max(1, total / rarest)) & (F.col("n") <= max(1, total * commonest))).select("term"), "lexicon")
    if band.count() > LEXICON_TERMS:
        raise ValueError(f"the band holds more than {LEXICON_TERMS} terms; narrow it with a smaller rarest")
    return np.sort(band.toArrow().column("term").to_numpy().view(np.uint64))


def fingerprints(texts: list[bytes], terms: Terms) -> np.ndarray:
    """``(texts, rates x subsets)`` 16-bit hashes; 0 where a text has no term of the subset.

    A text with words but no term in any subset has hashes of all its terms instead.
    """
    words, sizes = split_words(texts)
    names = terms.hash(words)
    owner = np.repeat(np.arange(len(texts)), sizes)
    known = names != 0
    names, owner = names[known], owner[known]
    out = np.zeros((len(texts), len(RATES) * SUBSETS), np.uint16)
    for k, rate in enumerate(RATES):
        place = mixed(names + np.array([k + 1], np.uint64) * MIX) % np.uint64(SUBSETS * rate)
        chosen = place < SUBSETS
        if not chosen.any():
            continue
        term, slot = names[chosen], owner[chosen] * SUBSETS + place[chosen].astype(np.int64)
        order = np.lexsort((term, slot))
        term, slot = term[order], slot[order]
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (slot[1:] != slot[:-1])
        term, slot = term[first], slot[first]
        start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        turn = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        value = mixed(np.add.reduceat(mixed(term + turn.astype(np.uint64) * MIX), start))
        short = np.maximum(value >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        out[slot[start] // SUBSETS, k * SUBSETS + slot[start] % SUBSETS] = short
    for i in np.flatnonzero((sizes > 0) & ~out.any(axis=1)):
        own = set(texts[i].split())
        # marks alone are no terms; such a text is known by its marks
        all_terms = {w.lower().strip(EDGE) for w in own} - {b""} or own
        whole = np.uint64(xxhash.xxh3_64_intdigest(b" ".join(sorted(all_terms))))
        value = mixed(np.full(out.shape[1], whole) + np.arange(out.shape[1], dtype=np.uint64) * MIX)
        out[i] = np.maximum(value >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets that either text has terms of; 1 if neither has any, both being without words."""
    some = (a != 0) | (b != 0)
    n = some.sum(axis=1)
    return np.where(n > 0, ((a == b) & some).sum(axis=1) / np.maximum(n, 1), (a == b).all(axis=1).astype(float))


def _hex(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def fingerprint(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of each row's whole text; null counts as empty, an empty text has all zeros."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(held.value)
        for batch in batches:
            for start, stop, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), pa.array(_hex(fingerprints(texts, terms)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(row_id(id_col), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``(bucket, ghost, doc_id, text)`` dealt and sorted so that each row's next one follows it.

    Rows run by descending id, nulls last, rows of one id by the hash of their
    text.  They are dealt to ranges of ids with fixed borders; after the last
    row of a range comes a ghost, a copy of the first row of the next range, so
    no order over all rows is needed.  The last range has the very first row
    as its ghost.  There are as many ghosts as ranges.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    borders = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)))
    edges = F.array(*[F.lit(int(b)) for b in borders]) if borders else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))))
    rows = docs.select(bucket.cast("int").alias("bucket"), F.lit(False).alias("ghost"), "doc_id", *text_keys(F.col("text")), "text")
    heads = {r["bucket"]: r["top"] for r in docs.select(bucket.cast("int").alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    if not heads:
        return rows
    down = sorted(heads, reverse=True)
    before = {b: down[i - 1] for i, b in enumerate(down)}
    top = spark.createDataFrame([(b, heads[b], before[b]) for b in down], "_b int, _top long, _to int")
    first = rows.join(F.broadcast(top), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    ghosts = first.groupBy("_to").agg(F.min_by(F.struct("doc_id", "_h1", "_h2", "text"), F.struct("_h1", "_h2")).alias("r"))
    ghosts = ghosts.select(F.col("_to").alias("bucket"), F.lit(True).alias("ghost"), "r.doc_id", "r._h1", "r._h2", "r.text")
    return rows.union(ghosts).repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "_h1", "_h2")


def edit_report(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per input row.

    The edited text has the last third of the code points replaced by the
    first as many of the next row's text; ``near_*`` is the likeness of the
    row's fingerprint to that of the edited and of the next text.  Null texts
    are empty.  A single row is its own next.  An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(words)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def report(rows: list[tuple], terms: Terms) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        pairs = [(a, b) for a, b in zip(range(len(rows) - 1), range(1, len(rows))) if not rows[a][1] and rows[a][0] == rows[b][0]]
        plain = [texts[a].decode("utf-8", "replace") for a, _ in pairs]
        edited = []
        for (_, b), text in zip(pairs, plain):
            cut = len(text) // 3
            # a code point has four bytes at most
            head = texts[b][: 4 * cut].decode("utf-8", "ignore")[:cut]
            edited.append((text[: len(text) - cut] + head).encode("utf-8", "surrogatepass"))
        own, other = fingerprints(texts, terms), fingerprints(edited, terms)
        at, to = np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[a][2] for a in at], pa.int64()), pa.array([len(t) for t in plain], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()), pa.array(_hex(own[at]), pa.string()), pa.array(_hex(other), pa.string()),
                pa.array(likeness(own[at], other)), pa.array(likeness(own[at], own[to])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, last = Terms(held.value), []
        for batch in batches:
            facts = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id")]))
            for start, stop, texts in chunks(batch, limit=1 << 20):
                rows = last + [(*f, t) for f, t in zip(facts[start:stop], texts)]
                yield report(rows, terms)
                last = rows[-1:]

    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(plain).select("bucket", "ghost", "doc_id", "text").mapInArrow(run, columns)
