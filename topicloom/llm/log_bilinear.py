"""Log-bilinear language model with noise-contrastive estimation (Mnih and Teh, 2012).

Units are the most frequent words, and for all other words classes by their
ending.  The vector of a unit is predicted from those of the two units before
it; scores are products with the units' vectors plus a bias.  Training
contrasts each token with noise drawn from the unit frequencies and needs no
normaliser; scoring divides by the sum over all units, kept per context.  A
word of a class has its share of the class, and each class keeps a share for
words never seen, so that all chances add up to one.

Every task trains on all its texts from the same start, and the parameters are
averaged by tokens.  Counts cover the whole vocabulary: the commonest words
are sent to all tasks, the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import REMEMBERED, chunks, row_id
from topicloom.staging import stage

WORDS = 1000
CLASSES = 256
DIM = 16
NOISE = 32
BATCH = 4096
RATE = 0.05
#: Words whose counts are sent to every task; the counts of all others are joined.
COMMON_WORDS = 400_000
#: Words a task counts before it passes them on.
COUNTED = 500_000
END = b"\n"


#: Marks at the end of a word that its class passes over.
MARKS = b".,;:!?*#&%$|"


class Classes(dict):
    """Class of each ending of three bytes, worked out once per ending."""

    def __missing__(self, ending: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[ending] = xxhash.xxh3_64_intdigest(ending) % CLASSES
        return value

    def of(self, words: Iterable[bytes], size: int) -> np.ndarray:
        """Classes that words have if they are no unit of their own, by their last three bytes."""
        return np.fromiter(map(self.__getitem__, [word.rstrip(MARKS)[-3:] for word in words]), np.int32, size)


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of lower-cased texts, for each token the place of its word among them, and where each text ends.

    The last word is the end; an empty one is no token and has no place.
    """
    lower = pa.array([text.lower() for text in texts], pa.binary())
    split = pc.ascii_split_whitespace(lower.view(pa.string()))
    held = split.flatten().dictionary_encode()
    place, starts = held.indices.to_numpy(), split.offsets.to_numpy()
    plain = held.dictionary.cast(pa.binary())
    _, offsets, data = plain.buffers()
    cuts, data = np.frombuffer(offsets, np.int32, len(plain) + 1).tolist(), data.to_pybytes() if data else b""
    words = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    if b"" in words:
        kept = place != words.index(b"")
        place, starts = place[kept], np.concatenate([[0], np.cumsum(kept)])[starts]
    ends = np.cumsum(np.diff(starts) + 1)
    tokens = np.full(ends[-1], len(words), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    tokens[inner] = place
    return [*words, END], tokens, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}
    classes = Classes()
    for batch in batches:
        for _, _, texts in chunks(batch):
            words, tokens, _ = coded(texts)
            for word, n in zip(words, np.bincount(tokens, minlength=len(words)).tolist()):
                if n:
                    held[word] = held.get(word, 0) + n
            if len(held) > COUNTED:
                yield _counted(held, classes)
                held = {}
    yield _counted(held, classes)


def _counted(held: dict[bytes, int], classes: Classes) -> pa.RecordBatch:
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(classes.of(held, len(held))), pa.array(np.fromiter(held.values(), np.int64, len(held)))], ["word", "cls", "n"])


@dataclass
class Model:
    tokens: int
    distinct: int
    #: Sorted hashes of the common words, their counts, and their units (-1: their class).
    names: np.ndarray
    counts: np.ndarray
    unit: np.ndarray
    units: int
    noise: np.ndarray
    class_total: np.ndarray
    class_unseen: np.ndarray
    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    pull: np.ndarray


def _sent(spark, model: Model):
    """The model's fields as a broadcast of plain arrays, which executors read without this package."""
    return spark.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(Model)))


class Lookup(dict):
    """A number for each word met; by it unit, count (-1: to be joined), class (-1: a unit of its own) and hash."""

    def __init__(self, model: Model):
        self.model = model
        self.ending = Classes()
        self._start()

    def _start(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.facts = [np.empty(REMEMBERED, kind) for kind in (np.int64, np.int64, np.int64, np.uint64)]
        self.filled = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def found(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """The facts of words not met before, all looked up at once."""
        own = self.model
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        cls = self.ending.of(words, len(words)).astype(np.int64)
        unit, count = np.full(len(words), -1, np.int64), np.full(len(words), -1, np.int64)
        if len(own.names):
            # in the order of the hashes, so that neighbours in the search lie side by side
            order = np.argsort(names)
            at = np.minimum(np.searchsorted(own.names, names[order]), len(own.names) - 1)
            same = own.names[at] == names[order]
            unit[order[same]], count[order[same]] = own.unit[at[same]], own.counts[at[same]]
        return np.where(unit >= 0, unit, WORDS + cls), count, np.where(unit >= 0, -1, cls), names

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Numbers of all tokens in a row, where each text ends, and the facts by number."""
        if len(self) > REMEMBERED:
            self._start()
        words, tokens, ends = coded(texts)
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))[tokens]
        if self.new:
            # only the words of this chunk that were not met before are looked up
            size = len(self)
            for k, (held, value) in enumerate(zip(self.facts, self.found(self.new))):
                if size > len(held):
                    held = self.facts[k] = np.resize(held, 2 * size)
                held[self.filled : size] = value
            self.new, self.filled = [], size
        return number, ends, [held[: self.filled] for held in self.facts]


def _contexts(units: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that; ``start`` where a text begins."""
    one, two = np.roll(units, 1), np.roll(units, 2)
    first = np.concatenate([[0], ends[:-1]])
    one[first], two[first] = start, start
    second = first + 1
    two[second[second < ends]] = start
    return one, two


def _add_rows(at: np.ndarray, *pairs: tuple[np.ndarray, np.ndarray]) -> None:
    """Add each row to the total at its place, for all ``(total, rows)``; places are under 2**16, which sort in linear time."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    placed = at[order]
    cut = np.flatnonzero(np.diff(placed, prepend=-1))
    for total, rows in pairs:
        total[placed[cut]] += np.add.reduceat(rows.take(order, axis=0), cut, axis=0)


class Trainer:
    """Adagrad on the contrast of tokens with shared noise."""

    def __init__(self, model: Model, seed: int):
        self.model = model
        self.random = np.random.default_rng(seed)
        self.context, self.target, self.bias, self.pull = (x.astype(np.float32).copy() for x in (model.context, model.target, model.bias, model.pull))
        self.sums = [np.full_like(x, 0.1) for x in (self.context, self.target, self.bias, self.pull)]
        self.cumulated = np.cumsum(model.noise)
        self.log_noise = np.log(model.noise).astype(np.float32) + np.float32(np.log(NOISE))

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        noise = np.minimum(np.searchsorted(self.cumulated, self.random.random(NOISE)), len(self.cumulated) - 1)
        # rows are picked by take, which is several times cheaper than an index
        a, b = self.context.take(one, axis=0), self.context.take(two, axis=0)
        state = (self.context * self.pull[0]).take(one, axis=0) + (self.context * self.pull[1]).take(two, axis=0)
        goal, other = self.target.take(word, axis=0), self.target[noise]
        good = np.einsum("ij,ij->i", state, goal) + (self.bias - self.log_noise)[word]
        bad = state @ other.T + (self.bias[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-bad, -30, 30)))
        d_state = up[:, None] * goal + down @ other
        d_context, d_target, d_bias = np.zeros_like(self.context), np.zeros_like(self.target), np.zeros_like(self.bias)
        _add_rows(np.concatenate([one, two]), (d_context, np.concatenate([d_state * self.pull[0], d_state * self.pull[1]])))
        _add_rows(
            np.concatenate([word, noise]), (d_target, np.concatenate([up[:, None] * state, down.T @ state])),
            (d_bias, np.concatenate([up, down.sum(axis=0)])),
        )
        d_pull = np.stack([np.einsum("ij,ij->j", d_state, a), np.einsum("ij,ij->j", d_state, b)])
        for value, slope, held in zip((self.context, self.target, self.bias, self.pull), (d_context, d_target, d_bias, d_pull), self.sums):
            slope /= np.float32(len(word) / 64)
            held += slope * slope
            value += RATE * slope / np.sqrt(held)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.bias, self.pull)])


def _train(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        lookup, trainer, seen = Lookup(model), Trainer(model, 1), 0
        for batch in batches:
            for _, _, texts in chunks(batch):
                number, ends, facts = lookup.tokens(texts)
                unit = facts[0][number]
                one, two = _contexts(unit, ends, model.units)
                order = trainer.random.permutation(len(unit))
                for at in range(0, len(order), BATCH):
                    rows = order[at : at + BATCH]
                    trainer.step(unit[rows], one[rows], two[rows])
                seen += len(unit)
        if seen:
            flat = trainer.flat()
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([flat.astype(np.float64)], pa.list_(pa.float64()))], ["weight", "values"])

    return run


def train(docs: DataFrame, allowed: Column, text_col: str = "text") -> tuple[Model, DataFrame]:
    """A model fitted to all rows that ``allowed`` admits, and ``(word, c)``: the counts of their words.

    To the driver come the counts of at most ``COMMON_WORDS`` words, two sums
    per class, and one parameter set, whatever the size of the corpus.
    """
    spark = docs.sparkSession
    texts = docs.where(allowed).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count, "word long, cls int, n long")
    counts = stage(counted.groupBy("word").agg(F.min("cls").alias("cls"), F.sum("n").alias("c")), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = None, 0
    for lev, n in sizes:
        if held + n > COMMON_WORDS:
            break
        least, held = lev, held + n
    common = counts.where(level >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    names, number, cls = common.column("word").to_numpy().view(np.uint64), common.column("c").to_numpy(), common.column("cls").to_numpy()
    order = np.argsort(names)
    names, number, cls = names[order], number[order], cls[order]
    # the units of their own are the commonest words, equal counts by hash
    top = np.lexsort((names, -number))[:WORDS]
    unit = np.full(len(names), -1, np.int32)
    unit[top] = np.arange(len(top))
    by = counts.groupBy("cls").agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    total, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by:
        total[r["cls"]], once[r["cls"]] = r["c"], r["once"]
    np.subtract.at(total, cls[top], number[top])
    np.subtract.at(once, cls[top], (number[top] == 1).astype(float))
    mass = np.concatenate([np.zeros(WORDS), total]) + 0.5
    mass[: len(top)] += number[top]
    random = np.random.default_rng(7)
    size = WORDS + CLASSES
    model = Model(
        int(tokens), int(distinct), names, number, unit, size, mass / mass.sum(), total, np.where(total > 0, (once + 0.5) / (total + 1), 1.0),
        random.normal(0, 0.1, (size + 1, DIM)), random.normal(0, 0.1, (size, DIM)), np.log(mass / mass.sum()), np.ones((2, DIM)),
    )
    if tokens:
        parts = texts.mapInArrow(_train(_sent(spark, model)), "weight double, values array<double>")
        parts = stage(parts, "parameters").select("weight", F.posexplode("values").alias("i", "v"))
        mean = parts.groupBy("i").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v")).toArrow()
        flat = np.empty(mean.num_rows)
        flat[mean.column("i").to_numpy()] = mean.column("v").to_numpy()
        shapes = [model.context.shape, model.target.shape, model.bias.shape, model.pull.shape]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        model.context, model.target, model.bias, model.pull = (x.reshape(s) for x, s in zip(np.split(flat, cuts), shapes))
    return model, counts.select("word", "c")


class Scorer:
    """Normalised log10 chances of units, with one remembered sum per context; ``sums`` are those known before, by context."""

    def __init__(self, model: Model, sums: np.ndarray | None = None):
        self.model = model
        self.context, self.target = model.context.astype(np.float32), model.target.astype(np.float32)
        self.bias, self.pull = model.bias.astype(np.float32), model.pull.astype(np.float32)
        self.sums = np.full((model.units + 1) ** 2, np.nan, np.float32) if sums is None else sums
        self.whole = sums is not None
        # what a unit adds to the state as the last and as the one before
        self.last, self.before = self.context * self.pull[0], self.context * self.pull[1]

    def score(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one * (self.model.units + 1) + two
        if not self.whole:
            fresh = np.zeros(len(self.sums), bool)
            fresh[key] = True
            self.fill(np.flatnonzero(fresh & np.isnan(self.sums)))
        state = self.last.take(one, axis=0) + self.before.take(two, axis=0)
        return (np.einsum("ij,ij->i", state, self.target.take(word, axis=0)) + self.bias.take(word) - self.sums.take(key)) / np.float32(np.log(10))

    def fill(self, new: np.ndarray) -> None:
        for at in range(0, len(new), 256):
            # few contexts at once and in place, so that their scores stay in the cache
            part = new[at : at + 256]
            state = self.last[part // (self.model.units + 1)] + self.before[part % (self.model.units + 1)]
            logits = state @ self.target.T
            logits += self.bias
            most = logits.max(axis=1)
            logits -= most[:, None]
            self.sums[part] = most + np.log(np.exp(logits, out=logits).sum(axis=1))


#: Texts from which on the sums of all contexts are worked out once, instead of those met in each task.
MANY_TEXTS = 20_000


def _sums(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(Model(*held.value))
            for last in batch.column("id").to_pylist():
                own = np.arange(last * (scorer.model.units + 1), (last + 1) * (scorer.model.units + 1))
                scorer.fill(own)
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([scorer.sums[own]], pa.list_(pa.float32()))], ["last", "sums"])

    return run


def context_sums(spark, model: Model, held) -> np.ndarray:
    """The sums over all units for each pair of units before, worked out by many tasks: ``(units + 1) ** 2`` floats."""
    found = spark.range(0, model.units + 1, 1, 4 * spark.sparkContext.defaultParallelism).mapInArrow(_sums(held), "last long, sums array<float>").toArrow()
    rows = np.empty((model.units + 1, model.units + 1), np.float32)
    rows[found.column("last").to_numpy()] = found.column("sums").combine_chunks().flatten().to_numpy().reshape(rows.shape)
    return rows.ravel()


def _score(held, sums=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        lookup, scorer = Lookup(model), Scorer(model, None if sums is None else sums.value)
        floor = model.tokens + 0.5 * (model.distinct + 1)
        for batch in batches:
            for start, stop, texts in chunks(batch):
                number, ends, facts = lookup.tokens(texts)
                units, counts, classes, names = facts
                # chances that hang on the word alone are worked out once per word met
                met = counts >= 0
                word_base = np.where(met, np.log10((np.maximum(counts, 0) + 0.5) / floor), 0.0)
                inside, word_share = np.flatnonzero(met & (classes >= 0)), np.zeros(len(counts))
                c = classes[inside]
                word_share[inside] = np.log10(counts[inside] / model.class_total[c] * (1 - model.class_unseen[c]))
                unit, known, base = units[number], met[number], word_base[number]
                begins = np.concatenate([[0], ends[:-1]])
                one, two = _contexts(unit, ends, model.units)
                value = scorer.score(unit, one, two).astype(np.float64) + word_share[number]
                rare = np.flatnonzero(~known)
                name, cls = names[number[rare]], classes[number[rare]]
                offsets = np.searchsorted(rare, np.concatenate([begins, [len(unit)]])).astype(np.int32)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), pa.array(ends - begins), pa.array(np.add.reduceat(known.astype(np.int64), begins)),
                        pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(value, begins)),
                        pa.ListArray.from_arrays(offsets, pa.array(name.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(cls.astype(np.int32))),
                    ],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "cls"],
                )

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``: one row per input row.

    Tokens are the words of the whole text in lower case (A-Z) and one end;
    ``score`` is the sum of their log10 chances under the model and
    ``base_score`` under the smoothed word frequencies.  Words that are not
    among the common ones meet their counts in a join by word.  A null or
    empty text is one end.  If nothing was learned, every token is the one
    unseen word, with chance 1.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.monotonically_increasing_id().alias("row"), row_id(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, cls array<int>"
    held = _sent(spark, model)
    many = model.tokens and docs.limit(MANY_TEXTS).count() == MANY_TEXTS
    sums = spark.sparkContext.broadcast(context_sums(spark, model, held)) if many else None
    part = stage(plain.mapInArrow(_score(held, sums), columns), "scored")
    # a row's number holds from here on, since the table is written
    rare = part.select("row", F.explode(F.arrays_zip("rare", "cls")).alias("t")).groupBy("row", F.col("t.rare").alias("word"), F.col("t.cls").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    met = rare.join(counts.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    floor = model.tokens + 0.5 * (model.distinct + 1)
    shares = spark.createDataFrame([(i, float(t), float(u)) for i, (t, u) in enumerate(zip(model.class_total, model.class_unseen))], "_c int, _total double, _unseen double")
    met = met.join(F.broadcast(shares), F.col("cls") == F.col("_c"))
    share = F.when(F.col("c") > 0, F.col("c") / F.col("_total") * (1 - F.col("_unseen"))).otherwise(F.col("_unseen"))
    sums = met.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"), F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(floor))).alias("_base"), F.sum(F.col("n") * F.log10(share)).alias("_score")
    )
    out = part.drop("rare", "cls").join(sums, F.col("row") == F.col("_row"), "left")
    none = F.lit(0.0)
    learned = F.coalesce("_score", none) + F.col("score") if model.tokens else none
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", none)).alias("base_score"), learned.alias("score"),
    )
