"""Topic keywords by class-based TF-IDF on long ``(topic, term)`` tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from topicloom.functions import text as T
from topicloom.staging import stage

def topic_term_counts(
    docs: DataFrame,
    text_col: str,
    topic_col: str = "topic",
    stopwords: Sequence[str] | DataFrame = (),
    ngram_range: tuple[int, int] = (1, 1),
    cross_docs: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """``(topic, term, n)``; stopwords go before n-grams are built.

    A table of stopwords may have any size: it is joined away from the words of
    the texts and never fetched.

    Counting is partial before the shuffle and keyed by topic and term (n-grams:
    by topic and first words), so a topic with a third of all rows spreads.  ``cross_docs`` adds
    the n-grams that run over the border of two texts of a topic in the order of
    the unique ``order_col``, as if the texts of a topic were one text.
    """
    low, high = ngram_range
    if high == 1:
        terms = docs.select(F.col(topic_col).alias("topic"), F.explode(T.tokens(F.col(text_col))).alias("term"))
        if isinstance(stopwords, DataFrame):
            terms = terms.join(stopwords.select(F.col(stopwords.columns[0]).alias("term")), "term", "left_anti").select("topic", "term")
        elif stopwords:
            terms = terms.where(~F.col("term").isin(*stopwords))
    else:
        listed = word_lists(docs, text_col, topic_col, order_col, stopwords)
        runs = run_counts(listed, low, high)
        if cross_docs:
            if order_col is None:
                raise ValueError("cross_docs needs a unique order_col")
            border = border_ngrams(listed, low, high)
            runs = runs.unionByName(border.select("topic", F.col("term").alias("run"), F.lit(True).alias("whole"), F.lit(1).cast("long").alias("n")))
        return ngram_counts(runs, low, high, docs.rdd.getNumPartitions())
    return terms.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))


#: Runs of words a task counts before it passes them on.
COUNTED = 500_000
#: Partitions of the counts per partition of the texts at least, so that a partition is counted in memory.
SPREAD = 8


def run_counts(listed: DataFrame, low: int, high: int) -> DataFrame:
    """``(topic, run, whole, n)``: counts of the longest run of at most ``high`` words from each place on.

    A run stands for its beginnings of ``max(2, low)`` words and more too, so each
    place travels once; one that is ``whole``, as single words are, stands for
    itself.  Counts are partial, and a task holds a bounded number of them.
    """
    kind = listed.schema["topic"].dataType
    least = max(2, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, long, single = {}, {}, {}

        def counted() -> Iterator[pa.RecordBatch]:
            for held, whole in ((long, False), (single, True)):
                for key, counts in held.items():
                    size = len(counts)
                    if size:
                        same = pa.array([topics[key]], to_arrow_type(kind)).take(pa.array(np.zeros(size, np.int64)))
                        yield pa.RecordBatch.from_arrays(
                            [same, pa.array(list(counts), pa.string()), pa.array(np.full(size, whole)), pa.array(np.fromiter(counts.values(), np.int64, size))],
                            ["topic", "run", "whole", "n"],
                        )
                    counts.clear()

        for batch in batches:
            # values of any kind, a struct's too, are told apart by how they are written
            for topic, words in zip(batch.column("topic").to_pylist(), batch.column("words")):
                words = words.as_py()
                if not words:
                    continue
                key = repr(topic)
                if key not in topics:
                    topics[key], long[key], single[key] = topic, Counter(), Counter()
                long[key].update(map(" ".join, zip(*(words[i:] for i in range(high)))))
                tail = max(0, len(words) - high + 1)
                long[key].update(" ".join(words[i:]) for i in range(tail, len(words) - least + 1))
                if low == 1:
                    single[key].update(words)
                if sum(map(len, long.values())) + sum(map(len, single.values())) > COUNTED:
                    yield from counted()
        yield from counted()

    schema = S.StructType([S.StructField("topic", kind), S.StructField("run", S.StringType()), S.StructField("whole", S.BooleanType()), S.StructField("n", S.LongType())])
    return listed.select("topic", "words").mapInArrow(run, schema)


def ngram_counts(runs: DataFrame, low: int, high: int, inputs: int) -> DataFrame:
    """``(topic, term, n)`` from ``run_counts``: dealt by the words that all n-grams of a run begin with, in one shuffle."""
    least = max(2, low)
    spark = runs.sparkSession
    begin = F.substring_index("run", " ", least)
    dealt = runs.select("topic", begin.alias("begin"), F.substring(F.col("run"), F.length(begin) + 2, F.length("run")).alias("rest"), "whole", "n")
    dealt = dealt.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), SPREAD * inputs), "topic", "begin")
    rest = F.nullif(F.col("rest"), F.lit(""))
    full = F.concat_ws(" ", "begin", rest)
    shorter = [F.concat_ws(" ", "begin", F.substring_index(rest, " ", n)) for n in range(1, high - least)]
    terms = F.when(F.col("whole"), F.array(full)).otherwise(F.array_distinct(F.array("begin", *shorter, full)))
    terms = dealt.select("topic", "begin", F.explode(terms).alias("term"), "n")
    return terms.groupBy("topic", "begin", "term").agg(F.sum("n").alias("n")).select("topic", "term", "n")


def changed_counts(
    counts: DataFrame, changes: DataFrame, text_col: str, old_col: str = "old_topic", new_col: str = "new_topic",
    stopwords: Sequence[str] | DataFrame = (), ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """``(topic, term, n)`` after the texts of ``changes`` have gone from one topic to another.

    A null old topic is a new text, a null new topic a text that goes.  Only the
    changed texts are counted, with a sign for each side; their sums are added
    to the kept counts, and terms whose count falls to zero leave the table.
    """
    moved = changes.where(~F.col(old_col).eqNullSafe(F.col(new_col)))
    sides = [(F.col(new_col), 1), (F.col(old_col), -1)]
    both = moved.withColumn("_side", F.explode(F.array(*[F.struct(topic.alias("topic"), F.lit(sign).alias("sign")) for topic, sign in sides])))
    both = both.where(F.col("_side.topic").isNotNull()).select("_side", F.col(text_col).alias("_text"))
    # the pair of topic and sign counts like a topic, so texts are tokenised once per side
    signed = topic_term_counts(both, "_text", "_side", stopwords, ngram_range)
    deltas = signed.select(F.col("topic.topic").alias("topic"), "term", (F.col("n") * F.col("topic.sign")).alias("n"))
    added = counts.select("topic", "term", "n").unionByName(deltas).groupBy("topic", "term").agg(F.sum("n").alias("n"))
    return added.where("n <> 0")


def word_lists(
    docs: DataFrame, text_col: str, topic_col: str, order_col: str | None, stopwords: Sequence[str] | DataFrame
) -> DataFrame:
    """``(topic, ord, words)`` of every text without the stopwords; ``ord`` is null without ``order_col``.

    Words of a table are joined away one by one and the rest is put together
    again per row, which is never more than one text in a group.
    """
    order = F.lit(None) if order_col is None else F.col(order_col)
    words = T.tokens(F.col(text_col))
    if not isinstance(stopwords, DataFrame):
        return docs.select(F.col(topic_col).alias("topic"), order.alias("ord"), T.drop_words(words, stopwords).alias("words"))
    listed = docs.select(F.col(topic_col).alias("topic"), order.alias("ord"), words.alias("words"))
    listed = stage(listed.withColumn("_row", F.monotonically_increasing_id()), "listed")
    stops = stopwords.select(F.col(stopwords.columns[0]).alias("word"))
    left = listed.select("_row", F.posexplode("words").alias("at", "word")).join(stops, "word", "left_anti")
    left = left.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    kept = left.select("_row", F.transform("w", lambda x: x["word"]).alias("words"))
    return listed.drop("words").join(kept, "_row").select("topic", "ord", "words")


def border_ngrams(listed: DataFrame, low: int, high: int) -> DataFrame:
    """n-grams over text borders of ``(topic, ord, words)``: ``(topic, term)``, one row per occurrence.

    Each text gets the position of its first word inside its topic: words of
    earlier texts of its range partition plus words of earlier partitions.  Only
    the first and last ``high - 1`` words of a text can be part of a border
    n-gram; they are sent to the start positions they may belong to, so a group
    holds at most ``high`` words.
    """
    edge = high - 1
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    size = F.size("words")
    # Both ends of the list; the second piece starts behind the first, so no word is sent twice.
    ends = F.concat(F.slice(numbered, 1, edge), F.slice(numbered, F.greatest(size - edge, F.lit(edge)) + 1, edge))
    narrow = listed.select("topic", "ord", size.alias("size"), ends.alias("edges")).where(F.col("size") > 0)
    # Range partitioning reads its input twice, once for a sample; the texts are read once for both.
    narrow = stage(narrow, "edges")
    ranged = stage(narrow.repartitionByRange("topic", "ord").withColumn("_part", F.spark_partition_id()), "borders")
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("topic", "_part").agg(F.sum("size").alias("_size"))
    offsets = parts.select("topic", "_part", F.coalesce(F.sum("_size").over(earlier("topic", "_part")), F.lit(0)).alias("_offset"))
    placed = ranged.withColumn("_local", F.coalesce(F.sum("size").over(earlier("_part", "topic", "ord")), F.lit(0)))
    placed = placed.join(offsets, ["topic", "_part"])
    edges = placed.select("topic", "ord", (F.col("_offset") + F.col("_local")).alias("first"), F.explode("edges").alias("e"))
    terms = None
    for n in range(max(2, low), high + 1):
        sent = edges.select(
            "topic", "ord", "e.word", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"),
            (F.col("first") + F.col("e.at")).alias("pos"),
        ).withColumn("start", F.col("pos") - F.col("slot"))
        grouped = sent.groupBy("topic", "start").agg(
            F.sort_array(F.collect_list(F.struct("slot", "word"))).alias("run"),
            F.min("ord").alias("_from"), F.max("ord").alias("_to"),
        ).where((F.size("run") == n) & (F.col("_from") != F.col("_to")))
        one = grouped.select("topic", F.array_join(F.transform("run", lambda s: s["word"]), " ").alias("term"))
        terms = one if terms is None else terms.unionByName(one)
    return terms


def class_tf_idf(counts: DataFrame, documents: DataFrame | Column) -> DataFrame:
    """``(topic, term, n, tf, idf, score)`` with ``score = n / w * ln(m / sum_t)``.

    ``m`` is the number of documents, ``w`` the words of the topic, ``sum_t`` the
    count of the term in all topics.  Only terms that occur in a topic are scored.
    """
    m = documents.agg(F.count(F.lit(1)).alias("m")).scalar() if isinstance(documents, DataFrame) else documents
    per_topic = counts.groupBy("topic").agg(F.sum("n").alias("w"))
    per_term = counts.groupBy("term").agg(F.sum("n").alias("sum_t"))
    # The adaptive planner picks hash tables only where the measured partitions fit;
    # a term of all topics is on the side that it can split.
    joined = counts.join(per_term, "term").join(per_topic, "topic")
    return joined.select(
        "topic", "term", "n",
        (F.col("n") / F.col("w")).alias("tf"),
        F.log(m / F.col("sum_t")).alias("idf"),
    ).withColumn("score", F.col("tf") * F.col("idf"))


def top_terms(scored: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """``(topic, rank, term, score)``: the best ``n`` terms, equal rounded scores by term.

    The rank filter is applied in every task before the shuffle, so at most ``n``
    rows per topic and task travel.
    """
    scored = scored.select("topic", "term", F.round("score", digits).alias("score"))
    order = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("topic", "rank", "term", "score")


def topic_keywords(
    docs: DataFrame,
    text_col: str,
    n: int,
    topic_col: str = "topic",
    stopwords: Sequence[str] | DataFrame = (),
    ngram_range: tuple[int, int] = (1, 1),
    cross_docs: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """``(topic, keywords array)``, best first; a topic without words has an empty list."""
    counts = topic_term_counts(docs, text_col, topic_col, stopwords, ngram_range, cross_docs, order_col)
    # The counts feed three branches; written once, the texts are tokenised once.
    counts = stage(counts, "terms")
    best = top_terms(class_tf_idf(counts, docs), n)
    lists = best.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_terms"))
    lists = lists.select("topic", F.transform("_terms", lambda s: s["term"]).alias("keywords"))
    topics = docs.select(F.col(topic_col).alias("topic")).distinct()
    empty = F.array().cast("array<string>")
    return topics.join(lists, "topic", "left").select("topic", F.coalesce("keywords", empty).alias("keywords"))


def attach_keywords(docs: DataFrame, keywords: DataFrame, topic_col: str = "topic", out: str = "keywords") -> DataFrame:
    """Rows with the joined keyword list of their topic; the topic table is broadcast when it is small."""
    joined = keywords.select(F.col("topic").alias(topic_col), T.join_keywords(F.col("keywords")).alias(out))
    return docs.join(joined, topic_col, "left")
