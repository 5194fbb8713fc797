"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The texts of a source, in shuffled order, are a stream of words cut into
blocks of equal length.  Slot ``i`` of the schedule has the golden-ratio point
``frac(i * phi)``; the cumulative weights map it to a source, so every stretch
of the schedule is near the target mix.  The slots of a source are ranked, and
rank ``r`` takes block ``r`` of its stream, starting over after the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import GAP, WORD, packed, ranked, row_order
from topicloom.staging import stage

#: Slots that an average source gets; a block is an average source's share of words over this.
SLOTS = 2048
#: Points are multiples of 2**-31; this is 2**31 divided by the golden ratio.
TURN = 1327217885
CIRCLE = 1 << 31
CELLS = 4096
REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; together they get
    100% of all words.  No target exceeds ``repeats`` times its source's size;
    the excess is shared out again by weight until none is above.  Only three
    sums per round reach the driver.
    """
    # sources are few against rows, but still ranked without a sort of all of them by one task per round
    place = Window.orderBy(F.col("source").isNull(), "source")
    weighed = stage(sizes.withColumn("weight", ((F.row_number().over(place) - 1) % 3 + 1).cast("double")), "weights")
    most = F.col("source_size") * F.lit(repeats)
    level = 0.0
    while True:
        capped = most <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.sum("source_size"), F.sum(F.when(capped, most).otherwise(F.lit(0))), F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight")))
        ).first()
        total, taken, free = (x or 0 for x in row)
        new = (total - taken) / free if free else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = REPEATS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``(rows, pieces)``: the sized rows, and what the schedule takes of them.

    ``rows`` has ``(row, doc_id, source, size, source_size, target)``, one per
    input row.  ``pieces`` has ``(slot, source, rank, pass, row, doc_id, start,
    words)``: in schedule order, ``words`` words of a row from word ``start``
    on, in the given pass over its source.  Each source gives its target,
    rounded to whole words, and no row more than ``repeats`` times its size.

    Null or empty texts have size 0 and are never taken.  A null source is a
    source.  Rows with equal or null ids are told apart only by their place in
    an order by hash, id and size, so equal rows are interchangeable.  An empty
    table gives empty results.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    base = stage(base, "sized")
    targets = target_sizes(base.groupBy("source").agg(F.sum("size").alias("source_size")), repeats)
    targets = stage(targets.withColumn("budget", F.round("target").cast("long")), "targets")
    total, count = targets.agg(F.sum("budget"), F.count(F.lit(1))).first()
    block = max(1, math.ceil((total or 0) / (max(count, 1) * slots)))
    rows = _offsets(base, targets)
    # every source gets at least four points' width, so that each has a slot for each block it owes
    width = targets.withColumn("_width", F.col("budget") + F.lit(block)).where("budget > 0")
    sum_width = width.agg(F.sum("_width")).first()[0] or 0
    points = 4 * math.ceil(sum_width / block)
    before = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    bounds = width.withColumn("_to", F.floor(F.sum("_width").over(before) / F.lit(float(max(sum_width, 1))) * CIRCLE).cast("long"))
    bounds = bounds.withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy(F.col("source").isNull(), "source")), F.lit(0)))
    cell = CIRCLE // CELLS
    grid = bounds.select(
        "source", "budget", "source_size", "_from", "_to",
        F.explode(F.sequence(F.floor(F.col("_from") / cell), F.floor(F.greatest("_from", F.col("_to") - 1) / cell))).alias("_cell"),
    )
    slot = spark.range(points).select(F.col("id").alias("slot"), ((F.col("id") % CIRCLE) * F.lit(TURN) % CIRCLE).alias("_point"))
    slot = slot.withColumn("_cell", F.floor(F.col("_point") / cell))
    dealt = slot.join(grid, "_cell").where("_point >= _from and _point < _to").select("slot", "source", "budget", "source_size")
    schedule = _slot_ranks(dealt).where(F.col("rank") * block < F.col("budget"))
    # rank r stands for words [r * block, (r + 1) * block) of the source's stream, read over and over
    start = F.col("rank") * block
    stop = F.least(start + block, F.col("budget"))
    schedule = schedule.select("slot", "source", "rank", start.alias("_start"), stop.alias("_stop"), F.col("source_size").alias("_all"))
    turns = F.explode(F.sequence(F.floor(F.col("_start") / F.col("_all")), F.floor((F.col("_stop") - 1) / F.col("_all"))))
    parts = schedule.withColumn("pass", turns)
    low = F.greatest(F.col("_start") - F.col("pass") * F.col("_all"), F.lit(0))
    high = F.least(F.col("_stop") - F.col("pass") * F.col("_all"), F.col("_all"))
    parts = parts.select("slot", "source", "rank", "pass", low.alias("_low"), high.alias("_high"))
    parts = parts.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_low") / block), F.floor((F.col("_high") - 1) / block))))
    held = rows.where("size > 0").select("row", "doc_id", F.col("source").alias("_source"), "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("_held"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_held"))
    first = F.greatest("_low", "offset", F.col("_block") * block)
    last = F.least("_high", F.col("offset") + F.col("size"), (F.col("_block") + 1) * block)
    pieces = parts.join(held, same).select("slot", "source", "rank", "pass", "row", "doc_id", (first - F.col("offset")).alias("start"), (last - first).alias("words")).where("words > 0")
    return rows.drop("offset", "budget"), pieces


def _offsets(base: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row's first word in the shuffled stream of its source, by sums per chunk."""
    order = [F.xxhash64("doc_id", F.lit("mix")), F.col("doc_id"), F.col("size")]
    parts = 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = base.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit("deal")), F.lit(parts)))
    own = Window.partitionBy("source", "_chunk").orderBy(*order)
    dealt = dealt.withColumns({"_turn": F.row_number().over(own), "_own": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    sums = base.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit("deal")), F.lit(parts))).groupBy("source", "_chunk").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    joined = dealt.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    facts = targets.select(F.col("source").alias("_ts"), "source_size", "target", "budget")
    out = joined.join(F.broadcast(facts) if targets.count() <= 100_000 else facts, F.col("source").eqNullSafe(F.col("_ts")))
    name = F.xxhash64("source", "_chunk", "_turn", "doc_id")
    return stage(out.select(name.alias("row"), "doc_id", "source", "size", "source_size", "target", "budget", (F.col("_before") + F.col("_own")).alias("offset")), "offsets")


def _slot_ranks(dealt: DataFrame) -> DataFrame:
    """Rank of each slot among its source's slots, in slot order, by counts per stretch of slots."""
    stretch = 4096
    cut = stage(dealt.withColumn("_part", F.floor(F.col("slot") / stretch)), "slots")
    sizes = cut.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("source", "_part").orderBy("slot")
    joined = cut.withColumn("_own", F.row_number().over(own) - 1).join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.select("slot", "source", "budget", "source_size", (F.col("_before") + F.col("_own")).alias("rank"))


def mixed_sizes(docs: DataFrame, **settings) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: one row per input row, ``taken`` summed over the pieces."""
    rows, pieces = mix(docs, **settings)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix as rows with all columns of ``docs``: a row once for each pass that takes words of it.

    A pass that takes all words leaves the text as it is; the last pass of a
    source may end inside a row, whose text is then the taken words joined by
    one space.  Rows of which nothing is taken, empty texts among them, go.
    Rows equal in id, text and source take their turns in the order of a hash of
    all columns.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    first, second = row_order(docs)
    named = F.struct(F.col(id_col).alias("id"), key.alias("key"))
    rows, pieces = mix(docs.select(named.alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "id", "text", "source", **settings)
    runs = pieces.groupBy("row", "pass").agg(F.first("doc_id").alias("_id"), F.min("start").alias("_from"), F.sum("words").alias("_words"))
    sized = rows.select(F.col("row").alias("_row"), "size", F.col("source").alias("_source"))
    runs = runs.join(sized, F.col("row") == F.col("_row")).select("_id", "_source", "_from", "_words", F.col("size").alias("_size"), F.col("row").alias("_run"))
    # equal rows have equal ids: each takes its own turn among them
    turn = F.row_number().over(Window.partitionBy("_id", "_source").orderBy("_run"))
    numbers = runs.select("_run", "_id", "_source").distinct().withColumn("_turn", turn).select(F.col("_run").alias("_r"), "_turn")
    runs = runs.join(numbers, F.col("_run") == F.col("_r"))
    mine = packed(docs, id=named, source=F.col(source_col), o1=first, o2=second)
    mine = mine.withColumn("mine", F.row_number().over(Window.partitionBy("id", "source").orderBy("o1", "o2")))
    same = F.col("id.id").eqNullSafe(F.col("_id.id")) & (F.col("id.key") == F.col("_id.key")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("mine") == F.col("_turn"))
    text = F.col("row")[text_col]
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    cut = F.array_join(F.slice(words, (F.col("_from") + 1).cast("int"), F.col("_words").cast("int")), " ")
    taken = F.when(F.col("_words") == F.col("_size"), text).otherwise(cut)
    out = mine.join(runs, same)
    return out.select(*[taken.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
