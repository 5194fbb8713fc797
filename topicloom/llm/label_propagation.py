"""Shards of even size that keep linked rows together, by balanced label propagation.

Rows with an equal link key are neighbours.  Each round, rows want to move to
the shard that holds most of their neighbours; ties are broken anew each round.
Of all wishes from shard to shard, the most are granted such that no shard gains
more rows than it has without neighbours: rows change places in pairs and in
longer rings, and rows without neighbours fill the places left over.  So every
shard has the same number of rows after each round (Ugander and Backstrom, 2013,
bound the moves between shards likewise).  The rounds go on until they no longer
bring rows together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import packed, ranked
from topicloom.staging import stage

SHARDS = 40
#: Rounds in a row, each with other ties, that bring no more rows together before the end.
PATIENCE = 4
#: Groups with this share of all rows or more are sent to all tasks; so many there are at most.
PARTS = 1000
PLACE = ["size", "text_crc32", "shard", "slot"]
#: Carries the number of a row from ``sharded_rows`` through ``balanced_shards``.
NUMBER = "__row_number"


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int | None = None, link: Column | None = None) -> DataFrame:
    """``(row, doc_id, size, text_crc32, link, shard, slot)``: one row per input row.

    Law: the numbers of rows of two shards differ by one at most.  ``size`` is
    the UTF-8 bytes of the text plus 16, ``slot`` counts 0, 1, ... in a shard.
    ``link`` is the key that neighbours share, by default the text.  A group
    larger than a shard is dealt to as many shards as it needs and no more.

    Every state is a written table of the rows that have neighbours; joins and
    counts by key do the moving, and of each round only the counts per pair of
    shards reach the driver.  Of the other rows only counts per shard are kept
    until the rounds are over; then as many change shards as must.
    ``rounds`` bounds the rounds; by default they run to their end.  Null texts have
    size 16 and the checksum 0; they and empty texts have no neighbours.
    Null and repeated ids are rows like others.  An empty table gives no rows.
    """
    rows, moved = _placed(docs, id_col, text_col, shards, rounds, link)
    out = _joined(rows, moved, shards)
    return ranked(out, ["shard"], [F.xxhash64("row"), F.col("row")], "slot", "slots")


def sharded_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """All columns of ``docs`` with ``size, text_crc32, shard, slot`` of ``balanced_shards``.

    The rows are numbered in a written copy, so that each gets its own place
    back although ids and texts may repeat; texts are shuffled once, at the end.
    A column of ``docs`` that has the name of one of the four comes back with
    ``in_`` before its name.
    """
    numbered = stage(packed(docs, at=F.monotonically_increasing_id()), "numbered")
    narrow = numbered.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), F.col("at").alias(NUMBER))
    places = balanced_shards(narrow, "id", "text", shards, rounds)
    places = places.select(F.col(NUMBER).alias("_at"), *PLACE)
    names, taken = [], {*PLACE, *docs.columns}
    for c in docs.columns:
        name = c
        while name in PLACE or (name != c and name in taken):
            name = f"in_{name}"
        taken.add(name)
        names.append(F.col("row")[c].alias(name))
    return numbered.join(places, F.col("at") == F.col("_at")).select(*names, *PLACE)


def _placed(docs: DataFrame, id_col: str, text_col: str, shards: int, rounds: int | None, link: Column | None) -> tuple[DataFrame, DataFrame]:
    """All rows with their numbers, and ``(_row, _shard)`` of those that may not stand in shard ``row % shards``."""
    text = F.col(text_col)
    own = F.when(F.length(text) > 0, F.xxhash64(text)) if link is None else link
    number = [F.col(NUMBER)] if NUMBER in docs.columns else []
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), own.alias("link"), *number,
    )
    rows = stage(ranked(base, [], [F.xxhash64("doc_id", F.lit("shard")), F.col("doc_id"), F.col("link")], "row", "rows"), "rows")
    total = rows.count()
    named = rows.where("link is not null")
    linked = stage(named.groupBy(F.col("link").alias("_k")).agg(F.count(F.lit(1)).alias("_g")).where("_g > 1"), "linked")
    tied = _with_facts(named.select("row", "link"), linked, total).select("row", "link", "_g")
    # the other rows have no neighbours: they make room, of which only the counts per shard are kept
    state = stage(tied.select("row", "link", "_g", (F.col("row") % shards).cast("int").alias("shard")), "state")
    room = max(1, total // shards)
    held = _per_shard(state, shards)
    begin = free = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64) - held
    least, kept, stale, turn = None, (state, free), 0, 0
    while total:
        apart = _apart(state, room)
        if least is None or apart < least:
            least, kept, stale = apart, (state, free), 0
        else:
            stale += 1
        if apart == 0 or stale == PATIENCE or turn == rounds:
            break
        # every other round without gain, groups pass over shards that have no room
        state, free = _round(state, free, shards, room, turn, stale % 2 == 1, total)
        turn += 1
    state, free = kept
    moved = state.select(F.col("row").alias("_row"), F.col("shard").alias("_shard"))
    gain = [int(g) for g in begin - free]
    if any(gain):
        alone = rows.select("row").join(state.select("row"), "row", "left_anti")
        alone = alone.withColumn("shard", (F.col("row") % shards).cast("int"))
        moved = moved.union(_filled(alone, gain))
    return rows, moved


def _joined(rows: DataFrame, moved: DataFrame, shards: int) -> DataFrame:
    out = rows.join(moved, F.col("row") == F.col("_row"), "left")
    return out.withColumn("shard", F.coalesce("_shard", F.col("row") % shards).cast("int")).drop("_row", "_shard")


def _with_facts(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """``rows`` joined by ``link`` with ``facts(_k, _g, ...)``, whose ``_g`` is the size of the group.

    Groups with a ``PARTS``-th of all rows or more, of which there are ``PARTS``
    at most, are sent to all tasks; so no key that is shuffled holds more.
    """
    large = F.broadcast(facts.where(F.col("_g") * PARTS >= total))
    few = rows.join(large.select("_k"), F.col("link") == F.col("_k"), "left_anti")
    rest = facts.where(F.col("_g") * PARTS < total)
    return rows.join(large, F.col("link") == F.col("_k")).union(few.join(rest, F.col("link") == F.col("_k")))


def _per_shard(rows: DataFrame, shards: int) -> np.ndarray:
    counts = np.zeros(shards, np.int64)
    for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["shard"]] = r["n"]
    return counts


def _filled(free: DataFrame, gain: list[int]) -> DataFrame:
    """``(_row, _shard)`` of the rows without neighbours that leave shards which gained others for those that lost."""
    leave, borders, lost, total, filled = [], [], [], 0, 0
    for s, g in enumerate(gain):
        leave.append(total)
        total += max(g, 0)
        if g < 0:
            filled -= g
            borders.append(filled)
            lost.append(s)
    over = F.array(*[F.lit(max(g, 0)) for g in gain])
    before = F.array(*[F.lit(x) for x in leave])
    place = (F.col("shard") + 1).cast("int")
    free = ranked(free, ["shard"], [F.xxhash64("row", F.lit("leave")), F.col("row")], "turn", "free")
    free = free.where(F.col("turn") < F.element_at(over, place))
    number = F.element_at(before, place) + F.col("turn")
    to = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= number))
    return free.select(F.col("row").alias("_row"), F.element_at(F.array(*[F.lit(x) for x in lost]), (to + 1).cast("int")).alias("_shard"))


def _held(state: DataFrame, room: int) -> DataFrame:
    """Rows of each group in each shard, and how many shards the group needs at least."""
    held = state.where("link is not null").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("_g").alias("_g"))
    return held.withColumn("need", F.ceil(F.col("_g") / F.lit(room)).cast("int"))


def _apart(state: DataFrame, room: int) -> int:
    """Rows outside the shards that hold most of their group."""
    groups = _held(state, room).groupBy("link").agg(F.max("need").alias("need"), F.sort_array(F.collect_list("n"), asc=False).alias("_n"))
    rest = F.slice("_n", F.col("need") + 1, F.greatest(F.size("_n") - F.col("need"), F.lit(0)))
    return groups.agg(F.coalesce(F.sum(F.aggregate(rest, F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()[0]


def _granted(wishes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The most of ``wishes[i, j]`` from shard i to j such that no shard gains more than its ``room``.

    All are granted first.  From shards that then gain too much, rows are sent
    back along shortest paths to shards that can keep them, each step refusing a
    wish or granting a refused one (a flow of least cost).
    """
    granted = wishes.copy()
    over = granted.sum(axis=0) - granted.sum(axis=1) - room
    while (over > 0).any():
        again = granted < wishes
        cost = np.where(again, -1.0, np.where(granted.T > 0, 1.0, np.inf))
        far, before = np.where(over > 0, 0.0, np.inf), np.full(len(room), -1)
        while True:
            ways = far[:, None] + cost
            first = ways.argmin(axis=0)
            nearer = ways.min(axis=0) < far
            if not nearer.any():
                break
            far[nearer], before[nearer] = ways.min(axis=0)[nearer], first[nearer]
        end = at = int(np.where(over < 0, far, np.inf).argmin())
        steps = []
        while before[at] >= 0:
            steps.append((int(before[at]), at))
            at = int(before[at])
        count = min(over[at], -over[end], *[wishes[j, i] - granted[j, i] if again[j, i] else granted[i, j] for j, i in steps])
        for j, i in steps:
            if again[j, i]:
                granted[j, i] += count
            else:
                granted[i, j] -= count
        over[at] -= count
        over[end] += count
    return granted


def _round(state: DataFrame, free: np.ndarray, shards: int, room: int, turn: int, pass_full: bool, total: int) -> tuple[DataFrame, np.ndarray]:
    """Linked rows after a round, and the rows without neighbours that each shard then has."""
    spark = state.sparkSession
    # a group that fits into one shard may pass over shards that have no room
    full = F.array(*[F.lit(bool(n == 0)) for n in free])
    open_ = (F.col("need") > 1) | ~F.element_at(full, (F.col("shard") + 1).cast("int")) if pass_full else F.lit(True)
    wanted = F.struct(open_.alias("o"), "n", F.xxhash64("link", "shard", F.lit(turn)).alias("t"), F.col("shard").alias("s"))
    best = _held(state, room).groupBy("link").agg(F.max("need").alias("need"), F.max("_g").alias("_g"), F.sort_array(F.collect_list(wanted), asc=False).alias("_top"))
    best = best.where(F.size("_top") > F.col("need")).select(F.col("link").alias("_k"), "_g", F.transform(F.slice("_top", F.lit(1), F.col("need")), lambda x: x["s"]).alias("_to"))
    wish = _with_facts(state.drop("_g"), stage(best, "best"), total)
    wish = wish.where(~F.array_contains("_to", F.col("shard")))
    wish = wish.select("row", "shard", F.element_at("_to", (F.pmod(F.xxhash64("row", F.lit(turn)), F.size("_to")) + 1).cast("int")).alias("want"))
    wish = stage(wish, "wishes")
    wishes = np.zeros((shards, shards), np.int64)
    for r in wish.groupBy("shard", "want").agg(F.count(F.lit(1)).alias("n")).collect():
        wishes[r["shard"], r["want"]] = r["n"]
    granted = _granted(wishes, free)
    flow = [(int(i), int(j), int(granted[i, j])) for i, j in zip(*np.nonzero(granted))]
    if not flow:
        return state, free
    parts = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // shards)
    wish = ranked(wish, ["shard", "want"], [F.xxhash64("row", F.lit(turn)), F.col("row")], "turn", "wishes", parts)
    bound = F.broadcast(spark.createDataFrame(flow, "_i int, _j int, _most long"))
    taken = wish.join(bound, (F.col("shard") == F.col("_i")) & (F.col("want") == F.col("_j"))).where("turn < _most")
    move = taken.select(F.col("row").alias("_row"), F.col("want").alias("_want"))
    out = state.join(move, F.col("row") == F.col("_row"), "left")
    state = stage(out.select("row", "link", "_g", F.coalesce("_want", "shard").cast("int").alias("shard")), "state")
    return state, free - (granted.sum(axis=0) - granted.sum(axis=1))
