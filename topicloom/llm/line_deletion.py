"""Near-duplicate lines by a deletion-neighbourhood join (Bocek et al., 2007), in DataFrame functions only.

Two lines within one edit share a variant: both without the edited character,
or the shorter as it is and the longer without one.  Variants are emitted as
hashed keys, equal keys are joined, and each match is verified by the edit
distance.  A line goes if an earlier line matches it.

An edit leaves the first or the second half of the shorter line as it is, so
only lines that share a half with another line are looked at further.  They
are cut into windows; a variant is made of one window, under the hash of all
that stands before and after it, so a line of n characters costs n short
variants however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import small
from topicloom.staging import stage

#: Shorter lines go only if they are equal to an earlier one; one character shorter, they can still take a longer line.
MIN_CHARS = 10
WINDOW = 48


def _half_keys(line: Column, n: Column) -> Column:
    """Both halves under the lengths that the shorter of two lines may have."""

    def keys(short: Column) -> list[Column]:
        left = F.floor(short / 2).cast("int")
        return [
            F.xxhash64(F.lit("first"), short, F.substring(line, F.lit(1), left)),
            F.xxhash64(F.lit("second"), short, F.right(line, short - left)),
        ]

    return F.when(n >= MIN_CHARS, F.array(*keys(n), *keys(n - 1))).when(n == MIN_CHARS - 1, F.array(*keys(n)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return named.select("doc_id", "text_key", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("second")).alias("h2"))


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(firsts, near)``: the distinct lines with their first place, and those that an earlier line matches.

    ``firsts`` has ``(h1, h2, place, n)`` per distinct non-empty line, ``place``
    being the least ``(doc_id, text_key, pos)``.  ``near`` has ``(h1, h2,
    earlier_h1, earlier_h2)``: the line, and the earliest line within one edit
    of it among the lines that share a variant.
    """
    lines = _lines(docs, id_col, text_col).where("line <> ''")
    n = F.char_length("line")
    place = F.struct("doc_id", "text_key", "pos")
    keyed = lines.select("h1", "h2", F.struct(place.alias("place"), n.alias("n"), _half_keys(F.col("line"), n).alias("halves")).alias("f"))
    firsts = stage(keyed.groupBy("h1", "h2").agg(F.min("f").alias("f")).select("h1", "h2", "f.place", "f.n", "f.halves"), "lines")
    half = firsts.select("h1", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("h1").alias("_a"), F.max("h1").alias("_b")).where("_a <> _b").select(F.col("half").alias("_half"))
    found = half.join(shared, F.col("half") == F.col("_half")).select(F.col("h1").alias("_w")).distinct()
    wanted = stage(found, "wanted")
    # texts of the lines that share a half, once each
    narrow = firsts.join(small(wanted), F.col("h1") == F.col("_w"), "left_semi").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "place", "n")
    narrow = stage(narrow, "narrow")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("doc_id").eqNullSafe(F.col("place.doc_id"))
    same = same & (F.col("text_key") == F.col("place.text_key")) & (F.col("pos") == F.col("place.pos"))
    texts = stage(lines.join(small(narrow), same).select("h1", "h2", "place", "n", "line").dropDuplicates(["h1", "h2"]), "texts")
    # the line as the shorter (or equal) of two, and as the longer one
    short = F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("short")
    cut = texts.select("h1", "h2", "place", "n", "line", short).where(F.col("short") >= MIN_CHARS - 1)
    cut = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("short") - 1, F.lit(WINDOW))))
    wide = F.least(F.lit(WINDOW), F.col("short") - F.col("at"))
    after = F.col("short") - F.col("at") - wide
    cut = cut.select(
        "h1", "h2", "place", (F.col("n") > F.col("short")).alias("longer"), (F.col("n") < MIN_CHARS).alias("brief"),
        F.xxhash64("short", "at", F.substring("line", F.lit(1), F.col("at")), F.right("line", after)).alias("key"),
        F.substring(F.col("line"), F.col("at") + 1, F.col("n") - F.col("at") - after).alias("rest"),
    )
    cut = stage(cut, "windows")
    mixed = cut.groupBy("key").agg(F.min("h1").alias("_a"), F.max("h1").alias("_b")).where("_a <> _b").select(F.col("key").alias("_key"))
    cut = cut.join(mixed, F.col("key") == F.col("_key"))
    size = F.char_length("rest")
    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("i"), F.concat(F.left(F.col("rest"), i - 1), F.right(F.col("rest"), size - i)).alias("v")))
    # place 0: nothing deleted; equal lengths meet at the same place, unequal ones meet at none
    whole = F.struct(F.lit(0).alias("i"), F.col("rest").alias("v"))
    variants = F.when(F.col("longer"), F.transform(less, lambda x: F.struct(F.lit(0).alias("i"), x["v"].alias("v"))))
    # a brief line only takes a longer one, which has all of it
    variants = variants.when(F.col("brief"), F.array(whole)).otherwise(F.concat(F.array(whole), less))
    emitted = cut.select("h1", "h2", "place", "longer", "brief", "key", F.explode(variants).alias("x"))
    emitted = emitted.select("h1", "h2", "place", "longer", "brief", (F.col("x.i") == 0).alias("indel"), F.xxhash64("key", "x.i", "x.v").alias("variant"))
    emitted = stage(emitted, "variants")
    own = F.struct("place", "h1", "h2")
    least = emitted.groupBy("variant").agg(F.min(F.when(~F.col("longer"), own)).alias("_short"), F.min(F.when(F.col("longer"), own)).alias("_long")).withColumnRenamed("variant", "_v")
    met = emitted.join(least, F.col("variant") == F.col("_v"))
    rival = F.when(F.col("indel") & ~F.col("longer"), F.col("_long")).otherwise(F.col("_short"))
    met = met.where("not brief").select("h1", "h2", "place", rival.alias("r")).where("r is not null and r.place < place")
    pairs = met.groupBy("h1", "h2", F.col("r.h1").alias("e1"), F.col("r.h2").alias("e2")).agg(F.min("r.place").alias("first"))
    one = texts.select(F.col("h1").alias("_x1"), F.col("h2").alias("_x2"), F.col("line").alias("x"))
    two = texts.select(F.col("h1").alias("_y1"), F.col("h2").alias("_y2"), F.col("line").alias("y"))
    checked = pairs.join(one, (F.col("h1") == F.col("_x1")) & (F.col("h2") == F.col("_x2"))).join(two, (F.col("e1") == F.col("_y1")) & (F.col("e2") == F.col("_y2")))
    checked = checked.where(F.levenshtein("x", "y", 1).between(0, 1))
    near = checked.groupBy("h1", "h2").agg(F.min(F.struct("first", "e1", "e2")).alias("m")).select("h1", "h2", F.col("m.e1").alias("earlier_h1"), F.col("m.e2").alias("earlier_h2"))
    return firsts.select("h1", "h2", "place", "n"), stage(near, "near")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept)``: one row per input row, ``kept`` being the text without removed lines.

    Lines end at a line feed.  A line is removed if an equal line stands
    earlier, by document id and place, or, if it has at least ``MIN_CHARS``
    characters, if an earlier line is within one edit (a character put in,
    left out or changed).  All lines are judged on the input, against every
    line of the corpus, removed ones too.

    Empty lines stay.  A null text is empty, one empty line.  Null ids come
    before all others.  Rows equal in id and text are treated alike; rows that
    share only the id are ordered by a hash of their text.  An empty table
    gives no rows.
    """
    firsts, near = near_lines(docs, id_col, text_col)
    gone = firsts.join(near.select(F.col("h1").alias("_n1"), F.col("h2").alias("_n2")), (F.col("h1") == F.col("_n1")) & (F.col("h2") == F.col("_n2")), "left")
    gone = gone.select(F.col("h1").alias("_f1"), F.col("h2").alias("_f2"), "place", F.col("_n1").isNotNull().alias("near"))
    lines = _lines(docs, id_col, text_col).where("line <> ''").select("doc_id", "text_key", "pos", "h1", "h2")
    judged = lines.join(gone, (F.col("h1") == F.col("_f1")) & (F.col("h2") == F.col("_f2")))
    first = F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("text_key") == F.col("place.text_key")) & (F.col("pos") == F.col("place.pos"))
    removed = judged.where(F.col("near") | ~first).groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).agg(F.collect_set("pos").alias("removed"))
    removed = stage(removed, "removed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    joined = plain.join(removed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    split = joined.withColumn("_lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return split.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
