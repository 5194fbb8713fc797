"""Hard negatives, conversation repair and quality rules against brute force, with the odd cases."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import lightest_repair, queries, residue_negatives, robust_rules

# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id int, embedding array<double>, label int, slot string, id string, asks string, block string"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS)


def brute_negatives(rows, positives=5, negatives=10):
    usable = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, label in usable:
        if i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, l) for j, b, l in usable if j != i]
        same = sorted(s for s in scored if s[2] == label)[:positives]
        for p, j, _ in same:
            fitting = [s for s in sorted(scored) if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fitting, 1)]
    return sorted(out)


def mined(spark, rows, **settings):
    got = residue_negatives.hard_negatives(vector_table(spark, rows), F.col("vec_id") % 100 == 0, **settings)
    return sorted(tuple(r) for r in got.collect())


def random_rows(seed, n, dim, spread=1.0):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(4, dim))
    rows = centers[r.integers(4, size=n)] + spread * r.normal(size=(n, dim))
    return [(i, [float(x) for x in v], int(r.integers(3))) for i, v in enumerate(rows / np.linalg.norm(rows, axis=1, keepdims=True))]


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = random_rows(1, 320, 12)
    copies = [(400 + i, rows[7][1], i % 3) for i in range(90)]
    odd = [(None, rows[0][1], 1), (500, None, 1), (501, rows[0][1], None), (502, [float("nan")] * 12, 0), (503, [None] * 12, 0), (504, [float("inf")] * 12, 0), (505, [], 2), (506, rows[3][1][:5], 1), (507, rows[3][1] + [9.0], 1), (-100, rows[9][1], 0)]
    want = brute_negatives(rows + copies + odd)
    assert len(want) > 100
    assert mined(spark, rows + copies + odd) == want
    # many blocks of anchors, few rows at a time
    monkeypatch.setattr(residue_negatives, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(residue_negatives, "CELLS", 300)
    monkeypatch.setattr(residue_negatives, "WAITING", 40)
    assert mined(spark, rows + copies + odd) == want


def test_negatives_without_anchors_or_rows(spark):
    rows = random_rows(2, 40, 3)
    assert mined(spark, []) == []
    assert mined(spark, [(i + 1, v, l) for i, v, l in rows]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    same = [(100, [1.0], 1), (100, [1.0], 1), (101, [1.0], 1), (102, [0.5], 2), (102, [0.5], 2)]
    assert mined(spark, same) == sorted([(100, 101, 1, 102, 65536, 32768), (100, 101, 2, 102, 65536, 32768)] * 2)


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, [1e8] * 3, 1), (1, [1e8] * 3, 1)])


@pytest.mark.parametrize("dim, most", [(64, 300), (3000, 300), (4, 10**7), (3, 10**8)])
def test_residue_products_are_exact(dim, most):
    r = np.random.default_rng(dim)
    a, b = r.integers(-most, most + 1, (6, dim)), r.integers(-most, most + 1, (5, dim))
    want = a.astype(object) @ b.astype(object).T
    primes = residue_negatives.primes_for(dim * most * most)
    got = residue_negatives.exact_scores(residue_negatives.residues(a.astype(float), primes), residue_negatives.residues(b.astype(float), primes), primes)
    assert (got.astype(object) == want).all()


# ---------------------------------------------------------------- conversation repair


def lightest_edits(turns):
    """Least (cost, audit) of all edits by trying them in order of cost; turns are (first letter of the role, fault)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        for x in "ua":
            if x in follows[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, x))
        if i < len(turns):
            first, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if first and first in follows[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, first))
                for x in "ua":
                    if x in follows[last]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, x))


def test_agenda_equals_all_derivations():
    """Every sequence of edits of three turns with up to two insertions at each place."""
    fits = re.compile(r"(s?(ua)+)?\Z")
    for turns in itertools.product(itertools.product("sua", (None, "duplicate", "truncated")), repeat=3):
        best = None
        for edits in itertools.product("KRrD", repeat=3):
            if any(e != "D" and f == "duplicate" for e, (_, f) in zip(edits, turns)):
                continue
            for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=4):
                roles = "".join(g + ("" if e == "D" else {"K": t[0], "R": "u", "r": "a"}[e]) for g, e, t in zip(gaps, edits, turns)) + gaps[3]
                if fits.match(roles):
                    cost = sum({"K": 0, "D": 4}.get(e, 3) + (3 if f == "truncated" and e != "D" else 0) for e, (_, f) in zip(edits, turns)) + 3 * sum(map(len, gaps))
                    audit = "".join("I" * len(g) + e.upper() for g, e in zip(gaps, edits)) + "I" * len(gaps[3])
                    best = min(best, (cost, audit)) if best else (cost, audit)
        coded = [(t, {None: ".", "duplicate": "d", "truncated": "t"}[f]) for t, f in turns]
        assert lightest_repair.lightest({"-": (0, "")}, coded, True)[""] == best == lightest_edits(list(turns))


def brute_report(rows):
    """Reports by conversation of (conv_id, turn, role, text, there)."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, there in rows if c == conv_id and there]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = lightest_edits([(r[1][:1], f) for r, f in zip(mine, faults)])
        kept, at = [], 0
        odd = sum(e != "D" for e in audit) % 2
        for e in audit:
            expected = "user" if (len(kept) + odd) % 2 == 0 else "assistant"
            if e == "I":
                kept.append(f"{expected}:")
            else:
                if e != "D":
                    kept.append(f"{mine[at][1] if e == 'K' else expected}:{mine[at][2]}")
                at += 1
        turns = [t for t, _, _ in mine if t is not None]
        count = collections.Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv_id] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


TURNS = "conv_id {}, turn int, role string, text string, there boolean, seen string, present string, fault string, letter string"


def reported(spark, rows, kind="long"):
    table = spark.createDataFrame([(*r, "w", "x", "y", "z") for r in rows], TURNS.format(kind))
    edits = lightest_repair.repair(table, present=F.col("there"))
    got = lightest_repair.report(edits).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_repair_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lightest_repair, "SEGMENT", 8)
    r = random.Random(4)
    texts = ["Fine.", "Well!", "cut off", "", " \t", None, "Why?", "é ü.", "end. "]
    rows = []
    for c in range(150):
        for t in range(r.choice((1, 2, 4, 6, 9, 30))):
            role = r.choice(("user", "assistant", ("user", "assistant")[t % 2], ("user", "assistant")[t % 2], "system", "tool", "", None))
            rows.append((c if c else None, r.choice((t, t, t, t + 3, None)), role, r.choice(texts) if r.random() < 0.4 else f"text {t}.", r.random() < 0.95))
    rows += [(900, 0, "user", "gone.", False), (901, 1, "user", "x" * 200_000 + ".", True), (901, 2, "assistant", "y" * 200_000, True)]
    rows += [(902, i, ("user", "assistant")[i % 2], f"turn {i}.", i % 17 > 0) for i in range(700)]
    rows += [(903, 5, "user", "same.", True)] * 40
    assert reported(spark, rows) == brute_report(rows)


def test_repair_with_text_ids_and_no_rows(spark):
    rows = [("b", 1, "user", "Hi.", True), ("b", 2, "assistant", "Yes.", True), (None, 1, "assistant", "No.", True)]
    assert reported(spark, rows, "string") == brute_report(rows)
    assert reported(spark, []) == {}


def test_repaired_turns_are_legal(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(("user", "assistant", "system", "tool")), f"t{r.randrange(4)}.", True) for c in range(60) for t in range(r.randrange(1, 9))]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, there boolean")
    edits = lightest_repair.repair(table).collect()
    for c in range(60):
        mine = sorted((e for e in edits if e["conv_id"] == c), key=lambda e: e["step"])
        assert re.fullmatch("(s?(ua)+)?", "".join(e["role"][0] for e in mine if e["role"]))
        kept = [(e["role"], e["text"]) for e in mine if e["edit"] == "K"]
        assert len(set(kept)) == len(kept)


def test_damage_follows_the_check_sum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["there"]) for r in queries.damaged(table).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if harm == 1 else text.translate({46: None, 33: None, 63: None}) if harm == 2 else text
        want[c, t, "user" if harm == 4 else role, text, harm != 0] += 2 if harm == 3 else 1
    assert got == want


# ---------------------------------------------------------------- quality rules

DOCS = "doc_id {}, text string, lang string, source string, g string, n string, start string, x0 string, step string"


def docs_table(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, lang, source, *"abcde") for i, t, lang, source in rows], DOCS.format(kind))


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        repeated += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def plain_text(r, n):
    words = ["".join(r.choice("abcdeéünorst") for _ in range(r.randrange(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


ODD = [(900, None), (901, ""), (902, " \n\t"), (None, "one two"), (903, "a b c d e f a b c d e"), (903, "a b c d e f a b c d e"), (904, "x\ny\nx\n\n\n \n \nx\r\nx\r"), (905, "日本 語 #|$ <é> " * 40), (906, "long" * 60_000), (907, "many words here " * 30_000)]


def test_rules_equal_brute_force_and_reject_outliers(spark):
    r = random.Random(3)
    groups = [("en", "a"), ("en", "b"), ("de", None), (None, "c")]
    good = [(i, plain_text(r, r.randrange(12, 300)), *groups[i % 4]) for i in range(480)]
    bad = []
    for k in range(60):
        words = plain_text(r, 80).split()
        text = " ".join(w.upper() + "!!" for w in words) if k % 3 == 0 else " ".join(w + "$$" for w in words) if k % 3 == 1 else " | ".join(words)
        bad.append((500 + k, text, *groups[k % 4]))
    rows = good + bad + [(i, t, "xx", "rare") for i, t in ODD]
    got = robust_rules.judge(docs_table(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    found = sorted(((g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) for g in got), key=key)
    assert found == sorted(((i, *brute_counts(t)) for i, t, *_ in rows), key=key)
    for g in got:
        assert g["base_failed"] == (g["n_words"] < 10 or 100 * g["n_repeat_words"] > 20 * g["n_words"])
        assert not (g["base_failed"] and g["kept"]) and (g["distance"] is None) == g["base_failed"]
    kept = {g["doc_id"] for g in got if g["kept"]}
    assert kept >= {i for i, *_ in good}
    assert not kept & {i for i, *_ in bad}


def test_rules_on_few_rows_and_none(spark):
    text = "one two three four five six seven eight nine ten eleven"
    got = robust_rules.judge(docs_table(spark, [("x", text, None, None)], "string")).collect()
    assert [(g["doc_id"], g["kept"]) for g in got] == [("x", True)]
    assert robust_rules.judge(docs_table(spark, [])).count() == 0
    assert [g["kept"] for g in robust_rules.judge(docs_table(spark, [(1, None, "en", "a")])).collect()] == [False]


def test_estimates_are_those_of_the_nearest_rows(spark):
    """On clean groups with far rows, centre and covariance are close to those of the clean rows."""
    r = np.random.default_rng(6)
    clean = r.normal(size=(900, robust_rules.DIM)) * 300 + 2000
    far = r.normal(size=(150, robust_rules.DIM)) * 50 + 9000
    rows = [("k", i, False, *[int(v) for v in row]) for i, row in enumerate(np.concatenate([clean, far]))]
    names = ", ".join(f"x{k} long" for k in range(robust_rules.DIM))
    table = spark.createDataFrame(rows, f"g string, doc_id long, base_failed boolean, {names}")
    found = robust_rules.covariance_estimates(table).first()
    assert np.abs(np.array(found["centre"]) - 2000).max() < 60
    white = np.zeros((robust_rules.DIM, robust_rules.DIM))
    for value, (i, j) in zip(found["white"], robust_rules._PAIRS):
        white[i, j] = value
    cover = np.linalg.inv(white.T @ white)
    assert np.allclose(np.sqrt(np.diag(cover)), 300, rtol=0.2)
    shifted = clean @ np.eye(robust_rules.DIM) - np.array(found["centre"])
    inside = ((shifted @ white.T) ** 2).sum(axis=1) <= robust_rules.chi_square_limit(robust_rules.KEPT, robust_rules.DIM)
    assert inside.mean() > 0.99
    outside = (((far - np.array(found["centre"])) @ white.T) ** 2).sum(axis=1)
    assert outside.min() > robust_rules.chi_square_limit(robust_rules.KEPT, robust_rules.DIM)


def test_chi_square_limits():
    assert abs(robust_rules.chi_square_limit(0.75, 6) - 7.841) < 1e-3
    assert abs(robust_rules.chi_square_limit(0.999, 6) - 22.458) < 1e-3


# ---------------------------------------------------------------- registered queries on odd and empty tables


def test_registered_queries_on_odd_and_empty_tables(spark, tmp_path):
    vectors = [(0, [0.5, 0.5], 3, "x"), (7, [0.25, 0.5], 2, "x"), (8, [0.25, 0.25], 4, "x"), (None, [1.0, 1.0], 3, "x"), (9, None, 3, "x"), (10, [float("nan"), 1.0], 3, "x")]
    turns = [(1, 0, "user", "Hi.", "x"), (None, None, None, None, "x"), (1, 0, "user", "Hi.", "x"), (2, 5, "system", "", "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, rank string").write.parquet(str(tmp_path / "odd/embeddings.parquet"))
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, cost string").write.parquet(str(tmp_path / "odd/conversations.parquet"))
    for name in ("embeddings", "conversations"):
        spark.read.parquet(str(tmp_path / f"odd/{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"none/{name}.parquet"))
    # 7 is divisible by 7, so its label becomes 3; 0 as well, so its own becomes 4 and only 8 is a positive
    got = queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path / "odd"))
    assert sorted(map(tuple, got.collect())) == []
    found = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path / "odd"))
    assert {r["conv_id"] for r in found.collect()} == {1, 2, None}
    for name in ("op11_hard_negatives", "op12_conversation_repair"):
        empty = queries.QUERIES[name](spark, str(tmp_path / "none"))
        assert empty.count() == 0 and "n" not in empty.columns


# ---------------------------------------------------------------- executors without the package


def test_queries_run_where_executors_cannot_import_the_package(tmp_path):
    """Started from an empty folder, with the package on the driver's path only."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from topicloom.session import local_session
from topicloom.llm.queries import QUERIES
spark = local_session(4, 4)
for name in ("op5_language", "op6_language_model", "op11_hard_negatives", "op12_conversation_repair", "op13_quality_rules"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-2000:]
