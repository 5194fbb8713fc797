"""Each operator against a brute-force version on small inputs, with the odd cases."""

import collections
import hashlib
import itertools
import math
import random
import types

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topicloom.llm import common, containment, dart_minhash, imatch, label_propagation, line_crf, line_deletion, log_bilinear, mixing, ngram_bayes, phrase_automata

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string"


def table(spark, rows):
    """Documents with columns whose names clash with those the operators use."""
    full = [(i, t, *(rest or ("en", "s0"))[:2], 0, "x", "y") for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


ODD = [(900, None), (901, ""), (902, ""), (None, "only a null id here"), (903, "one"), (903, "one"), (904, " \t\n ")]


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(spark):
    rows = []
    for g in range(6):
        base = words(g, 120)
        for c in range(6):
            copy = list(base)
            for k in range(c):
                copy[7 + 15 * k] = f"new{g}{c}{k}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, " ".join(words(99, 20000)))] + ODD
    got = dart_minhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] == set() and (dict(rows)[a] or "") == (dict(rows)[b] or "") or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == {i: find(i) for i in ids}
    kept = dart_minhash.drop_near_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({find(i) for i in ids})
    assert dart_minhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_blocks_of_a_bucket_find_links_that_the_first_member_has_not(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK", 2)
    base = words(1, 100)
    far = [*base[:60], *[f"x{i}" for i in range(40)]]
    rows = [(0, " ".join(base))]
    for c in range(5):
        copy = list(far)
        copy[3 * c] = f"c{c}"
        rows.append((1 + c, " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(table(spark, rows), rows=1, bands=60).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_dart_signatures_estimate_weighted_similarity():
    random_ = np.random.default_rng(5)
    names = common.mixed(np.arange(1, 400, dtype=np.uint64))
    a, b = random_.uniform(0.2, 3, len(names)), random_.uniform(0.2, 3, len(names))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    k = 2000
    sig, some = dart_minhash.signatures(np.concatenate([names, names]), np.concatenate([a, b]), np.repeat([0, 1], len(names)), 2, k)
    assert some.all()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / k)


def test_quality_field_learns_lines_and_takes_odd_texts(spark):
    good = [(i, "\n".join(" ".join(words(i * 7 + k, 12)) + "." for k in range(4))) for i in range(60)]
    bad = [(100 + i, "\n".join(" | ".join(w.upper() + "!!" for w in words(i * 5 + k, 12)) for k in range(4))) for i in range(30)]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 0), (3, None), (7, 1)], "doc_id long, quality int")
    field = line_crf.train(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["score"] for r in line_crf.score(docs, field).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i, _ in good) > 0.3 > max(got[i] for i, _ in bad)
    assert line_crf.score(docs, field).count() == docs.count()
    kept = line_crf.keep_good(docs, field)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {i for i, _ in bad}
    none = line_crf.train(docs, labels.limit(0), F.lit(True))
    assert line_crf.score(docs.limit(0), none).count() == 0


def test_marginals_equal_a_sum_over_all_paths():
    r = np.random.default_rng(2)
    x, field = r.normal(size=(5, 3)), line_crf.Field(r.normal(size=(3, 2)), r.normal(size=(2, 2)))
    got = line_crf.marginals(field, x, np.array([4, 1]))
    u = x @ field.weights
    paths = {p: sum(u[i, p[i]] for i in range(4)) + sum(field.pairs[p[i], p[i + 1]] for i in range(3)) for p in np.ndindex(2, 2, 2, 2)}
    total = sum(math.exp(v) for v in paths.values())
    want = [sum(math.exp(v) for p, v in paths.items() if p[i]) / total for i in range(4)] + [1 / (1 + math.exp(u[4, 0] - u[4, 1]))]
    assert np.allclose(got, want)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def test_near_lines_equal_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdé ß") for _ in range(n)) for n in (10, 11, 47, 48, 49, 97, 150)]
    lines = list(base)
    for line in base:
        for _ in range(5):
            k = r.randrange(len(line))
            lines += [line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "q" + line[k + 1 :], line[:k] + "zz" + line[k:]]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)] + [(800, "short"), (801, "shorx\n\nshort"), (850, "ab" * 40000 + "\n" + "ab" * 40000 + "c")] + ODD
    # ten characters go by an earlier nine; nine never go by ten, nor by another nine
    rows += [(860, "ABCDEFGHI\nABCDEFGHIJ\nABXCDEFGHI\nABCDEFGHX"), (861, "KLMNOPQRST\nKLMNOPQRS")]
    got = {r["doc_id"]: r for r in line_deletion.dedup_lines(table(spark, rows)).collect()}
    assert line_deletion.dedup_lines(table(spark, rows)).count() == len(rows)
    seen, want = [], {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        kept = []
        for line in (text or "").split("\n"):
            gone = line and any(line == s or len(line) >= 10 and one_edit(line, s) for s, at in seen if (at != i or i != 903))
            if not gone:
                kept.append(line)
            seen.append((line, i))
        want[i] = "\n".join(kept)
    assert {i: r["kept"] for i, r in got.items() if i is not None} == want
    assert line_deletion.dedup_lines(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("windows, size, places", [(phrase_automata.SHARD_WINDOWS, phrase_automata.PASSAGE_BYTES, 0), (40, 600, phrase_automata.PLACES)])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, windows, size, places):
    # once all passages chosen by their windows; once many shards and grids of parts
    monkeypatch.setattr(phrase_automata, "PLACES", places)
    monkeypatch.setattr(phrase_automata, "SHARD_WINDOWS", windows)
    monkeypatch.setattr(phrase_automata, "PASSAGE_BYTES", size)
    monkeypatch.setattr(phrase_automata, "SEARCH_BYTES", size)
    shared = [words(50 + k, n) for k, n in enumerate((50, 49, 80, 200))]
    rows = [(i, " ".join(sum((words(i * 10 + k, 30) + shared[(i + k) % 4][: 200 - 10 * (i % 5)] for k in range(3)), []))) for i in range(16)]
    frequent = [words(80 + k, 30) for k in range(4)]
    rows += [(100 + i, " ".join(sum((frequent[(i * k) % 4] for k in (1, 2, 3, 5)), []))) for i in range(12)]
    rows += [(20, "again " * 300), (21, "x " + "again " * 120), (22, rows[3][1]), (23, rows[3][1]), (30, " ".join(words(7, 20000)))] + ODD
    got = {r["doc_id"]: r for r in phrase_automata.remove_repeats(table(spark, rows)).collect()}
    first = {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        own = (text or "").split()
        gone = [False] * len(own)
        for j in range(len(own) - 49):
            if first.setdefault(tuple(own[j : j + 50]), i) < i:
                gone[j : j + 50] = [True] * 50
        left = " ".join(w for w, g in zip(own, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(own), sum(gone), hashlib.sha256(left.encode()).hexdigest()), i
    assert phrase_automata.remove_repeats(table(spark, rows)).count() == len(rows)
    assert phrase_automata.remove_repeats(table(spark, rows).limit(0)).count() == 0


def test_language_of_held_out_and_odd_texts(spark):
    r = random.Random(1)
    kinds = {"aa": ["kala", "mina", "talo", "vesi"], "bb": ["strumpf", "zwerg", "pflicht", "wurst"]}
    rows = [(i, " ".join(r.choices(kinds[k], k=8)), k, "s") for i in range(60) for k in [("aa", "bb")[i % 2]]]
    docs = table(spark, rows + [(500, None), (501, "12 34 !"), (502, "talo " * 30000, None, "s"), (503, "")])
    model = ngram_bayes.train(docs, F.col("doc_id") % 5 != 0)
    got = {x["doc_id"]: x for x in ngram_bayes.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in rows) and got[502]["lang_pred"] == "aa"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 503))
    nothing = ngram_bayes.train(docs.limit(0), F.lit(True))
    assert {x["lang_pred"] for x in ngram_bayes.predict(docs, nothing).collect()} == {"und"}


def test_language_chances_equal_naive_bayes_of_dictionaries(spark):
    r = random.Random(4)
    letters = {"aa": "abcdeé ", "bb": "defgßж .", "cc": "aж7x, "}
    rows = [(i, r.choice(["", "?", " 1 "]) + "".join(r.choices(letters[k], k=r.randrange(1, 60))), k, "s") for i in range(90) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = table(spark, rows + [(200, "ABC, déf"), (201, "ж" * 3000)]).coalesce(1)
    bits = 10

    def grams(text):
        """Buckets of the runs of one to three letters, with a gap after each word."""
        low, plain = text.lower(), []
        for k, c in enumerate(low):
            if c.isalpha():
                plain.append(ord(c))
            elif k and low[k - 1].isalpha():
                plain.append(32)
        for n in (1, 2, 3):
            for at in range(len(plain) - n + 1):
                h = n
                for code in plain[at : at + n]:
                    h = (h ^ code) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                yield h >> (64 - bits)

    learned = [x for x in [*rows, (201, "ж" * 3000, "en", "s")] if x[0] % 5]
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in learned:
        counts[lang].update(grams(text))
        texts[lang] += 1
    model = ngram_bayes.train(docs, F.col("doc_id") % 5 != 0, bits=bits)
    for x in ngram_bayes.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        if not any(c.isalpha() for c in x["text"]):
            assert (x["lang_pred"], x["score"]) == ("und", 0)
            continue
        logs = {}
        for lang, own in counts.items():
            size = sum(own.values()) + 0.5 * 2**bits
            logs[lang] = math.log(texts[lang] / len(learned)) + sum(math.log((own[g] + 0.5) / size) for g in grams(x["text"]))
        top = max(logs.values())
        assert logs[x["lang_pred"]] == pytest.approx(top)
        assert x["score"] == pytest.approx(1 / sum(math.exp(v - top) for v in logs.values()))


def test_language_model_counts_and_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(log_bilinear, "COMMON_WORDS", 60)
    docs = table(spark, [(i, " ".join(f"W{(i * k * k) % 90}" for k in range(40))) for i in range(50)] + ODD[:3] + [(700, "never seen"), (701, "W1 " * 30000)])
    allowed = F.col("doc_id") < 40
    model, counts = log_bilinear.train(docs, allowed)
    got = {r["doc_id"]: r for r in log_bilinear.score(docs, model, counts).collect()}
    tokens = {r["doc_id"]: (r["text"] or "").lower().split() + ["\n"] for r in docs.select("doc_id", "text").collect()}
    c = collections.Counter(w for i, t in tokens.items() if i < 40 for w in t)
    total, distinct = sum(c.values()), len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(w in c for w in t), total)
        assert got[i]["base_score"] == pytest.approx(base)
    units = np.arange(model.units)
    chance = log_bilinear.Scorer(model).score(units, np.full(len(units), model.units), np.full(len(units), 3))
    assert (10.0**chance).sum() == pytest.approx(1, abs=1e-4)
    empty, none = log_bilinear.train(docs.limit(0), F.lit(True))
    assert {r["score"] for r in log_bilinear.score(docs, empty, none).collect()} == {0.0}


def test_edit_report_follows_descending_ids(spark):
    rows = [(3 * i, " ".join(words(i % 9, 40 + i))) for i in range(40)] + [(500, None), (501, ""), (600, "é" * 7), (700, "z" * 100000), (None, "null id")]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in imatch.edit_report(docs, imatch.lexicon(docs, commonest=0.9)).collect()}
    order = sorted(rows, key=lambda x: -(x[0] if x[0] is not None else -1))
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    plain = imatch.fingerprint(docs, imatch.lexicon(docs, commonest=0.9)).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in plain} == {i: r["fingerprint"] for i, r in got.items()}
    assert imatch.edit_report(docs.limit(0), np.empty(0, np.uint64)).count() == 0
    assert imatch.edit_report(docs.limit(1), np.empty(0, np.uint64)).count() == 1


def test_different_texts_without_a_term_in_the_band_are_unlike():
    terms = imatch.Terms(np.array([5], np.uint64))
    prints = imatch.fingerprints([b"rare words", b"other things", b"Words, rare!", b"", b" ", b"!!", b"??"], terms)
    same = [[float(imatch.likeness(prints[[a]], prints[[b]])[0]) for b in range(7)] for a in range(7)]
    alike = {(a, b) for a in range(7) for b in range(7) if same[a][b] == 1}
    assert alike == {(k, k) for k in range(7)} | {(0, 2), (2, 0), (3, 4), (4, 3)}
    assert max(same[0][1], same[0][3], same[0][5], same[5][6]) < 0.1


def test_contained_items_equal_brute_force(spark):
    items = [(k, " ".join(words(300 + k, n))) for k, n in enumerate((5, 9, 20, 33, 60, 200))] + [(50, "too short"), (51, None), (52, "")]
    rows = [(k, " ".join(words(k, 40) + items[k % 6][1].split() + words(k + 1, 3000 * (k % 3)))) for k in range(12)]
    rows += [(20, " ".join(items[4][1].split()[:50])), (21, " ".join(items[4][1].split()[:30]))] + ODD
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in rows:
        own = shingle_set(t)
        for k, q in items:
            wanted = shingle_set(q) if len((q or "").split()) >= 5 else set()
            if wanted and len(wanted & own) >= 0.8 * len(wanted):
                want.add((i, k, len(wanted & own)))
    for block in (2, 1000):
        got = containment.contained_items(docs, bench, block=block)
        assert {(r["doc_id"], r["item_id"], r["n_found"]) for r in got.collect()} == want
    clean = containment.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({i for i, _, _ in want})
    assert containment.contained_items(docs, bench.limit(0)).count() == 0 == containment.contained_items(docs.limit(0), bench).count()


def test_short_and_repetitive_items_are_never_missed(spark):
    items = [(k, " ".join(words(2000 + k, 5 + k % 2))) for k in range(400)]
    items += [(1000 + k, " ".join((words(3000 + k, 2 + k % 3) * 40)[: 20 + k])) for k in range(100)]
    rows = [(i, " ".join(words(5000 + i, 60) + text.split() + words(7000 + i, 60))) for i, text in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = containment.contained_items(table(spark, rows), bench).collect()
    found = {(r["doc_id"], r["item_id"], r["n_found"]) for r in got}
    assert {(i, i, len(shingle_set(text))) for i, text in items} <= found
    sets = {i: shingle_set(text) for i, text in rows}
    want = {(i, k, len(sets[i] & s)) for k, text in items for s in [shingle_set(text)] for i in sets if len(sets[i] & s) >= 0.8 * len(s)}
    assert found == want


def test_mix_reaches_targets(spark):
    rows = [(i, " ".join(words(i, 1 + i % 40)), "en", f"s{min(i % 7, 3)}") for i in range(300)] + [(400, "a b c", "en", None), (401, None, "en", "s1"), (402, "", "en", "s9"), (403, "x", "en", "z"), (404, "d d", "en", "s1"), (404, "d d", "en", "s1")]
    docs = table(spark, rows)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    level, total = 0.0, sum(sizes.values())
    low, high = 0.0, float(total)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * weight[s]) for s in names) < total else (low, level)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(min(3 * sizes[r["source"]], level * weight[r["source"]]), abs=1e-6)
    assert all(abs(taken[s] - min(3 * sizes[s], level * weight[s])) <= 1 for s in names)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    held = collections.Counter()
    for r in out.select("source", "text").collect():
        held[r["source"]] += len(r["text"].split())
    assert held == +taken
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    again = mixing.mixed_sizes(docs.repartition(5))
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again.collect()) == sorted((str(r["doc_id"]), r["taken"]) for r in got)


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, f"text {i}") for i in range(200)] + [(300 + i, f"copy {i % 25}") for i in range(100)] + [(500 + i, "hot") for i in range(150)] + ODD
    docs = table(spark, rows)
    got = label_propagation.balanced_shards(docs, shards=8).collect()
    assert len(got) == len(rows)
    count = collections.Counter(r["shard"] for r in got)
    assert len(count) == 8 and max(count.values()) - min(count.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    where = collections.defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and 300 <= r["doc_id"] < 400:
            where[(r["doc_id"] - 300) % 25].add(r["shard"])
    assert sum(len(x) == 1 for x in where.values()) >= 23
    hot = {r["shard"] for r in got if r["doc_id"] is not None and 500 <= r["doc_id"] < 650}
    assert len(hot) <= 5
    assert label_propagation.balanced_shards(docs.limit(0)).count() == 0


def test_sharded_rows_carry_all_columns(spark):
    rows = [(i % 20, f"text {i % 15}", i, "x") for i in range(60)] + [(None, None, 60, None), (None, None, 60, None), (1, "", 61, "y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, size long, in_size string")
    got = label_propagation.sharded_rows(docs, shards=4)
    assert got.columns == ["doc_id", "text", "in_in_size", "in_size", "size", "text_crc32", "shard", "slot"]
    held = collections.Counter((r["doc_id"], r["text"], r["in_in_size"], r["in_size"]) for r in got.collect())
    assert held == collections.Counter(rows)
    assert all(r["size"] == len(r["text"] or "") + 16 for r in got.collect())


@pytest.mark.parametrize("size", [2, 3])
def test_shards_hold_groups_together_without_any_unique_text(spark, size):
    rows = [(i, f"copy {i // size}") for i in range(600 * size)]
    got = label_propagation.balanced_shards(table(spark, rows), shards=8).collect()
    count = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and len(count) == 8 and max(count.values()) - min(count.values()) <= 1
    where = collections.defaultdict(set)
    for r in got:
        where[r["doc_id"] // size].add(r["shard"])
    assert sum(len(x) == 1 for x in where.values()) >= 0.9 * 600


def test_granted_wishes_are_the_most_that_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        wishes = rng.integers(0, 3, (3, 3))
        np.fill_diagonal(wishes, 0)
        room = rng.integers(0, 2, 3)
        got = label_propagation._granted(wishes, room)
        assert (got >= 0).all() and (got <= wishes).all() and (got.sum(axis=0) - got.sum(axis=1) <= room).all()
        most = 0
        for flat in itertools.product(*[range(w + 1) for w in wishes.ravel()]):
            x = np.array(flat).reshape(3, 3)
            if (x.sum(axis=0) - x.sum(axis=1) <= room).all():
                most = max(most, x.sum())
        assert got.sum() == most


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (200, 100)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and got[300] == 100


def test_context_sums_worked_out_once_equal_those_of_tasks(spark, monkeypatch):
    """With many texts no task works out sums of its own; the scores are the same."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 9))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(log_bilinear, "WORDS", 30)
    monkeypatch.setattr(log_bilinear, "CLASSES", 8)
    model, counts = log_bilinear.train(docs, F.lit(True))
    want = {r["doc_id"]: r for r in log_bilinear.score(docs, model, counts).collect()}
    made = []
    plain = log_bilinear.context_sums
    monkeypatch.setattr(log_bilinear, "MANY_TEXTS", 100)
    monkeypatch.setattr(log_bilinear, "context_sums", lambda *a: made.append(plain(*a)) or made[0])
    got = log_bilinear.score(docs, model, counts).collect()
    assert len(made) == 1 and made[0].shape == ((model.units + 1) ** 2,) and np.isfinite(made[0]).all()
    assert len(got) == 120
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]]["score"], abs=1e-4)
        assert (r["n_known"], r["base_score"]) == (want[r["doc_id"]]["n_known"], pytest.approx(want[r["doc_id"]]["base_score"]))


def test_words_of_the_language_model_are_looked_up_together(monkeypatch):
    """A chunk's new words cost one search of the common words, not one each; tokens are those of a plain split."""
    texts = [b" Word%d word%d\x0bother\xff\x1c%d " % (i, i % 7, i % 5) for i in range(300)] + [b"", b" \t", "\u00c9\u00a0A a".encode()]
    want = [text.lower().split() + [log_bilinear.END] for text in texts]
    flat = [word for own in want for word in own]
    names = np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in sorted(set(flat))[::2]], np.uint64))
    unit = np.where(np.arange(len(names)) % 3 == 0, np.arange(len(names)), -1)
    model = types.SimpleNamespace(names=names, counts=np.arange(len(names)) + 5, unit=unit)
    searches, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: searches.append(1) or plain(*a, **k))
    lookup = log_bilinear.Lookup(model)
    number, ends, facts = lookup.tokens(texts)
    again, _, _ = lookup.tokens(texts)
    assert len(searches) == 1 and (again == number).all()
    assert ends.tolist() == np.cumsum([len(own) for own in want]).tolist() and len(number) == len(flat)
    place = {int(name): k for k, name in enumerate(names)}
    for word, got in zip(flat, zip(*[held[number].tolist() for held in facts])):
        name = xxhash.xxh3_64_intdigest(word)
        k, cls = place.get(name, -1), xxhash.xxh3_64_intdigest(word.rstrip(b".,;:!?*#&%$|")[-3:]) % log_bilinear.CLASSES
        own = int(unit[k]) if k >= 0 else -1
        assert got == (own if own >= 0 else log_bilinear.WORDS + cls, k + 5 if k >= 0 else -1, -1 if own >= 0 else cls, name)
