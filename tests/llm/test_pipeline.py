"""The pipeline and the registered queries on small written tables, odd rows included."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import ODD, SCHEMA, shingle_set, words
from topicloom.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id long, text string"
GOOD, BAD = range(0, 80), range(200, 240)


def lines_of(all_words):
    return "\n".join(" ".join(all_words[i : i + 12]) + "." for i in range(0, len(all_words), 12))


def document_rows(items):
    good = [(i, lines_of(words(i, 60)), "en", f"s{i % 3}") for i in GOOD]
    bad = [(i, "\n".join(" | ".join(w.upper() + "!!" for w in words(i * 5 + k, 12)) for k in range(4)), "en", "s0") for i in BAD]
    copies = [(300 + i, good[i % 4][1], "de", "s1") for i in range(20)]
    near = []
    for i in range(5):
        changed = good[10 + i][1].split(" ")
        changed[7] = "changed"
        near.append((400 + i, " ".join(changed), "en", "s2"))
    leaks = [(500 + k, lines_of(words(900 + k, 24)) + "\n" + text + "\n" + lines_of(words(950 + k, 24)), "en", "s1") for k, (_, text) in enumerate(items)]
    odd = [(i, t, None, None) for i, t in ODD]
    return [(i, t, lang, source, len(t or ""), "x", "y") for i, t, lang, source in good + bad + copies + near + leaks + odd]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    items = [(k, " ".join(words(700 + k, 30))) for k in range(4)]
    labels = [(i, 1, 0) for i in GOOD] + [(i, 0, 0) for i in BAD] + [(None, 1, 0), (3, None, 0)]
    for name, rows, schema in (
        ("documents", document_rows(items), SCHEMA),
        ("labels", labels, LABELS),
        ("benchmark", items + [(10, None), (11, ""), (None, "too short")], BENCHMARK),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("labels", LABELS), ("benchmark", BENCHMARK)):
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}.parquet")
    return out


def classes(rows):
    """Least id of what similar and equal texts connect, by comparing all pairs."""
    sets = [shingle_set(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            equal = (rows[a]["text"] or "") == (rows[b]["text"] or "")
            if equal or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a, r in enumerate(rows):
        groups[find(a)].append(r["doc_id"])
    return sorted(min((i for i in ids if i is not None), default=-1) for ids in groups.values())


def carried(columns):
    """Names of the columns of documents in the last stage, which has a size of its own."""
    return ["in_size" if c == "size" else c for c in columns]


def test_stages_equal_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, tables[-1], folder).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(t.columns == columns for t in tables[:-1])
    source, good, single, clean, mixed, sharded = [t.collect() for t in tables]

    judged = collections.Counter(r["doc_id"] for r in QUERIES["op2_quality"](spark, folder).where("predicted = 1").collect())
    ids = collections.Counter(r["doc_id"] for r in good)
    assert ids == judged and set(GOOD) <= set(ids) and not set(BAD) & set(ids)

    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in single) == classes(good)

    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 5]
    leaked = {r["doc_id"] for r in single if any(len(q & shingle_set(r["text"])) >= 0.8 * len(q) for q in items)}
    assert {500, 501, 502, 503} <= leaked
    assert sorted(map(str, (r["doc_id"] for r in clean))) == sorted(str(r["doc_id"]) for r in single if r["doc_id"] not in leaked)

    sizes, taken, texts = collections.Counter(), collections.Counter(), {r["doc_id"]: r for r in clean}
    for r in clean:
        sizes[r["source"]] += len((r["text"] or "").split())
    own = collections.Counter()
    for r in mixed:
        n = len(r["text"].split())
        taken[r["source"]] += n
        own[r["doc_id"]] += n
        assert f" {' '.join(r['text'].split())} " in f" {' '.join(texts[r['doc_id']]['text'].split())} "
        assert r["n_chars"] == len(r["text"]) and r["lang"] == texts[r["doc_id"]]["lang"]
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    low, high = 0.0, float(sum(sizes.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * (k % 3 + 1)) for k, s in enumerate(names)) < sum(sizes.values()) else (low, level)
    assert all(abs(taken[s] - min(3 * sizes[s], high * (k % 3 + 1))) <= 1 for k, s in enumerate(names))
    assert all(n <= 3 * len(texts[i]["text"].split()) for i, n in own.items())

    facts = lambda i, text: (i, len(text.encode()) + 16, zlib.crc32(text.encode()))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in sharded) == collections.Counter(facts(r["doc_id"], r["text"]) for r in mixed)
    bodies = lambda rows, names: collections.Counter(str([r[c] for c in names]) for r in rows)
    assert bodies(sharded, carried(columns)) == bodies(mixed, columns)
    count = collections.Counter(r["shard"] for r in sharded)
    assert set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in sharded) == [(s, k) for s in range(40) for k in range(count[s])]

    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, sharded))


def test_pipeline_of_empty_tables(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).columns == [*carried(spark.read.parquet(f"{nothing}/documents.parquet").columns), "size", "text_crc32", "shard", "slot"]
    assert corpus_pipeline.run(spark, nothing).count() == 0


#: These read other tables; their odd cases are tested beside their operators.
OTHER_TABLES = {"op11_hard_negatives", "op12_conversation_repair"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_TABLES))
def test_registered_query_on_odd_and_empty_tables(spark, folder, nothing, name):
    got = QUERIES[name](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = docs.count() if name != "op8_benchmark_containment" else 4
    assert got.count() == want
    if name != "op8_benchmark_containment":
        ids = got.groupBy("doc_id").count().exceptAll(docs.groupBy("doc_id").count())
        assert ids.isEmpty()
    assert not got.columns.count("doc_id") - 1
    empty = QUERIES[name](spark, nothing)
    assert empty.columns == got.columns and empty.count() == 0


@pytest.mark.parametrize("name, folds, rest", [("op2_quality", 5, 0), ("op5_language", 4, 2), ("op6_language_model", 5, 1)])
def test_held_out_fold(spark, folder, name, folds, rest):
    for r in QUERIES[name](spark, folder).where(F.col("doc_id").isNotNull()).select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == rest)
