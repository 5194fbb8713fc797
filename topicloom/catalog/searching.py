"""Queries for encoders, document vectors, cells and search."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import regex
from pyspark.sql import functions as F

from topicloom.catalog.clustering import PART_BYTES, WITH, loop_sql
from topicloom.catalog.keywords import KEYWORDS_SQL, counts_sql, source_keywords, tokens_sql
from topicloom.catalog.registry import query, table
from topicloom.catalog.texts import strip_sql
from topicloom.functions import text as T
from topicloom.functions import vectors as X
from topicloom.functions.encoders import encode, factory_encoder, hash_encoder
from topicloom.operators import docvectors as D
from topicloom.operators import search as S
from topicloom.operators.fetch import save_buckets
from topicloom.operators.folding import fold_ordered
from topicloom.plans import clustering as plan
from topicloom.plans import searching as plan_of_search
from topicloom.staging import stage

DIM = 64
ENCODER = hash_encoder(DIM)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def _label_means(spark, folder):
    return D.mean_pool(_vectors(spark, folder), ["label"], "vec").select(F.col("label").alias("query_id"), "vec")


def _docs(spark, folder, *columns):
    return table(spark, folder, "documents").select("doc_id", "text", *columns)


def _long(df, *keys, vec="vec"):
    """Vectors as rows of non-zero rounded values, which compare well between engines."""
    rows = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    return rows.select(*keys, "pos", F.round(F.col("x").cast("double"), 6).alias("value")).where("value <> 0")


# ---------------------------------------------------------------- SQL building blocks

MEANS_SQL = """
    cells AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    means AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
    mean_vec AS MATERIALIZED (SELECT label, list(x ORDER BY i) AS vec FROM means GROUP BY label)"""


def hashed_sql(name: str, source: str, keys: str) -> str:
    """``name(keys, pos, x)``: unit hashed word vectors of the texts of ``source(keys, text)``, non-zero slots only."""
    return f"""
    {name}_word AS (SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h
                    FROM (SELECT {keys}, unnest({tokens_sql('text')}) AS w FROM {source})),
    {name}_slot AS (SELECT {keys}, CAST(h % {DIM} AS INTEGER) AS pos, sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS c
                    FROM {name}_word GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT {keys}, pos, CAST(c AS DOUBLE) / sqrt(sum(CAST(c * c AS DOUBLE)) OVER (PARTITION BY {keys})) AS x
                    FROM {name}_slot WHERE c <> 0)"""


def dense_sql(name: str, source: str, keys: str, ids: str) -> str:
    """``name(keys, vec)`` from long rows; every row of ``ids`` gets a vector of float precision."""
    return f"""
    {name} AS MATERIALIZED (SELECT {keys}, list(x ORDER BY pos) AS vec FROM (
        SELECT k.{keys}, p.pos, coalesce(CAST(CAST(s.x AS FLOAT) AS DOUBLE), 0.0) AS x
        FROM {ids} k CROSS JOIN (SELECT CAST(unnest(range(0, {DIM})) AS INTEGER) AS pos) p
        LEFT JOIN {source} s ON s.{keys} = k.{keys} AND s.pos = p.pos) GROUP BY {keys})"""


def l2_sql(a: str, b: str) -> str:
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"


# ---------------------------------------------------------------- vector arithmetic


@query(
    "cosine_pairs",
    f"""WITH {MEANS_SQL} SELECT vec_id AS doc_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), m.vec), 6) AS cosine
        FROM embeddings e JOIN mean_vec m ON m.label = e.label""",
)
def cosine_pairs(spark, folder):
    """Cosine of every vector to the mean of its label."""
    means = D.mean_pool(_vectors(spark, folder), ["label"], "vec", "mean")
    rows = _vectors(spark, folder).join(means, "label")
    return rows.select("doc_id", "label", F.round(X.cosine(F.col("vec"), F.col("mean")), 6).alias("cosine"))


@query(
    "softmax_scores",
    """WITH t AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            e AS (SELECT doc_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS r FROM t),
            n AS (SELECT doc_id, r, list_sum(r) AS total, unnest(range(1, len(r) + 1)) AS i FROM e)
       SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, round(r[i] / total, 9) AS share FROM n""",
)
def softmax_scores(spark, folder):
    rows = _vectors(spark, folder).select("doc_id", F.posexplode(X.softmax(F.col("vec"))).alias("pos", "share"))
    return rows.withColumn("share", F.round("share", 9))


@query("mean_pool", f"WITH {MEANS_SQL} SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(x, 6) AS value FROM means WHERE round(x, 6) <> 0")
def mean_pool(spark, folder):
    return _long(D.mean_pool(_vectors(spark, folder), ["label"], "vec"), "label")


# ---------------------------------------------------------------- encoders and document vectors


@query(
    "encode_hash",
    f"""WITH {hashed_sql('d', 'documents', 'doc_id')}
        SELECT doc_id, pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS value FROM d WHERE round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) <> 0""",
)
def encode_hash(spark, folder):
    return _long(encode(_docs(spark, folder), ENCODER, "text"), "doc_id")


@query(
    "pool_words",
    f"""WITH w AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents)),
        s AS (SELECT doc_id, CAST(h % {DIM} AS INTEGER) AS pos, sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS c FROM w GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
        x AS (SELECT doc_id, pos, CAST(CAST(c AS DOUBLE) / n AS FLOAT) AS x FROM s JOIN n USING (doc_id))
        SELECT doc_id, pos, round(CAST(x AS DOUBLE), 6) AS value FROM x WHERE round(CAST(x AS DOUBLE), 6) <> 0""",
)
def pool_words(spark, folder):
    """Mean of word vectors per text; the word table is made of all words of the texts."""
    docs = _docs(spark, folder)
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    words = stage(encode(words, ENCODER, "word"), "words")
    return _long(D.pooled_vectors(docs, words, "doc_id", "text"), "doc_id")


@query("pool_words_trained")
def pool_words_trained(spark, folder):
    """Word vectors learned from the texts; training is numeric, so there is no SQL."""
    docs = _docs(spark, folder)
    words = D.train_word_vectors(docs, "text", 16)
    return _long(D.pooled_vectors(docs, words, "doc_id", "text"), "doc_id")


SENTENCES_SQL = f"""
    parts AS (SELECT doc_id, string_split(text, '.') AS p FROM documents),
    sent AS (SELECT doc_id, i, len(p) AS n, {strip_sql('p[i]')} || '.' AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
    {hashed_sql('sv', 'sent', 'doc_id, i, n')},
    merged AS MATERIALIZED (SELECT doc_id, pos, sum(x * CASE WHEN i = 1 THEN pow(0.5, n - 1) ELSE pow(0.5, n - i + 1) END) AS x
               FROM sv GROUP BY doc_id, pos)"""
AS_FLOAT = "CAST(CAST(x AS FLOAT) AS DOUBLE)"


@query(
    "split_merge",
    f"WITH {SENTENCES_SQL} SELECT doc_id, pos, round({AS_FLOAT}, 6) AS value FROM merged WHERE round({AS_FLOAT}, 6) <> 0",
)
def split_merge(spark, folder):
    return _long(D.split_merge(_docs(spark, folder), ENCODER, "text"), "doc_id")


@query(
    "fold_sentences",
    f"""WITH {SENTENCES_SQL},
        folded AS (SELECT doc_id, pos, sum({AS_FLOAT} * CASE WHEN i = 1 THEN pow(0.5, n - 1) ELSE pow(0.5, n - i + 1) END) AS x FROM sv GROUP BY doc_id, pos)
        SELECT doc_id, pos, round({AS_FLOAT}, 6) AS value FROM folded WHERE round({AS_FLOAT}, 6) <> 0""",
)
def fold_sentences(spark, folder):
    """As split_merge, from a table of sentence vectors of float precision that lie in any partitions."""
    sentences = _docs(spark, folder).select("doc_id", F.posexplode(T.split_sentences(F.coalesce("text", F.lit("")))).alias("at", "sentence"))
    spread = encode(sentences, ENCODER, "sentence").select("doc_id", "at", "vec").repartition(F.xxhash64("doc_id", "at"))
    return _long(fold_ordered(spread, "doc_id", "at"), "doc_id")


@query(
    "encode_loaded_model",
    f"""WITH {hashed_sql('d', 'documents', 'doc_id')}
        SELECT doc_id, pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS value FROM d WHERE round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) <> 0""",
)
def encode_loaded_model(spark, folder):
    """The hashed encoder as a model that every Python worker loads once."""
    return _long(encode(_docs(spark, folder), factory_encoder(hashed_model, DIM), "text"), "doc_id")


def hashed_model():
    """A loader: gives a function from texts to their hashed word vectors."""

    def place(word: str) -> tuple[int, float]:
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return h % DIM, 1.0 if h // DIM % 2 == 0 else -1.0

    places = functools.lru_cache(100_000)(place)
    words = regex.compile(r"[\p{L}\p{N}_]{2,}")

    def model(texts):
        rows = np.zeros((len(texts), DIM))
        for k, text in enumerate(texts):
            for word in words.findall(text.lower()):
                at, sign = places(word)
                rows[k, at] += sign
        size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return np.divide(rows, size, out=rows, where=size > 0)

    return model


GATE_SQL = "(1.0 / (1.0 + exp(-(a - 0.5 * b + 0.1))))"


@query(
    "split_merge_gated",
    f"""WITH {SENTENCES_SQL},
        dense AS (SELECT s.doc_id, s.i, p.pos, coalesce(v.x, 0.0) AS x
                  FROM sent s CROSS JOIN (SELECT CAST(unnest(range(0, {DIM})) AS INTEGER) AS pos) p
                  LEFT JOIN sv v ON v.doc_id = s.doc_id AND v.i = s.i AND v.pos = p.pos),
        runs AS (SELECT doc_id, pos, list(x ORDER BY i) AS xs FROM dense GROUP BY doc_id, pos),
        folded AS (SELECT doc_id, pos, list_reduce(xs, lambda a, b: {GATE_SQL} * a + (1.0 - {GATE_SQL}) * b) AS x FROM runs)
        SELECT doc_id, pos, round({AS_FLOAT}, 6) AS value FROM folded WHERE round({AS_FLOAT}, 6) <> 0""",
)
def split_merge_gated(spark, folder):
    """A dense sigmoid gate; its weights act on each slot alone, so SQL can fold slot by slot."""
    eye = np.eye(DIM)
    gate = D.Gate(weight=np.concatenate([eye, -0.5 * eye], axis=1), bias=np.full(DIM, 0.1))
    return _long(D.split_merge(_docs(spark, folder), ENCODER, "text", gate), "doc_id")


BLEND_SQL = f"""{KEYWORDS_SQL},
    key_text AS (SELECT topic, replace(keywords, ', ', ' ') AS text FROM keys),
    {hashed_sql('kv', 'key_text', 'topic')},
    {hashed_sql('dv', 'documents', 'doc_id')},
    mixed AS (SELECT doc_id, pos, sum(x) AS x FROM (
        SELECT d.doc_id, k.pos, {AS_FLOAT} * 0.25 AS x FROM documents d JOIN kv k ON k.topic = d.source
        UNION ALL SELECT doc_id, pos, {AS_FLOAT} * 0.75 FROM dv) GROUP BY doc_id, pos)"""


@query(
    "blend_vectors",
    f"WITH {BLEND_SQL} SELECT doc_id, pos, round({AS_FLOAT}, 6) AS value FROM mixed WHERE round({AS_FLOAT}, 6) <> 0",
)
def blend_vectors(spark, folder):
    keys = source_keywords(spark, folder).select("topic", F.array_join("keywords", ", ").alias("keywords"))
    docs = _docs(spark, folder, F.col("source").alias("topic"))
    return _long(D.build_vectors(docs, ENCODER, "text", keys, split=False), "doc_id")


# ---------------------------------------------------------------- exhaustive search


def _flat_sql(score: str, order: str) -> str:
    return f"""WITH {MEANS_SQL},
        s AS (SELECT CAST(m.label AS BIGINT) AS query_id, e.vec_id AS doc_id, {score} AS score FROM mean_vec m CROSS JOIN embeddings e),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 5"""


@query("search_flat_l2", _flat_sql(l2_sql("m.vec", "CAST(e.embedding AS DOUBLE[])"), "ASC"))
def search_flat_l2(spark, folder):
    """Nearest five vectors of every label mean."""
    return S.search_flat(_vectors(spark, folder), _label_means(spark, folder), 5)


@query("search_flat_parts", _flat_sql(l2_sql("m.vec", "CAST(e.embedding AS DOUBLE[])"), "ASC"))
def search_flat_parts(spark, folder):
    """As above with a bound so low that the queries are sent in several parts."""
    return S.search_flat(_vectors(spark, folder), stage(_label_means(spark, folder), "means"), 5, limit=PART_BYTES)


@query("search_flat_ip", _flat_sql("round(list_inner_product(m.vec, CAST(e.embedding AS DOUBLE[])), 6)", "DESC"))
def search_flat_ip(spark, folder):
    return S.search_flat(_vectors(spark, folder), _label_means(spark, folder), 5, "ip")


HITS_SQL = f"""
    {hashed_sql('dh', 'documents', 'doc_id')}, {dense_sql('dv', 'dh', 'doc_id', 'documents')},
    {hashed_sql('bh', 'benchmark', 'item_id')}, {dense_sql('bv', 'bh', 'item_id', 'benchmark')}"""


def _encoded(spark, folder):
    docs = encode(_docs(spark, folder, "source"), ENCODER, "text").select("doc_id", "source", "vec")
    asked = encode(table(spark, folder, "benchmark"), ENCODER, "text").select(F.col("item_id").alias("query_id"), "vec")
    return stage(docs, "encoded"), asked


@query(
    "hit_fetch",
    f"""WITH {HITS_SQL},
        s AS (SELECT b.item_id AS query_id, d.doc_id, {l2_sql('b.vec', 'd.vec')} AS score FROM bv b CROSS JOIN dv d),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, r.doc_id, r.score, d.lang, d.source, sha256(d.text) AS text_sha256
        FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 3""",
)
def hit_fetch(spark, folder):
    """Hits with their documents, which lie by bucket of their id; only the buckets of the hits are read."""
    docs, asked = _encoded(spark, folder)
    path = plan_of_search.index_path(spark)
    save_buckets(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), path, buckets=128)
    hits = S.attach_documents(S.search_flat(docs, asked, 3), spark.read.parquet(path), ["lang", "source", "text"])
    return hits.select("query_id", "rank", "doc_id", "score", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query(
    "search_format",
    f"""WITH {HITS_SQL},
        s AS (SELECT b.item_id AS query_id, d.doc_id, {l2_sql('b.vec', 'd.vec')} AS score FROM bv b CROSS JOIN dv d),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, r.doc_id,
               'Top ' || rank || ' - ' || lang || ' (' || source || ') | ' || r.doc_id || ' | ' || text AS line
        FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 3""",
)
def search_format(spark, folder):
    docs, asked = _encoded(spark, folder)
    hits = S.attach_documents(S.search_flat(docs, asked, 3), table(spark, folder, "documents"), ["lang", "source", "text"])
    lines = S.format_hits(hits, "Top %d - %s (%s) | %d | %s", ["rank", "lang", "source", "doc_id", "text"])
    return lines.select("query_id", "rank", "doc_id", "line")


# ---------------------------------------------------------------- cells


IVF_ASSIGN_SQL = (
    f"""WITH {MEANS_SQL}, s AS (SELECT e.vec_id AS doc_id, m.label AS cell, {l2_sql('m.vec', 'CAST(e.embedding AS DOUBLE[])')} AS far FROM embeddings e CROSS JOIN mean_vec m),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY far, cell) AS n FROM s)
        SELECT doc_id, cell FROM r WHERE n = 1"""
)


@query("ivf_assign", IVF_ASSIGN_SQL)
def ivf_assign(spark, folder):
    centroids = _label_means(spark, folder).select(F.col("query_id").cast("int").alias("cell"), F.col("vec").alias("centroid"))
    return S.assign_cells(_vectors(spark, folder), centroids).select("doc_id", "cell")


@query("ivf_assign_parts", IVF_ASSIGN_SQL)
def ivf_assign_parts(spark, folder):
    """As above with a bound so low that the centroids are sent in several parts."""
    centroids = stage(_label_means(spark, folder).select(F.col("query_id").cast("int").alias("cell"), F.col("vec").alias("centroid")), "means")
    return S.assign_cells(_vectors(spark, folder), centroids, limit=PART_BYTES).select("doc_id", "cell")


SEARCH_IVF_SQL = (
    f"""WITH {HITS_SQL},
        cn AS MATERIALIZED (SELECT CAST(substr(source, 4) AS INTEGER) AS cell, list(x ORDER BY i) AS vec FROM (
            SELECT source, i, avg(vec[i]) AS x FROM (SELECT doc_id, vec, unnest(range(1, {DIM + 1})) AS i FROM dv) JOIN documents USING (doc_id) GROUP BY source, i) GROUP BY source),
        dc AS MATERIALIZED (SELECT doc_id, vec, cell FROM (
            SELECT doc_id, d.vec, cell, row_number() OVER (PARTITION BY doc_id ORDER BY {l2_sql('d.vec', 'c.vec')}, cell) AS n FROM dv d CROSS JOIN cn c) WHERE n = 1),
        qc AS MATERIALIZED (SELECT item_id, vec, cell FROM (
            SELECT item_id, b.vec, cell, row_number() OVER (PARTITION BY item_id ORDER BY {l2_sql('b.vec', 'c.vec')}, cell) AS n FROM bv b CROSS JOIN cn c) WHERE n <= 3),
        s AS (SELECT item_id AS query_id, doc_id, {l2_sql('q.vec', 'd.vec')} AS score FROM qc q JOIN dc d ON d.cell = q.cell),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 5"""
)


@query("search_ivf", SEARCH_IVF_SQL)
def search_ivf(spark, folder, limit=S.blocks.BROADCAST_BYTES):
    """Three nearest of the cells whose centroids are the means of the sources."""
    docs, asked = _encoded(spark, folder)
    means = stage(D.mean_pool(docs, ["source"], "vec", "centroid"), "centroids")
    centroids = means.select(F.substring("source", 4, 10).cast("int").alias("cell"), "centroid")
    return S.search_cells(S.assign_cells(docs, centroids, limit=limit), centroids, asked, 5, 3, limit=limit)


@query("search_ivf_parts", SEARCH_IVF_SQL)
def search_ivf_parts(spark, folder):
    """As above with a bound so low that the queries are sent in several parts."""
    return search_ivf(spark, folder, 4 * PART_BYTES)


@query(
    "search_ivf_trained",
    f"""WITH {HITS_SQL},
        s AS (SELECT b.item_id AS query_id, d.doc_id, {l2_sql('b.vec', 'd.vec')} AS score FROM bv b CROSS JOIN dv d),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 5""",
)
def search_ivf_trained(spark, folder):
    """K-means cells kept as a table by cell; all cells are probed, which must equal the exhaustive search."""
    docs, asked = _encoded(spark, folder)
    centroids = S.train_cells(docs, 20)
    path = plan_of_search.index_path(spark)
    S.save_index(S.assign_cells(docs, centroids).select("doc_id", "vec", "cell"), path)
    return S.search_cells(spark.read.parquet(path), centroids, asked, 5, 20)


# ---------------------------------------------------------------- the whole way


E2E = plan.Settings(threshold=0.8, min_size=3, page_size=1000)


E2E_SQL = (
    f"""{WITH} {HITS_SQL}, v AS MATERIALIZED (SELECT doc_id AS id, vec FROM dv), {loop_sql(E2E)},
        numbers AS (SELECT head_id, CAST(row_number() OVER (ORDER BY count(*) DESC, head_id) - 1 AS INTEGER) AS topic FROM found GROUP BY head_id),
        stacked AS MATERIALIZED (
            SELECT d.doc_id, d.text, d.lang, d.source, coalesce(n.topic, -1) AS topic
            FROM documents d LEFT JOIN found f ON f.member_id = d.doc_id LEFT JOIN numbers n ON n.head_id = f.head_id),
        {counts_sql('topic', 'stacked', 'true')},
        keys AS MATERIALIZED (
            SELECT t.topic, coalesce(string_agg(term, ', ' ORDER BY rank), '') AS keywords
            FROM (SELECT DISTINCT topic FROM stacked) t LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.topic = t.topic GROUP BY t.topic),
        key_text AS (SELECT topic, replace(keywords, ', ', ' ') AS text FROM keys),
        {hashed_sql('kv', 'key_text', 'topic')},
        {SENTENCES_SQL},
        mixed AS (SELECT doc_id, pos, sum(x) AS x FROM (
            SELECT d.doc_id, k.pos, {AS_FLOAT} * 0.25 AS x FROM stacked d JOIN kv k ON k.topic = d.topic
            UNION ALL SELECT doc_id, pos, {AS_FLOAT} * 0.75 FROM merged) GROUP BY doc_id, pos),
        {dense_sql('fv', 'mixed', 'doc_id', 'documents')},
        s AS (SELECT b.item_id AS query_id, d.doc_id, {l2_sql('b.vec', 'd.vec')} AS score FROM bv b CROSS JOIN fv d),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s)
        SELECT query_id, CAST(r.rank AS INTEGER) AS rank, r.doc_id, r.score, d.topic, k.keywords, d.lang, d.source
        FROM r JOIN stacked d ON d.doc_id = r.doc_id JOIN keys k ON k.topic = d.topic WHERE r.rank <= 5"""
)


@query("e2e_search", E2E_SQL)
def e2e_search(spark, folder):
    """Documents to clusters, keywords, merged and blended vectors, and ranked hits for all benchmark texts."""
    docs = _docs(spark, folder, "lang", "source")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    built = plan_of_search.build(docs, ENCODER, "text", ["doc_id", "text", "lang", "source"], E2E, n_keywords=10)
    return plan_of_search.search(built, asked, ENCODER, 5, ["topic", "keywords", "lang", "source"])


@query("e2e_search_cells", E2E_SQL)
def e2e_search_cells(spark, folder):
    """The same hits from tables that were saved by cell and loaded again; the cells are the means of the sources, all probed."""
    docs = _docs(spark, folder, "lang", "source")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    built = plan_of_search.build(docs, ENCODER, "text", ["doc_id", "text", "lang", "source"], E2E, n_keywords=10)
    means = stage(D.mean_pool(built.vectors.join(docs.select("doc_id", "source"), "doc_id"), ["source"], "vec", "centroid"), "centroids")
    centroids = means.select(F.substring("source", 4, 10).cast("int").alias("cell"), "centroid")
    path = plan_of_search.index_path(spark)
    plan_of_search.save(plan_of_search.with_cells(built, centroids), path)
    kept = plan_of_search.load(spark, path)
    return plan_of_search.search(kept, asked, ENCODER, 5, ["topic", "keywords", "lang", "source"], centroids=centroids, probes=centroids.count())
