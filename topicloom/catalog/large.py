"""Queries of operators whose two sides may both be large."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from topicloom.catalog.clustering import WITH, loop_sql
from topicloom.catalog.registry import query, table
from topicloom.catalog.searching import ENCODER, HITS_SQL, dense_sql, hashed_sql, l2_sql
from topicloom.functions.encoders import encode
from topicloom.operators import celltree
from topicloom.operators import nearest as N
from topicloom.operators import search as S
from topicloom.plans import clustering as plan
from topicloom.plans.searching import index_path
from topicloom.staging import stage

#: Cosine from which a document goes to a head.
CLOSE = 0.9
#: Blocks that a document may meet before the heads are sent to all tasks instead.
BLOCKS_MET = 32


def encoded(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return stage(encode(docs, ENCODER, "text").select("id", "vec"), "encoded")


# ---------------------------------------------------------------- nearest head by bounds

# A zero vector has cosine 0 here, but no number in DuckDB.
NEAREST_SQL = f"""
    {hashed_sql('dh', 'documents', 'doc_id')}, {dense_sql('dv', 'dh', 'doc_id', 'documents')},
    s AS (SELECT h.doc_id AS head_id, d.doc_id AS member_id, round(coalesce(nullif(list_cosine_similarity(h.vec, d.vec), 'NaN'::DOUBLE), 0.0), 6) AS score
          FROM dv d JOIN dv h ON h.doc_id % 4 = 0),
    best AS (SELECT * FROM s WHERE score >= {CLOSE} QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY score DESC, head_id) = 1)"""


@query("assign_nearest_pruned", f"WITH {NEAREST_SQL} SELECT head_id, member_id, score FROM best")
def assign_nearest_pruned(spark, folder):
    """Every fourth document is a head; the others go to the nearest one through blocks and bounds."""
    docs = encoded(spark, folder)
    return N.assign_nearest_pruned(docs, docs.where("id % 4 = 0"), CLOSE, spread=BLOCKS_MET)


# ---------------------------------------------------------------- trained cells

#: Leaves of the tree, and how many of them a query is searched in.
CELLS, PROBES = 48, 16

FLAT_SQL = f"""
    {HITS_SQL},
    s AS (SELECT b.item_id AS query_id, d.doc_id, {l2_sql('b.vec', 'd.vec')} AS score FROM bv b CROSS JOIN dv d),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s)"""


def _tree(spark, folder):
    """Documents laid out by the leaves of a trained tree, the tree, and the benchmark texts as queries."""
    docs = encoded(spark, folder).withColumnRenamed("id", "doc_id")
    asked = encode(table(spark, folder, "benchmark"), ENCODER, "text").select(F.col("item_id").alias("query_id"), "vec")
    tree = celltree.train_cell_tree(docs, CELLS)
    path = index_path(spark)
    S.save_index(celltree.assign_tree_cells(docs, tree), path)
    return docs, spark.read.parquet(path), tree, stage(asked, "asked")


@query("search_tree_all", f"WITH {FLAT_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 5")
def search_tree_all(spark, folder):
    """With every leaf probed the tree must find what the exhaustive search finds."""
    _, laid, tree, asked = _tree(spark, folder)
    leaves, tops = tree.leaves.count(), tree.tops.count()
    return celltree.search_tree(laid, tree, asked, 5, leaves, tops)


@query("search_tree_recall", f"WITH {FLAT_SQL} SELECT count(*) AS wanted, true AS found_nine_in_ten, true AS fewer_probes FROM r WHERE rank <= 5")
def search_tree_recall(spark, folder):
    """A third of the cells probed: the share of the exhaustive search's hits, and that cells were left out."""
    docs, laid, tree, asked = _tree(spark, folder)
    hits = celltree.search_tree(laid, tree, asked, 5, PROBES)
    found = celltree.recall(hits, stage(S.search_flat(docs, asked, 5), "exact"))
    fewer = F.lit(tree.leaves.count() > PROBES)
    return found.select("wanted", (F.col("recall") >= 0.9).alias("found_nine_in_ten"), fewer.alias("fewer_probes"))


# ---------------------------------------------------------------- small groups in few rounds

#: Groups of three and more among pages that hold a twentieth of the documents of sf0.01.
SPARSE = plan.Settings(threshold=0.93, min_size=3, page_size=50, seed="5")
FEW = replace(SPARSE, paging="locality", iterations=3)
MANY = replace(SPARSE, iterations=15)


def _loop_sql(settings: plan.Settings) -> str:
    return f"""{WITH} {hashed_sql('dh', 'documents', 'doc_id')}, {dense_sql('dv', 'dh', 'doc_id', 'documents')},
        v AS MATERIALIZED (SELECT doc_id AS id, vec FROM dv), {loop_sql(settings)}"""


@query("locality_clusters", f"{_loop_sql(FEW)} SELECT head_id, member_id, score FROM found")
def locality_clusters(spark, folder):
    """Three rounds of locality pages over the documents."""
    return plan.iterative_clusters(encoded(spark, folder), FEW)[0]


@query("locality_gain", f"{_loop_sql(FEW)} SELECT count(*) AS members, count(DISTINCT head_id) AS groups, true AS as_many_as_random FROM found")
def locality_gain(spark, folder):
    """What three rounds of locality pages find, and whether fifteen rounds of random pages find no more members."""
    docs = encoded(spark, folder)
    few, many = (plan.iterative_clusters(docs, settings)[0] for settings in (FEW, MANY))
    counted = few.agg(F.count(F.lit(1)).alias("members"), F.count_distinct("head_id").alias("groups"))
    other = many.agg(F.count(F.lit(1)).alias("others"))
    return counted.join(F.broadcast(other)).select("members", "groups", (F.col("members") >= F.col("others")).alias("as_many_as_random"))
