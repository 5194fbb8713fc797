"""Queries for paging, greedy clusters, heads, assignment and the whole loop.

The SQL side walks the candidates one by one with a recursive query, so the
greedy rounds are checked against the plain sequential rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.registry import query, table
from topicloom.operators import clusters as C
from topicloom.operators import paging
from topicloom.plans import clustering as plan
from topicloom.staging import stage, stage_files, stage_path
from topicloom.streaming.pages import clusters_so_far, page_stream

NEAR = 0.30
TIGHT = 0.35
PAGE = 200
SMALLEST = 3
#: Bound that makes several parts of a few heads or queries.
PART_BYTES = 8192

SETTINGS = plan.Settings(threshold=NEAR, min_size=SMALLEST, page_size=PAGE, seed="0")


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


# ---------------------------------------------------------------- SQL building blocks

# A zero vector has cosine 0 here, but no number in DuckDB.
COSINE = "round(coalesce(nullif(list_cosine_similarity(a.vec, b.vec), 'NaN'::DOUBLE), 0.0), 6)"
VECTORS_SQL = "v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def pages_sql(name: str, ids: str, size: int, seed: str) -> str:
    """``name(id, page)`` for the ids of the relation ``ids``."""
    return f"""
    {name} AS MATERIALIZED (
        SELECT id, CAST(CASE WHEN r < m * (k + 1) THEN r // (k + 1) ELSE m + (r - m * (k + 1)) // k END AS INTEGER) AS page
        FROM (SELECT id, r, total // pages AS k, total % pages AS m
              FROM (SELECT id, row_number() OVER (ORDER BY md5('{seed}' || id), id) - 1 AS r, count(*) OVER () AS total,
                           CAST(ceil(count(*) OVER () / {size}) AS BIGINT) AS pages FROM {ids})))"""


def locality_sql(name: str, ids: str, size: int, seed: str) -> str:
    """``name(id, page)`` in the order of locality keys, for vectors ``v`` of 64 numbers."""
    return f"""
    {name}_plane AS MATERIALIZED (
        SELECT j, list(CASE WHEN ('0x' || left(md5('{seed}/' || j || '/' || i), 1))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS p
        FROM (SELECT unnest(range(0, {paging.PLANES})) AS j) CROSS JOIN (SELECT unnest(range(0, 64)) AS i) GROUP BY j),
    {name}_key AS MATERIALIZED (
        SELECT id, string_agg(CASE WHEN round(list_inner_product(vec, p), 6) >= 0 THEN '1' ELSE '0' END, '' ORDER BY j) AS k
        FROM (SELECT id FROM {ids}) JOIN v USING (id) CROSS JOIN {name}_plane GROUP BY id),
    {name} AS MATERIALIZED (
        SELECT id, CAST((row_number() OVER (ORDER BY k, md5('{seed}' || id), id) - 1 + {paging.page_shift(seed, size)}) // {size} AS INTEGER) AS page FROM {name}_key)"""


def candidates_sql(name: str, pages: str, threshold: float) -> str:
    return f"""
    {name} AS MATERIALIZED (
        SELECT p.page, p.id AS h, q.id AS m, {COSINE} AS s
        FROM {pages} p JOIN {pages} q ON p.page = q.page JOIN v a ON a.id = p.id JOIN v b ON b.id = q.id
        WHERE {COSINE} >= {threshold})"""


def greedy_sql(name: str, pages: str, threshold: float, smallest: int) -> str:
    """``name(head_id, member_id, score)``: sequential greedy per page by a recursive walk."""
    return f"""
    {candidates_sql(name + '_pair', pages, threshold)},
    {name}_list AS MATERIALIZED (
        SELECT page, h, list(m) AS ms, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, h) AS r
        FROM {name}_pair GROUP BY page, h HAVING count(*) >= {smallest}),
    {name}_walk(page, r, taken, head) AS (
        SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM {pages}
        UNION ALL
        SELECT w.page, c.r, CASE WHEN list_has_any(w.taken, c.ms) THEN w.taken ELSE list_concat(w.taken, c.ms) END,
               CASE WHEN list_has_any(w.taken, c.ms) THEN NULL ELSE c.h END
        FROM {name}_walk w JOIN {name}_list c ON c.page = w.page AND c.r = w.r + 1),
    {name} AS MATERIALIZED (
        SELECT p.h AS head_id, p.m AS member_id, p.s AS score
        FROM {name}_pair p JOIN {name}_walk w ON w.head = p.h AND w.page = p.page)"""


def large_sql(source: str, smallest: int, where: str = "true") -> str:
    return f"""(SELECT head_id, member_id, score FROM (
        SELECT *, count(*) OVER (PARTITION BY head_id) AS size FROM {source} WHERE {where}) WHERE size >= {smallest})"""


def refilter_sql(source: str, threshold: float) -> str:
    return f"""(SELECT * FROM (SELECT c.head_id, c.member_id, {COSINE} AS score
        FROM {source} c JOIN v a ON a.id = c.head_id JOIN v b ON b.id = c.member_id) WHERE score > {threshold})"""


def nearest_sql(ids: str, heads: str, threshold: float) -> str:
    return f"""(SELECT head_id, member_id, score FROM (
        SELECT h.id AS head_id, i.id AS member_id, {COSINE} AS score,
               row_number() OVER (PARTITION BY i.id ORDER BY {COSINE} DESC, h.id) AS r
        FROM {ids} i CROSS JOIN (SELECT DISTINCT head_id AS id FROM {heads}) h
        JOIN v a ON a.id = h.id JOIN v b ON b.id = i.id) WHERE r = 1 AND score >= {threshold})"""


def created_sql(
    name: str, ids: str, seed: str, size: int = PAGE, smallest: int = SMALLEST, threshold: float = NEAR, paging_of=pages_sql
) -> str:
    return f"""
    {paging_of(name + '_page', ids, size, seed)},
    {greedy_sql(name + '_raw', name + '_page', threshold, smallest)},
    {name} AS MATERIALIZED {large_sql(name + '_raw', smallest, f'score > {threshold}')}"""


def merged_sql(name: str, source: str, seed: str, threshold: float = NEAR) -> str:
    """Heads of ``source`` clustered in one page, members taken in, kept from two members on."""
    return f"""
    {name}_heads AS MATERIALIZED (SELECT DISTINCT head_id AS id FROM {source}),
    {pages_sql(name + '_page', name + '_heads', 20000, seed)},
    {greedy_sql(name + '_raw', name + '_page', threshold, 1)},
    {name}_wide AS MATERIALIZED (
        SELECT head_id, member_id FROM {name}_raw
        UNION SELECT g.head_id, o.member_id FROM {name}_raw g JOIN {source} o ON o.head_id = g.member_id),
    {name}_tight AS MATERIALIZED {refilter_sql(name + '_wide', threshold)},
    {name} AS MATERIALIZED {large_sql(name + '_tight', 2)}"""


def left_sql(clusters: str) -> str:
    return f"(SELECT id FROM v WHERE id NOT IN (SELECT member_id FROM {clusters}) AND id NOT IN (SELECT head_id FROM {clusters}))"


TRIPLE = "SELECT head_id, member_id, score FROM"
CREATED = f"{VECTORS_SQL}, {created_sql('c', 'v', '0/0')}"
WITH = "WITH RECURSIVE"


def created(spark, folder):
    return C.create_clusters(vectors(spark, folder), NEAR, SMALLEST, PAGE, "0/0")


# ---------------------------------------------------------------- pages and pairs


@query("paging_balanced", f"WITH {pages_sql('p', '(SELECT vec_id AS id FROM embeddings)', PAGE, '7')} SELECT id, page FROM p")
def paging_balanced(spark, folder):
    return paging.balanced_pages(vectors(spark, folder).select("id"), "id", PAGE, "7").select("id", "page")


@query(
    "paging_hash",
    "SELECT vec_id AS id, CAST(('0x' || substr(md5('7' || vec_id), 1, 8))::BIGINT % 16 AS INTEGER) AS page FROM embeddings",
)
def paging_hash(spark, folder):
    return paging.hash_pages(vectors(spark, folder).select("id"), "id", 16, "7")


PAIRS_SQL = f"{VECTORS_SQL}, {pages_sql('p', 'v', PAGE, '7')}, {candidates_sql('c', 'p', NEAR)}"


def _paged(spark, folder):
    return paging.balanced_pages(vectors(spark, folder), "id", PAGE, "7")


@query("page_pairs", f"WITH {PAIRS_SQL} SELECT page, h AS id_a, m AS id_b, s AS score FROM c WHERE h < m")
def page_pairs(spark, folder):
    return C.page_pairs(_paged(spark, folder), NEAR)


@query(
    "page_candidates",
    f"WITH {PAIRS_SQL} SELECT page, h AS head_id, count(*) AS size, round(sum(s), 6) AS total_score FROM c GROUP BY page, h",
)
def page_candidates(spark, folder):
    return C.page_candidates(_paged(spark, folder), NEAR).withColumn("total_score", F.round("total_score", 6))


# ---------------------------------------------------------------- clusters

GREEDY = f"{VECTORS_SQL}, {pages_sql('p', 'v', PAGE, '7')}, {greedy_sql('g', 'p', NEAR, SMALLEST)}"


@query("greedy_clusters", f"{WITH} {GREEDY} {TRIPLE} g")
def greedy_clusters(spark, folder):
    return C.greedy_clusters(_paged(spark, folder), NEAR, SMALLEST)


@query("create_clusters", f"{WITH} {CREATED} {TRIPLE} c")
def create_clusters(spark, folder):
    return created(spark, folder)


@query(
    "create_clusters_hashed",
    f"""{WITH} {VECTORS_SQL},
        p AS MATERIALIZED (SELECT id, CAST(('0x' || substr(md5('0/0' || id), 1, 8))::BIGINT
                           % (SELECT CAST(ceil(count(*) / {PAGE}) AS BIGINT) FROM v) AS INTEGER) AS page FROM v),
        {greedy_sql('g', 'p', NEAR, SMALLEST)}, c AS MATERIALIZED {large_sql('g', SMALLEST, f'score > {NEAR}')} {TRIPLE} c""",
)
def create_clusters_hashed(spark, folder):
    """Pages straight from the hash of the id."""
    return C.create_clusters(vectors(spark, folder), NEAR, SMALLEST, PAGE, "0/0", paging="hash")


@query(
    "cluster_sizes",
    f"""{WITH} {CREATED} SELECT head_id, count(*) AS size,
        CAST(row_number() OVER (ORDER BY count(*) DESC, head_id) - 1 AS INTEGER) AS topic FROM c GROUP BY head_id""",
)
def cluster_sizes(spark, folder):
    return C.topic_numbers(created(spark, folder))


@query(
    "cluster_coverage",
    f"""{WITH} {CREATED}, i AS (SELECT member_id AS id FROM c UNION SELECT head_id FROM c)
        SELECT count(i.id) AS clustered, count(*) AS total, round(count(i.id) * 100.0 / count(*), 2) AS percent
        FROM v LEFT JOIN i ON i.id = v.id""",
)
def cluster_coverage(spark, folder):
    return C.coverage(vectors(spark, folder), stage(created(spark, folder), "clusters"))


@query("refilter_heads", f"{WITH} {GREEDY} SELECT * FROM {refilter_sql('g', TIGHT)}")
def refilter_heads(spark, folder):
    return C.refilter(greedy_clusters(spark, folder), vectors(spark, folder), TIGHT)


@query(
    "overlap_removal",
    f"""{WITH} {GREEDY}, {pages_sql('p2', 'v', PAGE, '8')}, {greedy_sql('g2', 'p2', NEAR, SMALLEST)},
        u AS (SELECT * FROM g UNION ALL SELECT * FROM g2 WHERE head_id NOT IN (SELECT head_id FROM g)),
        z AS (SELECT *, count(*) OVER (PARTITION BY head_id) AS size FROM u),
        r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY size DESC, head_id) AS n FROM z)
        {TRIPLE} r WHERE n = 1""",
)
def overlap_removal(spark, folder):
    """Two cluster tables from different pages overlap; the larger cluster keeps a shared member."""
    both = stage(cluster_union(spark, folder), "both")
    return C.remove_overlap(both)


@query(
    "cluster_union",
    f"""{WITH} {GREEDY}, {pages_sql('p2', 'v', PAGE, '8')}, {greedy_sql('g2', 'p2', NEAR, SMALLEST)}
        {TRIPLE} g UNION ALL {TRIPLE} g2 WHERE head_id NOT IN (SELECT head_id FROM g)""",
)
def cluster_union(spark, folder):
    old = stage(greedy_clusters(spark, folder), "old")
    new = C.greedy_clusters(paging.balanced_pages(vectors(spark, folder), "id", PAGE, "8"), NEAR, SMALLEST)
    return C.union_clusters(old, new)


@query(
    "best_per_member",
    f"""{WITH} {GREEDY} SELECT head_id, member_id, max(score) AS score FROM (
        {TRIPLE} g UNION ALL SELECT head_id, member_id, round(score / 2, 6) FROM g) GROUP BY head_id, member_id""",
)
def best_per_member(spark, folder):
    """Every cluster row is there twice, once with half its score."""
    found = stage(greedy_clusters(spark, folder), "clusters")
    lower = found.withColumn("score", F.round(F.col("score") / 2, 6))
    return C.best_per_member(found.unionByName(lower))


@query("unclustered", f"{WITH} {CREATED} SELECT id FROM {left_sql('c')}")
def unclustered(spark, folder):
    return C.unclustered(vectors(spark, folder), stage(created(spark, folder), "clusters")).select("id")


@query("assign_nearest", f"{WITH} {CREATED}, l AS {left_sql('c')} SELECT * FROM {nearest_sql('l', 'c', NEAR)}")
def assign_nearest(spark, folder):
    found = stage(created(spark, folder), "clusters")
    left = C.unclustered(vectors(spark, folder), found)
    heads = vectors(spark, folder).join(found.select(F.col("head_id").alias("id")).distinct(), "id", "left_semi")
    return C.assign_nearest(left, heads, NEAR)


@query("assign_nearest_parts", f"{WITH} {CREATED}, l AS {left_sql('c')} SELECT * FROM {nearest_sql('l', 'c', NEAR)}")
def assign_nearest_parts(spark, folder):
    """As above with a bound so low that the heads are sent in several parts."""
    found = stage(created(spark, folder), "clusters")
    left = C.unclustered(vectors(spark, folder), found)
    heads = vectors(spark, folder).join(found.select(F.col("head_id").alias("id")).distinct(), "id", "left_semi")
    return C.assign_nearest(left, heads, NEAR, limit=PART_BYTES)


@query("assign_incremental", f"{WITH} {CREATED}, l AS {left_sql('c')} {TRIPLE} c UNION ALL SELECT * FROM {nearest_sql('l', 'c', NEAR)}")
def assign_incremental(spark, folder):
    return plan.assign_incremental(vectors(spark, folder), stage(created(spark, folder), "clusters"), NEAR)


@query(
    "cluster_stack",
    f"""{WITH} {CREATED}, n AS (SELECT head_id, CAST(row_number() OVER (ORDER BY count(*) DESC, head_id) - 1 AS INTEGER) AS topic FROM c GROUP BY head_id),
        t AS (SELECT member_id, topic FROM c JOIN n ON n.head_id = c.head_id)
        SELECT vec_id, label, coalesce(topic, -1) AS topic FROM embeddings LEFT JOIN t ON member_id = vec_id""",
)
def cluster_stack(spark, folder):
    found = stage(created(spark, folder), "clusters")
    return C.stack(table(spark, folder, "embeddings"), found, ["vec_id", "label"], "vec_id")


@query("merge_heads", f"{WITH} {CREATED}, {merged_sql('mg', 'c', '0/0/m1')} {TRIPLE} mg")
def merge_heads(spark, folder):
    found = stage(created(spark, folder), "clusters")
    return plan.merge_heads(found, vectors(spark, folder), SETTINGS, "0/0")


def loop_sql(settings: plan.Settings, start: str | None = None) -> str:
    """The loop over ``v(id, vec)`` written out: create, merge, keep large, assign; the result is ``found``.

    ``start`` names clusters to begin with; rows near their heads are given to them first.
    """
    near, smallest = settings.threshold, settings.min_size
    steps = ["f0 AS MATERIALIZED (SELECT 0::BIGINT AS head_id, 0::BIGINT AS member_id, 0.0::DOUBLE AS score WHERE false)"]
    if start is not None:
        steps = [f"f0 AS MATERIALIZED ({TRIPLE} {start} UNION ALL SELECT * FROM {nearest_sql(left_sql(start), start, near)})"]
    for turn in range(settings.iterations):
        c, m, seed = f"c{turn}", f"m{turn}", f"{settings.seed}/{turn}"
        steps += [
            f"l{turn} AS MATERIALIZED {left_sql(f'f{turn}')}",
            created_sql(c, f"l{turn}", seed, settings.page_size, smallest, near, locality_sql if settings.paging == "locality" else pages_sql),
            merged_sql(m, c, f"{seed}/m1", near),
            f"n{turn} AS MATERIALIZED {large_sql(m, smallest)}",
            f"u{turn} AS MATERIALIZED ({TRIPLE} f{turn} UNION ALL {TRIPLE} n{turn})",
            f"r{turn} AS MATERIALIZED {left_sql(f'u{turn}')}",
            f"f{turn + 1} AS MATERIALIZED ({TRIPLE} u{turn} UNION ALL SELECT * FROM {nearest_sql(f'r{turn}', f'u{turn}', near)})",
        ]
    return f"{', '.join(steps)}, found AS MATERIALIZED ({TRIPLE} f{settings.iterations})"


@query("iterative_clusters", f"{WITH} {VECTORS_SQL}, {loop_sql(SETTINGS)} {TRIPLE} found")
def iterative_clusters(spark, folder):
    return plan.iterative_clusters(vectors(spark, folder), SETTINGS)[0]


@query("paging_locality", f"WITH {VECTORS_SQL}, {locality_sql('p', 'v', PAGE, '7')} SELECT id, page FROM p")
def paging_locality(spark, folder):
    return paging.locality_pages(vectors(spark, folder), "id", "vec", PAGE, "7").select("id", "page")


WARM = f"{VECTORS_SQL}, {pages_sql('p9', 'v', PAGE, '9')}, {greedy_sql('g9', 'p9', TIGHT, SMALLEST)}, o AS MATERIALIZED {large_sql('g9', SMALLEST, f'score > {TIGHT}')}"


@query("warm_start_clusters", f"{WITH} {WARM}, {loop_sql(SETTINGS, 'o')} {TRIPLE} found")
def warm_start_clusters(spark, folder):
    """Tighter clusters from other pages are given; the loop fills them up and clusters the rest."""
    old = C.create_clusters(vectors(spark, folder), TIGHT, SMALLEST, PAGE, "9")
    return plan.iterative_clusters(vectors(spark, folder), SETTINGS, old)[0]


#: Lanes and page size of the streamed clusters, and the pages of a lane that the SQL side writes out.
LANES, LANE_PAGE, LANE_PAGES = 8, 24, 14
LOOSE = 0.22
STREAMED = plan.Settings(threshold=LOOSE, min_size=SMALLEST, page_size=LANE_PAGE)


def lanes_sql() -> str:
    """The pages of every lane one after the other; ``streamed`` has the clusters and the rows that heads took later."""
    steps = [
        "arrived AS MATERIALIZED (SELECT id, id % {n} AS lane FROM v)".format(n=LANES),
        "b0 AS MATERIALIZED (SELECT lane, -1::BIGINT AS stop FROM arrived GROUP BY lane)",
        "h0 AS MATERIALIZED (SELECT 0::BIGINT AS lane, 0::BIGINT AS head_id, 0::BIGINT AS member_id, 0.0::DOUBLE AS score WHERE false)",
    ]
    for t in range(LANE_PAGES):
        steps += [
            f"""n{t} AS MATERIALIZED (SELECT r.lane, r.id, x.head_id, x.score FROM arrived r JOIN b{t} USING (lane) LEFT JOIN (
                SELECT i.id, h.head_id, {COSINE} AS score, row_number() OVER (PARTITION BY i.id ORDER BY {COSINE} DESC, h.head_id) AS k
                FROM arrived i JOIN (SELECT DISTINCT lane, head_id FROM h{t}) h ON h.lane = i.lane JOIN v a ON a.id = h.head_id JOIN v b ON b.id = i.id
                ) x ON x.id = r.id AND x.k = 1 AND x.score >= {LOOSE} WHERE r.id > b{t}.stop)""",
            f"o{t} AS MATERIALIZED (SELECT lane, id, row_number() OVER (PARTITION BY lane ORDER BY id) AS k FROM n{t} WHERE head_id IS NULL)",
            f"""b{t + 1} AS MATERIALIZED (SELECT b{t}.lane, coalesce(max(o{t}.id), 9223372036854775807) AS stop
                FROM b{t} LEFT JOIN o{t} ON o{t}.lane = b{t}.lane AND o{t}.k = {LANE_PAGE} GROUP BY b{t}.lane)""",
            f"g{t}_page AS MATERIALIZED (SELECT id, o{t}.lane AS page FROM o{t} JOIN b{t + 1} q ON q.lane = o{t}.lane AND q.stop < 9223372036854775807 WHERE o{t}.k <= {LANE_PAGE})",
            greedy_sql(f"g{t}_raw", f"g{t}_page", LOOSE, SMALLEST),
            f"g{t} AS MATERIALIZED {large_sql(f'g{t}_raw', SMALLEST, f'score > {LOOSE}')}",
            f"""h{t + 1} AS MATERIALIZED (SELECT * FROM h{t} UNION ALL SELECT p.page, g.head_id, g.member_id, g.score FROM g{t} g JOIN g{t}_page p ON p.id = g.member_id
                UNION ALL SELECT n.lane, n.head_id, n.id, n.score FROM n{t} n JOIN b{t + 1} q ON q.lane = n.lane WHERE n.head_id IS NOT NULL AND n.id <= q.stop)""",
        ]
    return f"{', '.join(steps)}, streamed AS MATERIALIZED ({TRIPLE} h{LANE_PAGES})"


@query("stream_page_clusters", f"{WITH} {VECTORS_SQL}, {lanes_sql()} {TRIPLE} streamed")
def stream_page_clusters(spark, folder):
    """The vectors as a stream: pages of rows that no head took are clustered in keyed state, later rows go to their heads."""
    place = stage_path(spark, "stream")
    arrivals = spark.readStream.schema("id long, vec array<float>").parquet(stage_files(vectors(spark, folder), "arrivals"))
    query = page_stream(arrivals, STREAMED, f"{place}/out", f"{place}/checkpoint", LANES, lane=F.col("id") % LANES)
    query.awaitTermination()
    return clusters_so_far(spark, f"{place}/out")


@query(
    "member_ranks",
    f"""{WITH} {GREEDY} SELECT head_id, row_number() OVER (PARTITION BY head_id ORDER BY score DESC, member_id) AS rank,
        member_id, score FROM g""",
)
def member_ranks(spark, folder):
    return C.member_ranks(greedy_clusters(spark, folder))
