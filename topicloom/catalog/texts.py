"""Queries for sources, row operators and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.catalog.registry import query, sql_text, table
from topicloom.functions import fixed_values as V
from topicloom.functions import text as T
from topicloom.operators import tables
from topicloom.sources import files, splits
from topicloom.staging import ordered_index, stage_path

WHITE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||" + (
    "||".join(f"chr({c})" for c in [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)
LATIN_KEEP = V.RECORD_KEEP + "A-Za-zÀ-ÿ"


def strip_sql(text: str) -> str:
    return f"trim({text}, {WHITE})"


def clean_corpus_sql(text: str) -> str:
    one = f"translate({text}, {sql_text(V.CORPUS_PUNCTUATION)}, {sql_text(' ' * len(V.CORPUS_PUNCTUATION))})"
    one = f"replace({one}, ']', '.')"
    one = strip_sql(rf"regexp_replace({one}, '[{V.WHITESPACE_CLASS}]+', ' ', 'g')")
    for phrase in V.CORPUS_PHRASES:
        one = f"replace({one}, {sql_text(phrase)}, '')"
    return one


def clean_record_sql(text: str, keep: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '[^{keep}{V.WHITESPACE_CLASS}]', ' ', 'g'), '[{V.WHITESPACE_CLASS}]+', ' ', 'g'))"


# ---------------------------------------------------------------- sources


@query(
    "src_csv_roundtrip",
    """SELECT doc_id, text, CASE WHEN lang <> 'fr' THEN lang END AS lang, source,
              CASE WHEN lang <> 'de' THEN n_chars END AS n_chars
       FROM documents""",
)
def src_csv_roundtrip(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), "source",
        F.when(F.col("lang") != "de", F.col("n_chars")).alias("n_chars"),
    )
    path = stage_path(spark, "csv")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@query("src_csv_splits", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv_splits(spark, folder):
    """Texts with commas, quotes and line ends through a CSV file that is read in splits."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = stage_path(spark, "csv")
    files.write_csv(docs, path)
    return splits.read_csv_splits(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@query(
    "src_json_props",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.z') AS z FROM events",
)
def src_json_props(spark, folder):
    props = files.json_fields(F.col("props"), "k int, z string")
    return table(spark, folder, "events").select("event_id", props.alias("p")).select("event_id", "p.k", "p.z")


@query(
    "src_xml_list",
    """WITH p AS (SELECT page_id, page_id // 20 AS listing, url FROM pages)
       SELECT listing, count(*) OVER (PARTITION BY listing) AS total,
              CAST(row_number() OVER (PARTITION BY listing ORDER BY page_id) - 1 AS INTEGER) AS pos, url AS link
       FROM p""",
)
def src_xml_list(spark, folder):
    """Listing payloads of 20 records each are built from the pages, then scanned."""
    link = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    record = F.concat(F.lit("<record><no>"), F.col("page_id"), F.lit("</no><link>"), link, F.lit("</link></record>"))
    listings = (
        table(spark, folder, "pages")
        .select(F.floor(F.col("page_id") / 20).alias("listing"), "page_id", record.alias("record"))
        .groupBy("listing")
        .agg(F.sort_array(F.collect_list(F.struct("page_id", "record"))).alias("records"))
    )
    payload = F.concat(
        F.lit("<listing><target>t</target><totalCnt>"), F.size("records"), F.lit("</totalCnt>"),
        F.array_join(F.transform("records", lambda r: r["record"]), ""), F.lit("</listing>"),
    )
    return files.xml_listing(listings.select("listing", payload.alias("payload")), "payload", "record", "link", "totalCnt")


@query(
    "src_xml_detail",
    rf"""WITH p AS (SELECT page_id, url, html, coalesce({strip_sql("regexp_extract(html, '<title>(.+?)</title>', 1)")}, '') AS t FROM pages),
            q AS (SELECT page_id, url, html, regexp_replace(t, '[&<>]', ' ', 'g') AS t FROM p)
       SELECT page_id, nullif({strip_sql('t')}, '') AS issue, CAST(NULL AS VARCHAR) AS summary,
              nullif({strip_sql('html')}, '') AS contents
       FROM q""",
)
def src_xml_detail(spark, folder):
    title = F.regexp_replace(F.regexp_extract("html", "<title>(.+?)</title>", 1), "[&<>]", " ")
    payload = F.concat(
        F.lit("<case><issue>"), title, F.lit("</issue><summary></summary><contents>"),
        F.replace(F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")),
        F.lit("</contents></case>"),
    )
    pages = table(spark, folder, "pages").select("page_id", payload.alias("payload"))
    return files.xml_detail(pages, "payload", {"issue": "issue", "summary": "summary", "contents": "contents"})


@query("src_word_list", r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM benchmark")
def src_word_list(spark, folder):
    """Words with repeats, blanks and carriage returns are written as lines, then scanned."""
    words = table(spark, folder, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    path = stage_path(spark, "words")
    files.write_lines(words.select(F.concat(F.lit(" "), "word", F.lit(" \r"))), path)
    return files.read_word_list(spark, path)


# ---------------------------------------------------------------- rows


@query(
    "clean_table",
    """WITH o AS (SELECT *, CAST(strftime(o_orderdate, '%Y%m%d') AS DOUBLE) AS date FROM orders),
            f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM o
                  WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND date IS NOT NULL)
       SELECT o_orderkey, o_custkey, date FROM f WHERE r = 1 AND date > 19960101.0""",
)
def clean_table(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").cast("double").alias("date")
    )
    return tables.clean_table(orders, "o_custkey", "date", 19960101.0, "o_orderkey")


@query(
    "dedupe_keep_first",
    """WITH f AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
       SELECT doc_id, lang, n_chars FROM f WHERE r = 1""",
)
def dedupe_keep_first(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    return tables.keep_first(docs, ["text"], [F.asc("doc_id")]).drop("text")


REFERENCE = "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority || ' ' || strftime(o_orderdate, '%Y') ELSE o_orderpriority END"


@query(
    "year_window",
    f"""WITH r AS (SELECT o_orderkey, {REFERENCE} AS reference FROM orders),
             y AS (SELECT o_orderkey, reference, TRY_CAST(right(reference, 4) AS INTEGER) AS year FROM r)
        SELECT o_orderkey, reference, year FROM y WHERE year BETWEEN 1996 AND 1998""",
)
def year_window(spark, folder):
    dated = F.concat(F.col("o_orderpriority"), F.lit(" "), F.date_format("o_orderdate", "yyyy"))
    reference = F.when(F.col("o_orderstatus") != "P", dated).otherwise(F.col("o_orderpriority"))
    orders = table(spark, folder, "orders").select("o_orderkey", reference.alias("reference"))
    return tables.year_window(orders, "reference", 1996, 1998)


@query(
    "preview_count",
    """SELECT doc_id, lang, source, (SELECT count(*) FROM documents) AS total_rows
       FROM documents ORDER BY doc_id LIMIT 5""",
)
def preview_count(spark, folder):
    return tables.preview(table(spark, folder, "documents").select("doc_id", "lang", "source"), [F.asc("doc_id")])


@query(
    "preview_last",
    """SELECT doc_id, lang, source, (SELECT count(*) FROM documents) AS total_rows
       FROM documents ORDER BY doc_id DESC LIMIT 5""",
)
def preview_last(spark, folder):
    return tables.preview(table(spark, folder, "documents").select("doc_id", "lang", "source"), [F.desc("doc_id")])


@query(
    "string_row_ids",
    """WITH k AS (SELECT doc_id, md5(source || '-' || doc_id) AS case_id FROM documents)
       SELECT doc_id, case_id, row_number() OVER (ORDER BY case_id) - 1 AS id FROM k""",
)
def string_row_ids(spark, folder):
    """A number for every string key, in key order, as the vector operators take it."""
    docs = table(spark, folder, "documents").select("doc_id", F.md5(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))).alias("case_id"))
    return ordered_index(docs, [F.asc("case_id")], "id", "numbered")


# ---------------------------------------------------------------- text functions


@query("link_rewrite", "SELECT page_id, 'mirror:' || replace(url, 'http', 'xml') AS link FROM pages")
def link_rewrite(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.extend_link(F.col("url"), "mirror:", "http", "xml").alias("link"))


@query(
    "sentence_split",
    f"""WITH s AS (SELECT doc_id, string_split(text, '.') AS parts FROM documents),
             n AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, {strip_sql('parts[i]')} || '.' AS sentence FROM n""",
)
def sentence_split(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query("clean_a", f"SELECT page_id, {clean_corpus_sql('html')} AS cleaned FROM pages")
def clean_a(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html")
    return pages.select("page_id", T.clean_corpus(F.col("html")).alias("cleaned"))


@query(
    "clean_b",
    f"""SELECT doc_id, {clean_record_sql('text', V.RECORD_KEEP)} AS cleaned,
               {clean_record_sql('text', LATIN_KEEP)} AS cleaned_latin FROM documents""",
)
def clean_b(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        T.clean_sentence(F.col("text")).alias("cleaned"),
        T.clean_sentence(F.col("text"), keep=LATIN_KEEP).alias("cleaned_latin"),
    )


ACCENTS = dict(zip("éèêàáíóúñçäöüÉÈ", "eeeaaiouncaouEE"))


@query(
    "char_substitute",
    f"SELECT doc_id, translate(text, {sql_text(''.join(ACCENTS))}, {sql_text(''.join(ACCENTS.values()))}) AS plain FROM documents",
)
def char_substitute(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.substitute_chars(F.col("text"), ACCENTS).alias("plain"))


HEAD_RULES = (("<h9>(.+?)</h9>", "", 0), ("<h1>(.+?)</h1>", " |", 0), ("<title>(.+?)</title>", "", 0))
TAIL_RULES = (("<footer>(.+?)</footer>", "", 8), ("<p>(.+?)</p>", "", 0))


def section_sql(text: str, rules) -> str:
    parts = []
    for pattern, suffix, cut in rules:
        one = f"nullif(regexp_extract({text}, {sql_text(pattern)}, 1), '')"
        if suffix:
            one = f"({one} || {sql_text(suffix)})"
        if cut:
            one = f"left({one}, greatest(length({one}) - {cut}, 0))"
        parts.append(one)
    return strip_sql(f"coalesce({', '.join(parts)})")


@query(
    "section_extract",
    f"SELECT page_id, {section_sql('html', HEAD_RULES)} AS head, {section_sql('html', TAIL_RULES)} AS tail FROM pages",
)
def section_extract(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        T.first_section(F.col("html"), HEAD_RULES).alias("head"),
        T.first_section(F.col("html"), TAIL_RULES).alias("tail"),
    )


@query(
    "section_concat",
    """SELECT page_id, nullif(coalesce(nullif(regexp_extract(html, '<title>(.+?)</title>', 1), ''), '')
              || coalesce(nullif(regexp_extract(html, '<div class="ad">(.+?)</div>', 1), ''), ''), '') AS joined FROM pages""",
)
def section_concat(spark, folder):
    patterns = ("<title>(.+?)</title>", '<div class="ad">(.+?)</div>')
    return table(spark, folder, "pages").select("page_id", T.joined_sections(F.col("html"), patterns).alias("joined"))
