"""Every registered query against its SQL in DuckDB on whole tables."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


def canonical(table, columns):
    rows = table.select(columns).to_pylist()
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in r.values()) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*columns).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    want = duck.sql(sql).arrow()
    want = want if isinstance(want, pa.Table) else want.read_all()
    assert sorted(want.column_names) == columns
    assert canonical(got, columns) == canonical(want, columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_ranked_hits(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score", "topic", "keywords", "lang", "source"]
    assert df.count() > 0
