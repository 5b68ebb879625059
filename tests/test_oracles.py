"""Each registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from trisearch import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows):
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(show, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    sql = tables.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*columns).collect()) == plain(tables.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["file", "line_number", "line"]


def test_every_search_query_has_sql():
    assert queries.queries().keys() == queries.oracle_sql().keys()
