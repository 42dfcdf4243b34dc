"""Every query against its SQL, on the smallest driver tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from methgrid.plans import file_queries, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def rounded(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.datetime) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted(rounded(r[c] for c in columns) for r in df.collect()) == sorted(rounded(r[k] for k in places) for r in want.fetchall())


def test_entry(spark):
    assert "name" in entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
