"""Every query with SQL is held against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strataloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    assert rows == sorted(str([plain(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())
