"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from strataloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
