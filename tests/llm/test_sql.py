"""Queries of this subpackage that SQL can express, against DuckDB on two sizes of the tables."""

import duckdb
import pytest

from sieveworks.llm import queries


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name, scale):
    folder = sf_dir.replace("sf0.001", scale)
    con = duckdb.connect()
    for table in ("conversations", "pages"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    assert sorted(d[0] for d in con.execute(queries.ORACLES[name]).description) == columns
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=str) == sorted(want, key=str)
