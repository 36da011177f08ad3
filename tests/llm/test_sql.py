"""Queries that SQL can express, against it."""

import duckdb
import pytest

from ledgerspark.llm.queries import SQL, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries()[name](spark, SF)
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert set(columns) <= set(df.columns)
    assert set(columns) == set(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, found.fetchall()))
