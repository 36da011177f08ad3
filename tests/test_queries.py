"""Every registered query against its SQL on the same tables."""

import os

import duckdb
import pytest

from ledgerspark.plans import mechanisms  # noqa: F401 (registers its queries)
from ledgerspark.plans.queries import QUERIES, SQL

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in SQL:
        found = oracle.execute(SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        want, have = rows(columns, found.fetchall()), rows(df.columns, got)
        assert len(want) == len(have)
        assert have == want, next((a, b) for a, b in zip(have, want) if a != b)
