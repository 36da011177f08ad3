"""Registered queries of the readers against their SQL."""

import pytest

from ledgerspark.plans import queries, readers

from .test_queries import SF, oracle, rows  # noqa: F401

NAMES = sorted(n for n, f in queries.QUERIES.items() if f.__module__ == readers.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_reader(spark, oracle, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    found = oracle.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns) and got
    want, have = rows(columns, found.fetchall()), rows(df.columns, got)
    assert have == want, (len(have), len(want), next(((a, b) for a, b in zip(have, want) if a != b), None))
