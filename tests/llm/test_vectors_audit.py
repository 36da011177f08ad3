"""The audit of the vector graph: enough true links, and an exact way out."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import vectors

DDL = "vec_id long, embedding array<double>"


def planted(spark, n, pairs):
    r = random.Random(4)
    rows = [[r.gauss(0, 1) for _ in range(24)] for _ in range(n)]
    for i in range(pairs):
        rows[2 * i + 1] = [x + r.gauss(0, 0.02) for x in rows[2 * i]]
    return spark.createDataFrame(list(enumerate(rows)), DDL).repartition(4)


def nothing(nodes, *_):
    return nodes.sparkSession.createDataFrame([], "a long, b long")


def test_rare_links_and_exact_way_out(spark, monkeypatch):
    """A search that loses all links: 256 queries of 3,000 nodes would meet about none of 8 links."""
    monkeypatch.setattr(vectors, "_link", nothing)
    found = {r["vec_id"]: r for r in vectors.near_duplicates(planted(spark, 3000, 8)).collect()}
    assert all(found[i]["n_links"] == (i < 16) for i in range(3000))
    assert {r["recall"] for r in found.values()} == {1.0}


def test_exact_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_link", nothing)
    monkeypatch.setattr(vectors, "EXACT_NODES", 90)
    found = vectors.near_duplicates(planted(spark, 400, 150)).collect()
    assert all(r["n_links"] == (r["vec_id"] < 300) for r in found)


def test_too_few_links_are_compared_exactly(spark, monkeypatch):
    """No sample of 700 nodes has 100 true links, and nor have the nodes with links: nothing approximate is taken."""
    monkeypatch.setattr(vectors, "MOST_AUDIT_QUERIES", 256)
    monkeypatch.setattr(vectors, "_link", nothing)
    found = {r["vec_id"]: r for r in vectors.near_duplicates(planted(spark, 700, 2)).collect()}
    assert all(found[i]["n_links"] == (i < 4) for i in range(700))
    assert {r["recall"] for r in found.values()} == {1.0}


@pytest.mark.parametrize(("lost", "least"), [(0, 1.0), (1, 0.9)])
def test_rare_links_are_audited_where_they_are(spark, monkeypatch, lost, least):
    """Few of all nodes have links: those that have are asked; a link that they lost is seen, and mended."""
    monkeypatch.setattr(vectors, "AUDIT_QUERIES", 64)
    monkeypatch.setattr(vectors, "MOST_AUDIT_QUERIES", 64)
    monkeypatch.setattr(vectors, "AUDIT_LINKS", 40)
    link, asked = vectors._link, []

    def some(nodes, *rest):
        found = link(nodes, *rest)
        # Each node of the first ten pairs forgets a link that it has.
        return found.withColumn("links", F.when((F.col("a") < 60) & F.lit(bool(lost)), F.col("links") - 1).otherwise(F.col("links")))

    def recall(*args):
        asked.append(whole(*args))
        return asked[-1]

    whole = vectors.audit_recall
    monkeypatch.setattr(vectors, "_link", some)
    monkeypatch.setattr(vectors, "audit_recall", recall)
    r = random.Random(9)
    rows = [[r.gauss(0, 1) for _ in range(24)] for _ in range(3000)]
    for i in range(0, 120, 3):  # forty groups of three
        rows[i + 1], rows[i + 2] = ([x + r.gauss(0, 0.02) for x in rows[i]] for _ in range(2))
    df = spark.createDataFrame(list(enumerate(rows)), DDL).repartition(4)
    found = {x["vec_id"]: x for x in vectors.near_duplicates(df).collect()}
    assert all(found[i]["n_links"] == (2 if i < 120 else 0) for i in range(3000))
    assert all(a is not None for a in asked) and (asked[0] < least if lost else asked == [1.0])
