"""Connected components by alternating star contraction, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id that links reach) of every id in edges (a, b).

    Each round links the neighbours of a node to the least of them, first the
    larger ones, then the smaller ones; rounds grow with the logarithm of the
    longest path. Stars of a frequent node meet their least neighbour in a join
    that Spark can split. Every round ends in a table of the shared folder.
    Equal, reversed and self links are fine; links with nulls are left out.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    while True:
        large = _large_star(now)
        new = cut(_small_star(large), "edges")
        # Pairs only ever replace others, so equal counts and no new pair mean equal sets.
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        drop(now)
        now = new
        if same:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
