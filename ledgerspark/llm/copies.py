"""Rows with equal texts: found by 128 bits, before anything compares their insides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, texts

#: Bytes of a side up to which it is broadcast; a larger one meets the texts in a shuffle.
BROADCAST_BYTES = 8 << 20
_KEY_BYTES = 64
KEY = ["rk", "rk2"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and rk, rk2: 128 bits of hash of the text, by which equal texts are known."""
    return texts(docs).withColumns({"rk": F.xxhash64("text"), "rk2": F.xxhash64(F.lit(1), "text")})


def collapse(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, several). own: one row of each text, with its least doc_id. several: rk, rk2, n, least
    of the texts that stand in more than one row.

    Only texts that stand in several rows move, and of those one for each task.
    """
    several = cut(source.select("doc_id", *KEY).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "several")
    side = small(several.select(*KEY))
    one = source.join(side, KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    one = cut(one.select(*source.columns), "copies")
    return source.join(side, KEY, "left_anti").select(*source.columns).unionAll(one), several


def small(side: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if its counted rows are within BROADCAST_BYTES."""
    return F.broadcast(side) if side.count() * _KEY_BYTES <= BROADCAST_BYTES else side
