"""Holders: search over notices of major holdings and yearly positions, and each company's own list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import KINDS, fold
from .windows import filed_at, newest_filings, top_per_group

OUT = ("filing_id", "company_id", "holder_name", "position_date", "notified_date", "crossed_date")


def held_at() -> Column:
    """The day of a holding: that of the position, else of the notice, else of the crossing, else before all."""
    return F.coalesce("position_date", "notified_date", "crossed_date", F.lit("0001-01-01").cast("date"))


def _newest_first() -> list[Column]:
    return [held_at().desc(), F.col("filing_id").desc_nulls_last(), F.col("holder_name").desc_nulls_last()]


def _shape(rows: DataFrame) -> DataFrame:
    known = dict(rows.dtypes)
    return rows.select(*[F.col(c) if c in known else F.lit(None).cast("date").alias(c) for c in OUT])


def newest_years(positions: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Positions of the newest years, until a group of keys has limit holders of a filing; one row for each.

    A year is taken whole if the years after it give fewer than limit. A holder of a filing that several of the
    taken years name is shown as the oldest of them has it, within a year as its last row does. Only counts of
    years are brought together.
    """
    each = ["filing_id", "holder_key"]
    first = positions.groupBy(*keys, *each).agg(F.max("year").alias("year"))
    counts = first.groupBy(*keys, "year").agg(F.count("*").alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col("year").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = counts.withColumn("__newer", newer).where(F.col("__newer") < max(1, limit)).groupBy(*keys).agg(F.min("year").alias("__least"))
    taken = positions.join(least, list(keys)).where("year >= __least").drop("__least")
    return top_per_group(taken, [*keys, *each], [F.col("year").asc(), F.col("seq").desc(), F.col("position_date").desc_nulls_last()])


def search_holders(filings: DataFrame, notices: DataFrame, positions: DataFrame, name: str, scan_limit: int = 200, limit: int = 25) -> DataFrame:
    """Holders whose name contains the text, newest first, over both kinds of source.

    filings: notices of major holdings as filings; the scan_limit newest of them are looked at, whether their
    text could be read or not. notices: what was read of them (filing_id, holder_name, dates). positions:
    filing_id, company_id, holder_key, holder_name, position_date, year, seq; their years are read from the newest
    on until limit holders are found. Notices are matched without case and repeated spaces, positions without
    accents too. A null or blank name finds nothing; rows without a name are not found.
    """
    seen = filings.orderBy(filed_at().desc_nulls_last(), F.col("id").desc()).limit(max(0, scan_limit)).select(F.col("id").alias("filing_id"), "company_id")
    wanted, plain = KINDS["name"](name or ""), KINDS["search"](name or "")
    told = notices.drop("company_id").join(F.broadcast(seen), "filing_id").where(F.contains(fold(F.col("holder_name"), "name"), F.lit(wanted)))  # scan_limit rows at most
    held = positions.where(F.contains(fold(F.col("holder_name"), "search"), F.lit(plain))).withColumn("__all", F.lit(0))
    held = _shape(newest_years(held, ["__all"], limit)).orderBy(*_newest_first()).limit(max(1, limit))
    if not wanted or not plain:
        told, held = told.limit(0), held.limit(0)
    return _shape(told).unionByName(held).orderBy(*_newest_first()).limit(max(0, limit))


def company_holders(filings: DataFrame, notices: DataFrame, positions: DataFrame, limit: int = 25) -> DataFrame:
    """The newest holders of every company, at most limit each.

    A company with positions has those of its newest years; one with notices, what was read of its limit newest
    ones; the columns are those of search_holders. Companies are not looked up one by one: each step is a
    grouped window over all of them.
    """
    own = newest_filings(filings, limit).select(F.col("id").alias("filing_id"), "company_id")
    told = _shape(notices.drop("company_id").join(own, "filing_id"))
    held = top_per_group(_shape(newest_years(positions, ["company_id"], limit)), ["company_id"], _newest_first(), max(1, limit))
    return told.unionByName(held)
