"""Scans of landed archives that read no more than they must: ranges of days, and years from the newest on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that a range may have at most.
MOST_DAYS = 3_660


def day_range(start: dt.date | None, end: dt.date, lookback_days: int = 120) -> tuple[dt.date, dt.date]:
    """Both ends of a range that ends on a day and begins on another, or so many days before."""
    start = start or end - dt.timedelta(days=max(1, lookback_days) - 1)
    if start > end:
        raise ValueError("a range must not begin after its end")
    if (end - start).days > MOST_DAYS:
        raise ValueError(f"a range has {MOST_DAYS} days at most")
    return start, end


def wanted_days(requests: DataFrame, lookback_days: int = 120) -> DataFrame:
    """requests (start, end; start may be null) with a row for each day; ranges that begin after their end
    or are too long give none (see refused)."""
    start = F.coalesce("start", F.date_sub("end", max(1, lookback_days) - 1))
    return requests.withColumn("start", start).where(_valid()).withColumn("day", F.explode(F.sequence("start", "end")))


def refused(requests: DataFrame) -> DataFrame:
    """requests whose range gives no days, with the reason."""
    reason = F.when(F.col("end").isNull(), "a range must have an end").when(F.col("start") > F.col("end"), "a range must not begin after its end").when(F.datediff("end", "start") > MOST_DAYS, f"a range has {MOST_DAYS} days at most")
    return requests.withColumn("reason", reason).where("reason is not null")


def _valid() -> Column:
    return (F.col("start") <= F.col("end")) & (F.datediff("end", "start") <= MOST_DAYS)


def scan_days(landing: DataFrame, days: DataFrame, on: tuple[str, ...] = ("day",), most: int = 1_000_000) -> DataFrame:
    """The landing's rows of the wanted days (and of what else is named in on).

    landing is partitioned by day. The wanted days are broadcast while there are
    no more of them than most, and Spark then opens only their partitions, however
    they were computed; with more, both sides meet in a shuffle.
    """
    keys = days.select(*on).distinct()
    few = keys.limit(most + 1).count() <= most
    return landing.join(F.broadcast(keys) if few else keys, list(on), "left_semi")


def newest_first(parts: Iterable, read: Callable[[object], DataFrame], key: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows by order, one for each key, of parts that are given from the newest on.

    Parts are read one after another until the limit is met; older ones are not
    opened. That gives what reading all would give if no part has a row that sorts before one of
    a newer part. Of a key in several parts the row of the oldest that was read stays.
    """
    limit, found, place = max(1, limit), [], 0
    for place, part in enumerate(parts):
        found.append(read(part).withColumn("__part", F.lit(place)))
        keys = reduce(DataFrame.unionAll, [df.select(key) for df in found])
        if keys.distinct().limit(limit).count() >= limit:
            break
    if not found:
        raise ValueError("there is no part to read")
    rows = reduce(DataFrame.unionByName, found)
    columns = [c for c in rows.columns if c != "__part"]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "__part").alias("r")).select("r.*")
    return last.orderBy(*order).limit(limit)
