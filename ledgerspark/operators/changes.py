"""What changed between two filings, for many pairs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An item of a filing, and what is compared of it.
ITEM = ("statement_type", "code", "label")
VALUES = ("value", "unit", "provenance", "confidence")


def filing_changes(pairs: DataFrame, facts: DataFrame, limit: int = 100, values: Sequence[str] = VALUES, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The items of two filings whose values differ, numbered by statement, code and label.

    pairs: first_id, second_id. facts: filing_id, ITEM, values and order. Of several values of an item in one
    filing the last by order counts. first and second are null where a filing has no such item. change_no goes
    from 1 to limit; truncated: the pair has more changes than that. Pairs without changes give no rows.

    Both sides are summed up in one shuffle by pair and item, so a side's rows are not joined with the other's.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    pairs = pairs.select("first_id", "second_id").distinct()
    sides = F.array(F.struct(F.col("first_id").alias("filing_id"), F.lit(True).alias("__first")), F.struct(F.col("second_id").alias("filing_id"), F.lit(False).alias("__first")))
    rows = pairs.select("first_id", "second_id", F.inline(sides)).join(facts.select("filing_id", *ITEM, *values, *[c for c in order if c not in values and c not in ITEM]), "filing_id")
    place, found = F.struct(*order), F.struct(*values)
    both = rows.groupBy("first_id", "second_id", *ITEM).agg(
        F.max_by(found, F.when(F.col("__first"), place)).alias("first"),
        F.max_by(found, F.when(~F.col("__first"), place)).alias("second"),
    )
    changed = both.where(~F.col("first").eqNullSafe(F.col("second")))
    pair = Window.partitionBy("first_id", "second_id")
    numbered = changed.withColumn("change_no", F.row_number().over(pair.orderBy(*ITEM))).withColumn("truncated", F.count("*").over(pair) > limit)
    return numbered.where(F.col("change_no") <= limit)


def following(filings: DataFrame, keys: Sequence[str] = ("company_id",), order: Sequence[str] = ("filing_date", "id")) -> DataFrame:
    """first_id, second_id: each filing and the one of its group that comes next."""
    later = F.lead("id").over(Window.partitionBy(*keys).orderBy(*order))
    return filings.select(F.col("id").alias("first_id"), later.alias("second_id")).where("second_id is not null")
