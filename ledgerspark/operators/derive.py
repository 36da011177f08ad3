"""Derived totals, accounting identities, and reports on quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lake import by_keys

PERIOD = ["filing_id", "start_date", "end_date", "kind", "unit"]
TOLERANCE = 0.001

#: Each total: the code, and the signed codes that give it, the first way that is complete.
RULES = (
    ("total_assets", (("current_assets", 1), ("noncurrent_assets", 1))),
    ("total_liabilities", (("total_assets", 1), ("total_equity", -1))),
    ("total_liabilities", (("current_liabilities", 1), ("noncurrent_liabilities", 1))),
)

#: Totals of printed sheets that state both halves only.
HALVES = (RULES[0], RULES[2])

#: The third term of assets = liabilities + equity from the other two.
THIRD_TERM = (
    ("total_assets", (("total_liabilities", 1), ("total_equity", 1))),
    ("total_liabilities", (("total_assets", 1), ("total_equity", -1))),
    ("total_equity", (("total_assets", 1), ("total_liabilities", -1))),
)


def derive_totals(facts: DataFrame, rules: Sequence = RULES) -> DataFrame:
    """facts with the totals that are missing and that one period and unit gives.

    One shuffle: the period's values become columns, the rules expressions over
    them. A derived value has the least confidence and precision of its terms,
    and the codes that it really comes from.
    """
    return facts.unionByName(_derived(facts, rules), allowMissingColumns=True)


def derive_printed_totals(facts: DataFrame) -> DataFrame:
    """facts of printed sheets with the totals that a filing never states: first from both halves, then
    the third of assets, liabilities and equity where it states, or has by then, exactly two."""
    stated = lambda df: df.where(F.coalesce(F.size("dimensions"), F.lit(0)) <= 0).select("filing_id", "code").distinct()
    out = facts.unionByName(_derived(facts, HALVES).join(by_keys(stated(facts)), ["filing_id", "code"], "left_anti"), allowMissingColumns=True)
    known = stated(out)
    two = known.where(F.col("code").isin([code for code, _ in THIRD_TERM])).groupBy("filing_id").agg(F.count("*").alias("n")).where("n = 2").select("filing_id")
    third = _derived(out.join(by_keys(two), "filing_id", "left_semi"), THIRD_TERM).join(by_keys(known), ["filing_id", "code"], "left_anti")
    return out.unionByName(third, allowMissingColumns=True)


def derive_chart_totals(facts: DataFrame) -> DataFrame:
    """facts of a chart of accounts that has no line of all liabilities, with their sum where a filing
    states both halves and nowhere the total."""
    stated = facts.select("filing_id", "code").distinct()
    return facts.unionByName(_derived(facts, (RULES[2],)).join(by_keys(stated), ["filing_id", "code"], "left_anti"), allowMissingColumns=True)


def _derived(facts: DataFrame, rules: Sequence) -> DataFrame:
    codes = sorted({c for code, terms in rules for c in (code, *(t for t, _ in terms))})
    plain = facts.where(F.coalesce(F.size("dimensions"), F.lit(0)) <= 0)
    value = lambda c, col: F.max(F.when(F.col("code") == c, F.col(col)))
    wide = plain.where(F.col("code").isin(codes)).groupBy(*PERIOD).agg(*[value(c, "value").alias(c) for c in codes], *[value(c, "confidence").alias(f"{c}__confidence") for c in codes])
    state = {c: F.col(c) for c in codes}
    sure = {c: F.col(f"{c}__confidence") for c in codes}
    new: dict[str, tuple] = {}
    for code, terms in rules:
        total = None
        for term, sign in terms:
            part = state[term] if sign > 0 else -state[term]
            total = part if total is None else total + part
        total = total.cast("decimal(38,10)")
        missing = state[code].isNull() & total.isNotNull()
        before = new.get(code, (F.lit(None).cast("decimal(38,10)"), F.lit(None).cast("array<string>"), F.lit(None).cast("int")))
        least = F.least(*[sure[t] for t, _ in terms])
        new[code] = (F.when(missing, total).otherwise(before[0]), F.when(missing, F.array(*[F.lit(t) for t, _ in terms])).otherwise(before[1]), F.when(missing, least).otherwise(before[2]))
        state[code], sure[code] = F.coalesce(state[code], total), F.coalesce(sure[code], least)
    rows = wide.select(*PERIOD, F.explode(F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value"), d.alias("derived_from"), s.alias("confidence")) for c, (v, d, s) in new.items()])).alias("d"))
    found = rows.where("d.value is not null").select(*PERIOD, "d.code", F.lit("derived").alias("provenance"), "d.value", "d.derived_from", "d.confidence")
    return found


def audit(facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Identities of each balance sheet: rule, left, right, status held, gap or not_applicable.

    The rules and the tolerance are this engine's own. A derived value is never
    audited: that would compare a number with itself.
    """
    own = facts.where((F.col("provenance") != "derived") & (F.coalesce(F.size("dimensions"), F.lit(0)) <= 0))
    value = lambda c: F.max(F.when(F.col("code") == c, F.col("value"))).cast("double")
    wide = own.groupBy("filing_id", "end_date").agg(*[value(c).alias(c) for c in ("total_assets", "total_liabilities", "total_equity", "current_assets", "noncurrent_assets", "current_liabilities", "noncurrent_liabilities")])
    rules = (
        ("EQ.accounting_equation", F.col("total_assets"), F.col("total_liabilities") + F.col("total_equity")),
        ("FOOT.bs.total_assets", F.col("total_assets"), F.col("current_assets") + F.col("noncurrent_assets")),
        ("FOOT.bs.total_liabilities", F.col("total_liabilities"), F.col("current_liabilities") + F.col("noncurrent_liabilities")),
    )
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), a.alias("left"), b.alias("right")) for n, a, b in rules])
    rows = wide.select("filing_id", "end_date", F.explode(cells).alias("r")).select("filing_id", "end_date", "r.*")
    held = F.abs(F.col("left") - F.col("right")) <= tolerance * F.abs(F.col("left"))
    return rows.withColumn("status", F.when(F.col("left").isNull() | F.col("right").isNull(), "not_applicable").when(held, "held").otherwise("gap"))


def smoke_identity(facts: DataFrame) -> DataFrame:
    """The accounting equation of each filing's newest period that has all three totals."""
    audited = audit(facts).where(F.col("rule") == "EQ.accounting_equation")
    ready = audited.where(F.col("status") != "not_applicable")
    newest = ready.withColumn("__n", F.row_number().over(Window.partitionBy("filing_id").orderBy(F.col("end_date").desc()))).where("__n = 1").drop("__n")
    none = audited.select("filing_id").distinct().join(newest, "filing_id", "left_anti")
    return newest.unionByName(none.withColumn("status", F.lit("not_applicable")), allowMissingColumns=True)


def provenance_histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy("provenance").agg(F.count("*").alias("n"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def statement_currency(facts: DataFrame) -> DataFrame:
    """The most frequent three-letter unit of each statement, per-share items left out; the first seen of equals."""
    unit = F.upper(F.regexp_extract("unit", r"^(?:iso4217:)?([A-Za-z]{3})\b", 1))
    counted = facts.where(~F.col("code").isin("basic_eps", "diluted_eps")).withColumn("currency", unit).where("currency <> ''").groupBy("filing_id", "statement_type", "currency").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("filing_id", "statement_type").orderBy(F.col("n").desc(), F.col("first").asc()))
    return counted.withColumn("__r", rank).where("__r = 1").select("filing_id", "statement_type", "currency")


def check_reference(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected rows that the facts do not have exactly."""
    columns = expected.columns
    return expected.exceptAll(facts.select(*columns).join(expected, columns, "left_semi").distinct())
