"""Audit rules as a table, compiled to one aggregate over the facts.

A rule says that two signed sums of items agree within a tolerance. All rules
are checked on a row for each filing and period, which one shuffle makes,
however many rules there are. Earlier periods of the same filing are columns of
that row's window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """left and right: items with their signs; `code@-1` is the item one period before.

    Holds if the sums differ by no more than absolute, or relative times the larger one. A rule of which an item is
    missing is skipped; with optional items, a missing one of these is zero.
    """

    id: str
    description: str
    left: tuple[tuple[str, int], ...]
    right: tuple[tuple[str, int], ...]
    absolute: float = 0.0
    relative: float = 0.001
    optional: tuple[str, ...] = ()


def _rule(id: str, description: str, left: str, right: str, **options) -> Rule:
    """A rule from text: items with + or - before them."""
    terms = lambda text: tuple((w[1:], -1 if w[0] == "-" else 1) for w in text.split())
    return Rule(id, description, terms(left), terms(right), **options)


#: What every balance sheet must meet. Subtotals only: a part of a section would not foot.
BALANCE_RULES = (
    _rule("EQ.accounting_equation", "total assets equal total liabilities and equity", "+total_assets", "+total_liabilities +total_equity"),
    _rule("FOOT.bs.total_assets", "current and noncurrent assets foot to total assets", "+total_assets", "+current_assets +noncurrent_assets"),
    _rule("FOOT.bs.total_liabilities", "current and noncurrent liabilities foot to total liabilities", "+total_liabilities", "+current_liabilities +noncurrent_liabilities"),
)

#: Rules that need statements with all their lines; on headline figures alone they would accuse sound filings.
FULL_RULES = (
    *BALANCE_RULES,
    _rule("FOOT.is.gross_profit", "revenue less its cost is gross profit", "+gross_profit", "+revenue -cost_of_revenue"),
    _rule("FOOT.is.net_income", "profit before tax less tax is net income", "+net_income_loss", "+profit_before_tax -income_tax"),
    _rule("FOOT.cf.net_change", "cash flows foot to the change in cash", "+net_change_in_cash", "+operating_cash_flow +investing_cash_flow +financing_cash_flow"),
    _rule("ROLL.cash", "cash moves by the change in cash", "+cash_and_cash_equivalents", "+cash_and_cash_equivalents@-1 +net_change_in_cash"),
)

#: Expenses that some sources print as negative numbers.
MAGNITUDES = ("cost_of_revenue",)


def rules_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """rule_id, description, side, item, sign, absolute, relative: the rules as rows."""
    rows = [(r.id, r.description, side, item, sign, r.absolute, r.relative, item in r.optional) for r in rules for side, terms in (("left", r.left), ("right", r.right)) for item, sign in terms]
    return spark.createDataFrame(rows, "rule_id string, description string, side string, item string, sign int, absolute double, relative double, optional boolean")


def rules_from(table: DataFrame) -> tuple[Rule, ...]:
    """The rules of such a table (some rows; they are read by the driver)."""
    found: dict[str, dict] = {}
    for r in table.orderBy("rule_id", "side", "item").collect():
        rule = found.setdefault(r["rule_id"], {"description": r["description"], "absolute": r["absolute"], "relative": r["relative"], "left": [], "right": [], "optional": []})
        rule[r["side"]].append((r["item"], r["sign"]))
        rule["optional"] += [r["item"]] if r["optional"] else []
    return tuple(Rule(i, x["description"], tuple(x["left"]), tuple(x["right"]), x["absolute"], x["relative"], tuple(x["optional"])) for i, x in found.items())


def check(facts: DataFrame, rules: Sequence[Rule] = BALANCE_RULES, magnitudes: Sequence[str] = MAGNITUDES) -> DataFrame:
    """filing_id, end_date, rule_id, description, expected, actual, difference, status (pass, fail or skip) of
    every rule and period. facts: filing_id, code, end_date, value, provenance, dimensions, start_date.

    Segments and derived values are not checked. Of several values of an item on one day the
    one of the longest period counts, of these the largest: quarters end when years do.
    """
    items = {item for r in rules for item, _ in (*r.left, *r.right)}
    codes = sorted({i.partition("@")[0] for i in items})
    own = facts.where((F.col("provenance") != "derived") & (F.coalesce(F.size("dimensions"), F.lit(0)) <= 0) & F.col("code").isin(codes) & F.col("value").isNotNull())
    value = F.when(F.col("code").isin(list(magnitudes)), F.abs("value")).otherwise(F.col("value")).cast("double")
    length = F.coalesce(F.datediff("end_date", "start_date"), F.lit(0))
    chosen = lambda c: F.max(F.when(F.col("code") == c, F.struct(length.alias("d"), value.alias("v"))))["v"].alias(c)
    wide = own.groupBy("filing_id", "end_date").agg(*[chosen(c) for c in codes])
    before = Window.partitionBy("filing_id").orderBy("end_date")
    wide = wide.withColumns({i: F.lag(i.partition("@")[0], -int(i.partition("@")[2])).over(before) for i in sorted(items) if "@" in i})

    def total(terms: Sequence[tuple[str, int]], optional: Sequence[str]) -> Column:
        out = F.lit(0.0)
        for item, sign in terms:
            cell = F.coalesce(F.col(f"`{item}`"), F.lit(0.0)) if item in optional else F.col(f"`{item}`")
            out = out + sign * cell
        return out

    cells = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.description).alias("description"), total(r.right, r.optional).alias("expected"), total(r.left, r.optional).alias("actual"), F.lit(r.absolute).alias("absolute"), F.lit(r.relative).alias("relative")) for r in rules])
    rows = wide.select("filing_id", "end_date", F.inline(cells)).withColumn("difference", F.col("actual") - F.col("expected"))
    within = F.abs("difference") <= F.greatest("absolute", F.col("relative") * F.greatest(F.abs("actual"), F.abs("expected")))
    return rows.withColumn("status", F.when(F.col("difference").isNull(), "skip").when(within, "pass").otherwise("fail")).drop("absolute", "relative")


def report(checked: DataFrame) -> DataFrame:
    """filing_id, ok, checks_passed, checks_failed, checks_skipped, findings (the failed ones, by period and rule)."""
    finding = F.struct("end_date", "rule_id", "description", "expected", "actual", "difference")
    return checked.groupBy("filing_id").agg(
        (F.count_if(F.col("status") == "fail") == 0).alias("ok"), F.count_if(F.col("status") == "pass").alias("checks_passed"), F.count_if(F.col("status") == "fail").alias("checks_failed"), F.count_if(F.col("status") == "skip").alias("checks_skipped"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "fail", finding))).alias("findings"),
    )
