"""Keyed state, sources that fail, audit rules, concept choice and the dispatcher of feeds."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import derive, rules, windows
from ledgerspark.operators.versions import VersionedTable
from ledgerspark.operators.windows import FACT_KEY, fact_history
from ledgerspark.sources import dispatch
from ledgerspark.sources.gather import gather
from ledgerspark.streaming import latest

DDL = "filing_id string, company_id string, reported_at date, statement_type string, code string, start_date date, end_date date, kind string, dimensions array<struct<axis:string,member:string>>, value decimal(38,10), unit string, seq int"
D = dt.date


def some_facts(seed, n):
    r = random.Random(seed)
    for i in range(n):
        yield (f"f{r.randint(1, 9)}", f"c{r.randint(1, 4)}", r.choice([D(2024, 1, 1), D(2024, 6, 1), D(2023, 1, 1), None]), "s", r.choice("xy"), None, D(2023, 12, 31), "instant", r.choice([None, [("a", "m")]]), r.choice([None, Decimal(i)]), None, r.randint(1, 50) * 1000 + i)


def listed(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_latest_state(spark, tmp_path):
    """Equals the batch form at every point, with late and repeated rows, and rewrites only what changed."""
    table = VersionedTable(spark, str(tmp_path / "t"), FACT_KEY, parts=8)
    seen = []
    for number in range(2):
        rows = list(some_facts(number, 60)) + (seen[:20] if number else [])
        seen += rows
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = table.manifest()
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
        latest.keep_latest_rows(stream, table, str(tmp_path / "ck")).awaitTermination(180)
        assert listed(table.read()) == listed(fact_history(spark.createDataFrame(seen, DDL).dropDuplicates(["seq", "filing_id", "company_id"]), "latest_restated").select(table.read().columns))
        assert before is None or table.manifest().version == before.version + 1
    # Only older and repeated rows: the state hands nothing on, and no part is written.
    old = [(*r[:2], D(2001, 1, 1), *r[3:]) for r in seen[:30]]
    spark.createDataFrame(old + seen[:30], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = table.manifest()
    latest.keep_latest_rows(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), table, str(tmp_path / "ck")).awaitTermination(180)
    assert table.manifest().partitions == before.partitions


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), FACT_KEY, parts=2)
    spark.createDataFrame(list(some_facts(1, 20)), DDL).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # a new checkpoint: batch 0 comes again
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
        latest.keep_latest_rows(stream, table, str(tmp_path / checkpoint)).awaitTermination(120)
    assert table.versions() == [1]


class Handle:
    """What a processor asks of the engine, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter([(t,) for t in self.timers])

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_a_processor_forgets_and_breaks_ties():
    import pandas as pd
    from pyspark.sql.types import StructType

    handle, schema = Handle(), StructType.fromDDL("filing_id string, reported_at date, value int, seq int")
    own = latest.Latest(schema, ["seq"], forget_after_ms=500)
    own.init(handle)
    put = lambda *rows: [tuple(f.iloc[0]) for f in own.handleInputRows(("k",), iter([pd.DataFrame(list(rows), columns=schema.names)]), handle)]
    assert put(("a", D(2024, 1, 1), 1, 5), ("a", D(2024, 1, 1), 2, 4)) == [("a", D(2024, 1, 1), 2, 4)]
    assert put(("a", D(2024, 1, 1), 3, 4), ("b", None, 9, 1), ("z", D(2023, 1, 1), 9, 1)) == []
    assert put(("b", D(2024, 1, 1), None, 9))[0][0] == "b" and handle.timers == [1500]
    assert list(own.handleExpiredTimer(("k",), handle, None)) == [] and not handle.exists()
    assert put(("z", D(2023, 1, 1), 9, 1))[0][0] == "z"


def test_gather(spark):
    good, other = spark.range(5).withColumn("a", F.lit("x")), spark.createDataFrame([(9, 1.5)], "id long, b double")

    def refuses():
        raise ConnectionError("the feed is down\nmore")

    late = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id")).alias("id"))
    rows, status = gather(spark, {"good": lambda: good, "down": refuses, "late": lambda: late, "other": lambda: other})
    told = {r["source"]: (r["source_pos"], r["status"], r["n_rows"]) for r in status.collect()}
    assert told == {"good": (0, "ok", 5), "down": (1, "failed", 0), "late": (2, "failed", 0), "other": (3, "ok", 1)}
    errors = {r["source"]: r["error"] for r in status.collect()}
    assert errors["down"] == "ConnectionError: the feed is down" and errors["late"] and errors["good"] is None
    assert sorted(map(tuple, rows.select("id", "a", "b", "source_pos").collect())) == [(i, "x", None, 0) for i in range(5)] + [(9, None, 1.5, 3)]
    assert gather(spark, {"down": refuses})[0] is None


FACTS = "filing_id string, code string, end_date date, value decimal(38,10), start_date date, provenance string, dimensions array<struct<axis:string,member:string>>"


def facts_of(spark, **cells):
    day = {"0": D(2022, 12, 31), "1": D(2023, 12, 31)}
    return spark.createDataFrame([("f", k.rstrip("01"), day.get(k[-1], D(2023, 12, 31)), Decimal(v), None, "tagged_xbrl", None) for k, v in cells.items() if v is not None], FACTS)


def status(checked):
    return {(r["rule_id"], r["end_date"].year): r["status"] for r in checked.collect()}


def test_rules(spark):
    rows = facts_of(spark, total_assets=100, total_liabilities=60, total_equity=40, current_assets=30, noncurrent_assets=71, cash_and_cash_equivalents0=5, cash_and_cash_equivalents1=9, net_change_in_cash1=4, revenue=50, cost_of_revenue=-20, gross_profit=30)
    found = status(rules.check(rows, rules.FULL_RULES))
    assert found["EQ.accounting_equation", 2023] == "pass" and found["FOOT.bs.total_assets", 2023] == "fail" and found["FOOT.bs.total_liabilities", 2023] == "skip"
    assert found["ROLL.cash", 2023] == "pass" and found["ROLL.cash", 2022] == "skip" and found["FOOT.is.gross_profit", 2023] == "pass"
    assert len(found) == 2 * len(rules.FULL_RULES)
    (report,) = rules.report(rules.check(rows)).collect()
    assert (report["ok"], report["checks_passed"], report["checks_failed"], report["checks_skipped"]) == (False, 1, 1, 1)
    (finding,) = report["findings"]
    assert (finding["rule_id"], finding["expected"], finding["actual"], finding["difference"]) == ("FOOT.bs.total_assets", 101.0, 100.0, -1.0)


def test_tolerances_optional_and_table(spark):
    rows = facts_of(spark, total_assets=1000, current_assets=600, noncurrent_assets=399)
    one = lambda **o: rules._rule("r", "d", "+total_assets", "+current_assets +noncurrent_assets", **o)
    got = lambda rule: status(rules.check(rows, [rule]))["r", 2023]
    assert got(one()) == "pass" and got(one(relative=0.0009)) == "fail" and got(one(relative=0, absolute=1)) == "pass"
    assert status(rules.check(rows, [rules._rule("r", "d", "+total_assets", "+current_assets +goodwill")])) == {("r", 2023): "skip"}
    assert status(rules.check(rows, [rules._rule("r", "d", "+total_assets", "+current_assets +goodwill", optional=("goodwill",))])) == {("r", 2023): "fail"}
    back = {r.id: r for r in rules.rules_from(rules.rules_table(spark, rules.FULL_RULES))}
    assert {i: (set(r.left), set(r.right), r.relative) for i, r in back.items()} == {r.id: (set(r.left), set(r.right), r.relative) for r in rules.FULL_RULES}


def test_what_is_not_audited(spark):
    rows = facts_of(spark, total_assets=100, current_assets=30, noncurrent_assets=70)
    segment = rows.where("code = 'total_assets'").withColumns({"value": F.lit(5).cast("decimal(38,10)"), "dimensions": F.expr("array(named_struct('axis', 'a', 'member', 'm'))")})
    derived = rows.where("code = 'total_assets'").withColumns({"value": F.lit(900).cast("decimal(38,10)"), "provenance": F.lit("derived")})
    assert status(rules.check(rows.unionAll(segment).unionAll(derived)))["FOOT.bs.total_assets", 2023] == "pass"
    # A quarter ends on the year's last day: the year counts.
    flows = spark.createDataFrame([("f", c, D(2023, 12, 31), Decimal(v), s, "tagged_xbrl", None) for c, v, s in [("gross_profit", 10, D(2023, 1, 1)), ("gross_profit", 99, D(2023, 10, 1)), ("revenue", 30, D(2023, 1, 1)), ("cost_of_revenue", 20, D(2023, 1, 1))]], FACTS)
    assert status(rules.check(flows, rules.FULL_RULES))["FOOT.is.gross_profit", 2023] == "pass"
    assert rules.check(rows.limit(0)).count() == 0


def test_chart_totals(spark):
    ddl = "filing_id string, code string, value decimal(38,10), confidence int, start_date date, end_date date, kind string, unit string, provenance string, dimensions array<struct<axis:string,member:string>>"
    row = lambda f, c, v, e=D(2023, 12, 31): (f, c, Decimal(v), 95, None, e, "instant", "BRL", "regulated_structured_data", None)
    rows = spark.createDataFrame([row("a", "current_liabilities", 3), row("a", "noncurrent_liabilities", 4), row("a", "current_liabilities", 9, D(2022, 12, 31)), row("b", "current_liabilities", 3), row("b", "noncurrent_liabilities", 4), row("b", "total_liabilities", 8, D(2020, 12, 31)), row("c", "total_assets", 1), row("c", "total_equity", 1)], ddl)
    new = derive.derive_chart_totals(rows).where("provenance = 'derived'").collect()
    assert [(r["filing_id"], r["code"], r["value"], r["end_date"], r["derived_from"]) for r in new] == [("a", "total_liabilities", 7, D(2023, 12, 31), ["current_liabilities", "noncurrent_liabilities"])]


def test_best_concepts_in_one_shuffle(spark):
    r = random.Random(5)
    rows = [(f"f{r.randint(1, 3)}", "s", r.choice("ab"), f"k{r.randint(1, 4)}", r.choice([None, [], [("x", "y")]]), None, D(2020 + r.randint(0, 2), 1, 1), i, r.randint(0, 3), r.randint(0, 1)) for i in range(300)]
    facts = spark.createDataFrame(rows, "filing_id string, statement_type string, code string, concept string, dimensions array<struct<axis:string,member:string>>, start_date date, end_date date, seq int, alias_rank int, standard int")
    groups = {}
    for x in rows:
        groups.setdefault((x[0], x[2]), {}).setdefault(x[3], []).append(x)
    want = set()
    for concepts in groups.values():
        best = min(concepts.values(), key=lambda own: (-sum(x[4] == [] for x in own), -len({(x[5], x[6]) for x in own}), -max(x[9] for x in own), -len(own), min(x[8] for x in own), min(x[7] for x in own)))
        want |= {x[7] for x in best}
    got = windows.best_concepts(facts)
    assert {x["seq"] for x in got.collect()} == want and got.columns == facts.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("== Initial Plan")].count("Exchange hashpartitioning") == 1 and plan[: plan.find("== Initial Plan")].count("+- *(2) Sort") <= 1


def test_feeds_before_documents(spark):
    with pytest.raises(ValueError):
        dispatch.financials(spark.createDataFrame([], "filing_id string"), {"nobody": spark.range(1)})
