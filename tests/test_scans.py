"""The source contract as a format, ranges of days and yearly archives: rows, and what is opened for them."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, Not

from ledgerspark.lake import folders
from ledgerspark.sources import contract, scans

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    for i, day in enumerate(DAYS):
        own = root / "edinet" / f"day={day}"
        os.makedirs(own)
        record = lambda k, code: {"docID": f"S{i}{k}", "edinetCode": code, "docTypeCode": "120", "docDescription": "t", "submitDateTime": f"{day} 15:00", "xbrlFlag": 1}
        (own / "a.json").write_text(json.dumps({"metadata": {"status": "200"}, "results": [record(0, "E00001"), record(1, "E00002")]}) + "\n")
        (own / "b.json").write_text(json.dumps(record(2, "E00001")) + "\n\n" + ("{broken\n" if i == 3 else "") + json.dumps([record(3, "E00003"), 7]))
        if i == 4:
            (own / "c.json").write_bytes(b"\xff\xfe")
        if i == 5:
            (own / "c.json").write_text(json.dumps({"metadata": {"status": "404"}, "results": []}))
        kap = root / "kap" / f"day={day}"
        os.makedirs(kap)
        (kap / "x.json").write_text(json.dumps([{"disclosureIndex": i, "companyOid": "AB", "kapTitle": "A", "subject": "s", "disclosureClass": "FR", "disclosureType": "FR", "publishDate": f"{day:%d.%m.%Y} 10:00:00"}]))
    return str(root)


def partitions(df):
    """Tasks of the scan: one for each folder that is opened."""
    return df.rdd.getNumPartitions()


def test_families(spark, root):
    rows = contract.read_feed(spark, root, "edinet")
    assert rows.where("error is null").count() == 40 and rows.count() == 43
    assert rows.where("day = '2024-01-03' and error is null").orderBy("seq").select("docID").collect() == [(f"S2{k}",) for k in range(4)]
    status = {r["day"]: (r["n_rows"], r["n_errors"], r["first_error"]) for r in contract.feed_status(spark, root, "edinet").collect()}
    assert status[DAYS[0]] == (4, 0, None) and status[DAYS[3]][:2] == (4, 1) and status[DAYS[4]][:2] == (4, 1) and status[DAYS[5]] == (4, 1, "the feed reports 404")
    assert contract.list_filings(spark, root, "kap").count() == 10
    assert contract.read_feed(spark, root + "/none", "kap").count() == 0


def test_listing(spark, root):
    own = contract.list_filings(spark, root, "edinet", company_id="JP_E00001", category="Accounts", start=DAYS[2], end=DAYS[7], limit=3)
    assert [r["id"] for r in own.collect()] == ["jp_edinet_S72", "jp_edinet_S70", "jp_edinet_S62"]
    assert contract.list_filings(spark, root, "edinet", company_id="tr_kap_AB").count() == 0
    assert contract.list_filings(spark, root, "kap", company_id="tr_kap_ab", limit=0).count() == 1


@pytest.mark.parametrize("where, n", [
    ("day = '2024-01-04'", 1), ("day >= '2024-01-04'", 7), ("day > '2024-01-04' and day < '2024-01-07'", 2), ("day in ('2024-01-01', '2024-01-09', '2030-01-01')", 2), ("docID = 'S10'", 10), ("day <= '2024-01-02' and docID = 'S10'", 2), ("day <> '2024-01-02'", 10), ("day < '2020-01-01'", 1),
])
def test_pushed_filters_cut_folders(spark, root, where, n):
    df = contract.read_feed(spark, root, "edinet").where(where)
    assert partitions(df) == n
    assert df.count() == contract.read_feed(spark, root, "edinet").persist().where(where).count()


def test_what_is_not_pushed_stays():
    reader = contract.FeedReader("/x", "edinet")
    filters = [EqualTo(("docID",), "S1"), Not(EqualTo(("day",), DAYS[1])), GreaterThan(("day",), DAYS[0]), LessThan(("day",), DAYS[5]), In(("day",), (DAYS[2], DAYS[9]))]
    assert list(reader.pushFilters(filters)) == filters[:2]
    assert (reader.least, reader.most, reader.days) == (DAYS[1], DAYS[4], {DAYS[2], DAYS[9]})


def test_day_range():
    assert scans.day_range(None, DAYS[9], 5) == (DAYS[5], DAYS[9])
    assert scans.day_range(None, DAYS[9], 0) == (DAYS[9], DAYS[9])
    for start in (DAYS[9] + dt.timedelta(days=1), DAYS[9] - dt.timedelta(days=3661)):
        with pytest.raises(ValueError):
            scans.day_range(start, DAYS[9])


def test_wanted_days(spark):
    requests = spark.createDataFrame([("a", DAYS[0], DAYS[2]), ("b", None, DAYS[5]), ("c", DAYS[3], DAYS[1]), ("d", DAYS[0], None), ("e", dt.date(2000, 1, 1), DAYS[1])], "who string, start date, end date")
    got = sorted((r["who"], r["day"]) for r in scans.wanted_days(requests, 3).collect())
    assert got == [("a", d) for d in DAYS[:3]] + [("b", d) for d in DAYS[3:6]]
    assert {r["who"]: r["reason"] for r in scans.refused(requests).collect()} == {"c": "a range must not begin after its end", "d": "a range must have an end", "e": "a range has 3660 days at most"}


def test_only_wanted_days_are_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select("id", F.date_add(F.lit(DAYS[0]), (F.col("id") % 100).cast("int")).alias("day"))
    rows.repartition("day").write.partitionBy("day").parquet(path)
    landing = spark.read.parquet(path)
    days = scans.wanted_days(spark.createDataFrame([(DAYS[1], DAYS[3]), (DAYS[3], DAYS[4])], "start date, end date"))
    found = scans.scan_days(landing, days)
    assert sorted(r["id"] for r in found.collect()) == sorted(i for i in range(1000) if 1 <= i % 100 <= 4)
    plan = found._jdf.queryExecution().executedPlan()
    assert files_read(plan) == 4 and "dynamicpruning" in plan.toString()
    many = scans.scan_days(landing, days, most=1)
    assert many.count() == found.count()


def files_read(node, of="numFiles"):
    """Files (or partitions) that the scans of a plan that ran have opened."""
    text, total = node.getClass().getSimpleName(), 0
    if text == "AdaptiveSparkPlanExec":
        return files_read(node.executedPlan(), of)
    if text.endswith("QueryStageExec"):
        return files_read(node.plan(), of)
    metric = node.metrics().get(of)
    if text == "FileSourceScanExec" and metric.isDefined():
        total += metric.get().value()
    children = node.children()
    return total + sum(files_read(children.apply(i), of) for i in range(children.size()))


def test_newest_first(spark, tmp_path):
    path = str(tmp_path / "y")
    spark.range(700).select("id", (2020 - F.floor(F.col("id") / 100)).cast("int").alias("year"), F.col("id").alias("age")).write.partitionBy("year").parquet(path)
    archive = spark.read.parquet(path)
    opened = []

    def read(year):
        opened.append(year)
        return archive.where(F.col("year") == year)

    years = [int(n[5:]) for n in reversed(folders(spark, path, "year="))]
    assert years == list(range(2020, 2013, -1))
    for limit, n in ((1, 1), (100, 1), (101, 2), (250, 3), (9999, 7), (0, 1)):
        opened.clear()
        got = [r["id"] for r in scans.newest_first(years, read, "id", [F.col("age")], limit).collect()]
        assert got == list(range(700))[: max(1, limit)] and len(opened) == n
    # A key in two parts counts once, and the older part's row stays.
    rows = {1: [(1, "new")], 2: [(1, "old"), (2, "old")]}
    two = scans.newest_first([1, 2], lambda p: spark.createDataFrame(rows[p], "id long, v string"), "id", [F.col("id")], 2)
    assert [tuple(r) for r in two.collect()] == [(1, "old"), (2, "old")]
    with pytest.raises(ValueError):
        scans.newest_first([], read, "id", [F.col("age")], 1)
