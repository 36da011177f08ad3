"""Streams give what their batch form gives, but for windows that are still open."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerspark.collections import Companies, Documents, Facts, Filings, Lake
from ledgerspark.streaming import streams

SF = "/root/testdata/sf0.001"


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def source(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet")
    df.write.parquet(f"{tmp_path}/events")
    return streams.events(streams.read_stream(spark, f"{tmp_path}/events", df.schema)), streams.events(df)


def test_windows(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    run(streams.windowed_counts(stream, "1 day"), "daily", "complete")
    want = {tuple(r) for r in streams.windowed_counts(batch, "1 day").select("window.start", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.sql("select window.start, event_type, n from daily").collect()} == want
    run(streams.bursts(stream, "30 minutes"), "bursts")
    got = {tuple(r) for r in spark.sql("select session_window.start, user_id, n from bursts").collect()}
    assert got and got <= {tuple(r) for r in streams.bursts(batch, "30 minutes").select("session_window.start", "user_id", "n").collect()}


def test_latest(spark, tmp_path):
    ddl = "filing_id string, company_id string, reported_at date, statement_type string, code string, start_date date, end_date date, kind string, value int, seq int"
    d = dt.date(2024, 1, 1)
    for i, (f, day, v) in enumerate([("a", d, 100), ("b", dt.date(2025, 1, 1), 110)]):
        spark.createDataFrame([(f, "c", day, "s", "x", None, d, "instant", v, 1)], ddl).write.mode("append").parquet(f"{tmp_path}/in")
        q = streams.keep_latest(streams.read_stream(spark, f"{tmp_path}/in", ddl), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(120)
        assert [r["value"] for r in spark.read.parquet(f"{tmp_path}/out/{i}").collect()] == [v]


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([("uk_lei_1", "Acme", "GB", "UK", ["s"])], "id string, name string, country_code string, market string, sources array<string>")
    c = Companies(df)
    assert len(c.search("ac")) == 1 and len(c.find("")) == 0 and c.one("acme").df.first()["id"] == "uk_lei_1" and len(c.filter(country_code="gb", source="s")) == 1
    d = dt.date(2024, 12, 31)
    facts = spark.createDataFrame([("f", "balance_sheet", "total_assets", d, 5, 1), ("f", "balance_sheet", "total_assets", d, 6, 2)], "filing_id string, statement_type string, code string, end_date date, value int, seq int")
    assert "| total_assets | 6 |" in Facts(facts).to_markdown(["2024-12-31"]).first()["markdown"]
    docs = spark.createDataFrame([("f", "# A\nrevenue")], "filing_id string, markdown string")
    docs.write.parquet(f"{tmp_path}/documents")
    assert Lake(spark, str(tmp_path)).documents.search("revenue").first()["title"] == "A"
    assert Documents(docs).quality().first()["status"] == "degraded"
    filings = spark.createDataFrame([("1", "uk_lei_1", "fca_nsm", d, None), ("2", "uk_lei_1", "fca_nsm", d, None)], "id string, company_id string, source string, filing_date date, published_at timestamp")
    assert Filings(filings).of_company("uk_lei_1").latest().df.first()["id"] == "2"
    assert Filings(filings).df.select(F.max("id")).first()[0] == "2"
