"""The label tables, scale words, and views that had no test."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import lineitems, numbers
from ledgerspark.functions.folds import KINDS
from ledgerspark.operators import documents, views


def test_label_tables(spark):
    printed = [(KINDS["label"](x), code) for code, names in lineitems.LABELS.items() for x in names]
    assert len(printed) == 257 and len({k for k, _ in printed}) == 257
    assert sum(map(len, lineitems.ACCOUNTS.values())) == 32 and set(lineitems.LABELS) | set(lineitems.ACCOUNTS) <= {c for c, *_ in lineitems.ITEMS}
    table = {r["label_key"]: (r["code"], r["statement_type"]) for r in lineitems.labels(spark).collect()}
    assert {k: v[0] for k, v in table.items()} == dict(printed) and table["goodwill"] == ("goodwill", "balance_sheet")
    # What the rules of sections and flows give.
    assert lineitems.LABELS["current_liabilities"] == ("current liabilities", "total current liabilities", "passivo circulante", "pasivos corrientes", "total pasivos corrientes", "pasivo corriente", "total pasivo corriente", "pasivo circulante", "total pasivo circulante", "total del pasivo circulante", "流動負債", "流动负债")
    assert lineitems.LABELS["operating_cash_flow"][:4] == ("net cash from operating activities", "net cash used in operating activities", "net cash generated from operating activities", "cash generated from operating activities")


@pytest.mark.parametrize("label, code", [("Activo Circulante", "current_assets"), ("TOTAL NON-CURRENT ASSETS", "noncurrent_assets"), ("Gross proft", "gross_profit"), ("本年度淨損", "net_income_loss"), ("Patrimônio líquido", "total_equity"), ("estado de resultado bruto", None), ("Revenue growth", None)])
def test_codes_of_labels(label, code):
    assert lineitems.code_of_label(label, fuzzy=False) == code


def test_scales(spark):
    words = {"R$ bilhões": 10**9, "US$ Billion": 10**9, "十億元": 10**9, "In Milhões": 10**6, "百萬": 10**6, "仟元": 1000, "em milhares de reais": 1000, "₹ in crore": 10**7, "Rs. lacs": 10**5, "$'000": 1000, "8,600,031": 1, "miles de pesos": 1, None: 1}
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", numbers.scale_of(F.col("t")).alias("s")).collect()} == words


def test_precision_and_nulls(spark):
    rows = spark.createDataFrame([("INF", "2"), ("-3", "0"), ("x", "1"), (None, "1"), ("2", "2")], "a string, b string")
    assert [r[0] for r in rows.select(views.less_precise(F.col("a"), F.col("b"))).collect()] == ["2", "-3", "x", None, "2"]
    found = rows.select(views.without_nulls("a", "b").alias("j")).collect()
    assert json.loads(found[3]["j"]) == {"b": "1"} and json.loads(found[0]["j"]) == {"a": "INF", "b": "2"}


def test_counts_and_projections(spark):
    raw = spark.createDataFrame([("f", True, 1), ("f", True, None), ("f", False, 2), ("g", False, None)], "filing_id string, numeric boolean, value int")
    assert {r["filing_id"]: r["fact_count"] for r in views.tagged_fact_count(raw).collect()} == {"f": 1, "g": 0}
    filings = spark.createDataFrame([("1", "c", "t", dt.date(2024, 5, 6), dt.datetime(2024, 5, 6, 7, 8, 9), None, Decimal("1.50")), ("2", "c", None, None, None, "d", None)], "id string, company_id string, title string, filing_date date, published_at timestamp, document_id string, extra decimal(9,2)")
    short = views.filing_summaries(filings)
    assert short.columns == ["id", "company_id", "title", "filing_date", "published_at", "has_document"]
    assert [tuple(r) for r in short.orderBy("id").collect()] == [("1", "c", "t", "2024-05-06", "2024-05-06T07:08:09Z", False), ("2", "c", None, None, None, True)]
    assert views.summary(filings, ("extra",)).orderBy("extra").collect()[-1]["extra"] == "1.50"
    companies = spark.createDataFrame([("c", "Acme", ["s"], "x")], "id string, name string, sources array<string>, address string")
    assert [tuple(r) for r in views.company_summaries(companies).collect()] == [("c", "Acme", ["s"])]


def test_envelopes():
    assert views.success({"a": 1}) == {"success": True, "data": {"a": 1}} and views.success({}, ["x"])["next_steps"] == ["x"]
    assert views.failure("no") == {"success": False, "error": "no", "error_code": "REQUEST_FAILED"} and views.failure("no", "C", ["s"])["suggestions"] == ["s"]


def test_a_title_counts_for_terms_that_the_text_has(spark):
    docs = spark.createDataFrame([(1, "revenue grew", "Revenue note"), (2, "a note on it", "Revenue")], "id int, text string, title string")
    score = {r["id"]: r["score"] for r in documents.bm25(docs, "revenue", [], ["id"], "text", "title").collect()}
    plain = {r["id"]: r["score"] for r in documents.bm25(docs, "revenue", [], ["id"], "text").collect()}
    assert score.keys() == {1} and score[1] == pytest.approx(plain[1] + 1.5)
