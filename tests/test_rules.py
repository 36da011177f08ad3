"""Rules whose outcome is fixed: keys of facts, folds, codes and ids, choice among rows without a value."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import folds, lineitems, numbers
from ledgerspark.operators import documents, search, storage, windows
from ledgerspark.sources import landed, structured
from ledgerspark.streaming import streams

FACT = "company_id string, statement_type string, code string, start_date date, end_date date, kind string, dimensions array<string>, reported_at timestamp, filing_id string, value int, seq int"


def fact(value, year, filing, dimensions=None, code="revenue"):
    return ("c", "income_statement", code, dt.date(2024, 1, 1), dt.date(2024, 12, 31), "duration", dimensions, dt.datetime(year, 3, 1, 15, 0), filing, value, 1)


def test_segments_are_facts_of_their_own(spark):
    rows = spark.createDataFrame([fact(100, 2025, "f1"), fact(60, 2025, "f1", ["Segment=A"]), fact(110, 2026, "f2", [])], FACT)
    got = {(r["value"], tuple(r["dimensions"] or ())) for r in windows.fact_history(rows).collect()}
    assert got == {(110, ()), (60, ("Segment=A",))}


def test_restated_and_original_values(spark):
    rows = spark.createDataFrame([fact(100, 2025, "f1"), fact(110, 2026, "f2")], FACT)
    values = lambda **o: [r["value"] for r in windows.fact_history(rows, **o).collect()]
    assert values(view="as_of", as_of="2025-12-31") == [100]
    assert values(view="as_of", as_of="2025-03-01") == [100]  # the day itself counts
    assert values(view="latest_restated") == [110]
    assert sorted(values(view="as_reported", as_of="2025-12-31")) == [100, 110]
    with pytest.raises(ValueError, match="date"):
        windows.fact_history(rows, "as_of")


def test_stream_keeps_segments(spark, tmp_path):
    rows = spark.createDataFrame([fact(100, 2025, "f1"), fact(60, 2025, "f1", ["Segment=A"]), fact(110, 2026, "f2")], FACT)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out" / "0")).collect()) == [60, 110]


NAMES = ["Société Générale", "Ørsted A/S", "Türkiye İş Bankası", "Iğdır Çimento", "L'Oréal SA"]


@pytest.mark.parametrize(("query", "found"), [("orsted", "Ørsted A/S"), ("ØRSTED", "Ørsted A/S"), ("societe generale", "Société Générale"), ("igdir", "Iğdır Çimento"), ("loreal", None), ("l oreal", "L'Oréal SA"), ("...", None), ("", None)])
def test_search_folds_names(spark, query, found):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert [r["name"] for r in search.three_tiers(df, query, ["name"], "name").collect()] == ([found] if found else [])


def test_underscores_stay(spark):
    row = spark.createDataFrame([("Ab_c—Éd",)], "t string").select(folds.fold(F.col("t"), "plain").alias("p"), folds.fold(F.col("t"), "match").alias("m")).first()
    assert tuple(row) == ("ab_c ed", "ab_c ed")


def test_merged_issuers(spark):
    rows = [
        (1, "GB", "Acme PLC", ["a"], None), (2, "GB", "acme Limited", ["b", "a"], "L1"), (3, "GB", "Acme Inc", ["a"], None), (4, "GB", "Acme Public Limited Company", ["c"], "L2"),
        (5, "JP", "トヨタ自動車", ["e"], None), (6, "JP", "ソニーグループ", ["e"], None), (7, "JP", "トヨタ 自動車", ["f"], None), (8, "GB", "日本", ["x"], None), (9, "GB", "中国", ["x"], None), (10, "FR", "Acme", ["a"], None),
    ]
    df = spark.createDataFrame(rows, "seq int, market string, name string, sources array<string>, lei string").repartition(3)
    got = {r["seq"]: (r["name"], r["sources"], r["lei"], r["records"]) for r in search.merge_companies(df).collect()}
    assert got == {
        1: ("Acme PLC", ["a", "b", "c"], "L1", 3), 3: ("Acme Inc", ["a"], None, 1), 5: ("トヨタ自動車", ["e", "f"], None, 2), 6: ("ソニーグループ", ["e"], None, 1),
        8: ("日本", ["x"], None, 1), 9: ("中国", ["x"], None, 1), 10: ("Acme", ["a"], None, 1),
    }


def test_greedy_ignores_case_and_punctuation(spark):
    rows = [("c", 1, "http://X/a", "2024-01-01", "Annual Report, 2023"), ("c", 2, "HTTP://x/A", "2024-02-01", "Other"), ("c", 3, "http://x/b", "2024-01-01", "annual report 2023"), ("c", 4, "http://x/c", "2024-01-02", "annual report 2023")]
    df = spark.createDataFrame(rows, "company_id string, seq int, source_url string, filing_date string, title string")
    assert sorted(r["seq"] for r in windows.greedy_filings(df).collect()) == [1, 4]


@pytest.mark.parametrize(
    ("text", "code"),
    [("in NT$ thousands", "TWD"), ("RMB million", "CNY"), ("MXN", "MXN"), ("HK$'000", "HKD"), ("S$'000", "SGD"), ("US$ million", "USD"), ("R$ mil", "BRL"), ("£m", "GBP"), ("€ million", "EUR"), ("European", None), ("$", None), ("Indian Rupee", "INR"), ("pesos colombianos", "COP")],
)
def test_currencies(spark, text, code):
    assert spark.range(1).select(numbers.currency_of(F.lit(text)).alias("c")).first()["c"] == code


def test_concepts(spark):
    assert sum(len(i[2]) for i in lineitems.ITEMS) == 104
    names = ["uk-core:TurnoverRevenue", "jppfs_cor:NetSales", "own:Equity", "us-gaap:SalesRevenueNet", "ifrs-full:EquityAttributableToOwnersOfParent", "Debtors"]
    got = {r["concept"]: (r["code"], r["alias_rank"], r["standard"]) for r in lineitems.with_codes(spark.createDataFrame([(n,) for n in names], "concept string")).collect()}
    assert got == {
        "uk-core:TurnoverRevenue": ("revenue", 2, 1), "jppfs_cor:NetSales": ("revenue", 7, 1), "own:Equity": ("total_equity", 0, 0), "us-gaap:SalesRevenueNet": ("revenue", 6, 0),
        "ifrs-full:EquityAttributableToOwnersOfParent": ("total_equity", 2, 1), "Debtors": ("trade_receivables", 1, 0),
    }


def test_japanese_document_types(spark):
    ddl = "seq int, docID string, edinetCode string, docTypeCode string, docDescription string, submitDateTime string, periodEnd string, xbrlFlag string, pdfFlag string, withdrawalStatus string, disclosureStatus string, legalStatus string"
    rows = [(i, f"S{i}", "E00001", code, "t", "2024-06-20 15:00", None, "1", "1", "0", "0", "1") for i, code in enumerate(["120", "135", "160", "180", "220", "236", "350"])]
    got = [(r["category"], r["filing_type"]) for r in landed.edinet_filings(spark.createDataFrame(rows, ddl)).orderBy("id").collect()]
    assert len(landed.EDINET_TYPES) == 16
    assert got == [("accounts", "annual"), ("confirmation", "confirmation"), ("accounts", "semiannual"), ("current", "current_report"), ("capital", "share_buyback"), ("internal_control", "internal_control_amendment"), ("other", "350")]


def test_british_ids_of_names(spark):
    df = spark.createDataFrame([("", " Acme  & Co., plc."), ("", "ACME co plc")], "lei string, name string")
    want = "uk_nsm_issuer_" + hashlib.sha256(b"acme co plc").hexdigest()[:16]
    assert {r["id"] for r in df.select(landed.uk_company_id(F.col("lei"), F.col("name")).alias("id")).collect()} == {want}


def test_brazilian_deliveries(spark):
    ddl = "seq int, Codigo_CVM string, Categoria string, Tipo string, Assunto string, Data_Entrega string, Data_Referencia string, Protocolo_Entrega string, Link_Download string"
    link = "https://x/frmDownload.aspx?numProtocolo=9&numSequencia={}&numVersao=1"
    rows = [
        (1, "9512", "Dados Econômico-Financeiros", "Demonstrações Financeiras Anuais Completas", "", "2024-02-01", "2023-12-31", "p1", link.format(11)),
        (2, "9512", "Fato Relevante", "", "Venda", "2024-02-02", "2024-01-31", "p2", link.format(12)),
        (3, "9512", "Fato Relevante", "x", "", "2024-02-02", None, "p3", link.format(13)),
        (4, "9512", "Fato Relevante", "x", "", "2024-02-02", "2024-01-31", "p4", "https://x/none"),
        (5, "9512", "Fato Relevante", "", "Compra", "2024-02-03", "2024-01-31", "p5", link.format(12)),
    ]
    df = spark.createDataFrame(rows, ddl)
    got = {r["id"]: (r["company_id"], r["category"], r["filing_type"], r["title"], r["description"]) for r in landed.cvm_filings(df).collect()}
    assert got == {
        "br_cvm_11": ("br_cvm_009512", "accounts", "annual", "Demonstrações Financeiras Anuais Completas for period ended 2023-12-31", None),
        "br_cvm_12": ("br_cvm_009512", "fato_relevante", "fato_relevante", "CVM filing for period ended 2024-01-31", "Compra"),
    }
    assert [r["id"] for r in landed.cvm_filings(df, "Accounts").collect()] == ["br_cvm_11"]
    assert [r["category"] for r in landed.cvm_filings(df, "fato relevante").collect()] == ["fato_relevante"]
    insiders = {r["id"]: (r["category"], r["filing_type"]) for r in landed.cvm_filings(df, "insider").collect()}
    assert insiders == {"br_cvm_11": ("accounts", "annual"), "br_cvm_12": ("insider", "insider")}


def test_rows_without_a_value_stand_for_nothing(spark):
    ddl = "filing_id string, sj_div string, account_id string, thstrm_amount string, currency string, start_date date, end_date date, fs_div string, pos int"
    day = [dt.date(2023, 1, 1), dt.date(2023, 12, 31)]
    rows = [("f", "BS", "ifrs-full_Assets", "-", "KRW", *day, "CFS", 1), ("f", "BS", "ifrs-full_Assets", "1,000", "KRW", *day, "CFS", 2), ("f", "CIS", "ifrs-full_Revenue", "5", None, *day, "CFS", 3), ("f", "IS", "ifrs-full_Revenue", "7", None, *day, "CFS", 4)]
    got = {(r["code"], int(r["value"])) for r in structured.dart_statements(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {("total_assets", 1000), ("revenue", 7)}
    ddl = "filing_id string, cuenta string, signo_valor string, valor string, fecha_corte date, pos int"
    rows = [("f", "100000", "+", "", day[1], 1), ("f", "100000", "+", "12", day[1], 2)]
    assert [int(r["value"]) for r in structured.sfc_balance_sheet(spark.createDataFrame(rows, ddl)).collect()] == [12]
    ddl = "filing_id string, CD_CONTA string, DS_CONTA string, ESCALA_MOEDA string, MOEDA string, ORDEM_EXERC string, DT_INI_EXERC string, DT_FIM_EXERC string, VL_CONTA string, VERSAO string, pos int"
    rows = [("f", "1", "Ativo Total", "MIL", "REAL", "ÚLTIMO", None, "2023-12-31", v, "1", i) for i, v in enumerate(["", "3.5"])]
    assert [float(r["value"]) for r in structured.cvm_statements(spark.createDataFrame(rows, ddl)).collect()] == [3500.0]


def test_a_null_corpus_is_a_corpus(spark):
    df = spark.createDataFrame([("a", None, "growth of revenue"), ("b", "k", "growth"), ("c", None, "nothing")], "id string, corpus string, text string")
    assert {r["id"] for r in documents.bm25(df, "growth", ["corpus"], ["id"], "text").collect()} == {"a", "b"}


def test_company_facts_look_through_a_window_of_filings(spark):
    filings = spark.createDataFrame([(f"f{i:02}", "c", dt.date(2020, 1, 1) + dt.timedelta(i), None, "accounts" if i % 2 else "news") for i in range(40)], "id string, company_id string, filing_date date, published_at timestamp, category string")
    facts = spark.createDataFrame([("c", "is", "revenue", dt.date(2019, 12, 31), dt.datetime(2020, 1, 1) + dt.timedelta(i), f"f{i:02}", i, 1) for i in (1, 19, 21, 38)], "company_id string, statement_type string, code string, end_date date, reported_at timestamp, filing_id string, value int, seq int")
    assert windows.scan_limit(1) == 10 and windows.scan_limit(8) == 40 and windows.scan_limit(99) == 50
    assert [r["value"] for r in windows.merge_company_facts(facts, 2, filings=filings).collect()] == [21]  # f38 is news, f19 and f01 are beyond the ten newest
    assert [r["value"] for r in windows.merge_company_facts(facts, 2).collect()] == [38]


def test_supported_sources_from_a_table(spark):
    companies = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", []), ("d", None)], "id string, sources array<string>")
    known = spark.createDataFrame([("x",)], "name string")
    for supported in (["x"], known):
        assert {r["id"] for r in storage.orphans(companies, supported).collect()} == {"b", "c", "d"}
