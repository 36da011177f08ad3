"""Parsers on small inline documents with known values."""

import datetime as dt
import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import folds, lineitems, numbers
from ledgerspark.operators import derive, documents, search, storage, windows
from ledgerspark.sources import forms, html, landed, statements, structured, xbrl

INLINE = b"""<html xmlns:ix="x"><body><ix:header><xbrli:context id="d"><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="i"><xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="s"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="a:Axis">a:M</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit></ix:header>
<ix:nonFraction name="ifrs-full:Revenue" contextRef="d" unitRef="u" decimals="-3" scale="3" format="ixt:num-dot-decimal">1,234</ix:nonFraction>
<ix:nonFraction name="ifrs-full:Revenue" contextRef="d" unitRef="u" decimals="-6" scale="6">1<ix:exclude>page 3</ix:exclude></ix:nonFraction>
<ix:nonFraction name="ifrs-full:Revenue" contextRef="s" unitRef="u" decimals="-3" scale="3">900</ix:nonFraction>
<ix:nonFraction name="ifrs-full:CashFlowsFromUsedInInvestingActivities" contextRef="d" unitRef="u" decimals="0" sign="-">210,000</ix:nonFraction>
<ix:nonFraction name="ifrs-full:Assets" contextRef="i" unitRef="u" decimals="0" format="ixt:fixed-zero">-</ix:nonFraction>
<ix:nonFraction name="ifrs-full:Equity" contextRef="i" unitRef="u" decimals="INF" format="ixt:num-comma-decimal">1.234,5</ix:nonFraction>
<ix:nonFraction name="ifrs-full:Goodwill" contextRef="lost" unitRef="u">5</ix:nonFraction></body></html>"""


def test_inline_xbrl(spark):
    docs = spark.createDataFrame([("f", bytearray(INLINE)), ("bad", bytearray(b"<!DOCTYPE x><x contextRef='1'/>"))], "filing_id string, content binary")
    got = {r["code"]: (r["value"], r["unit"], r["fiscal_period"], r["confidence"]) for r in xbrl.statements(docs).collect()}
    assert got["revenue"] == (Decimal("1234000.0000000000"), "GBP", "FY", 100)
    assert got["investing_cash_flow"][0] == Decimal(-210000) and got["total_assets"][0] == 0 and got["total_equity"][0] == Decimal("1234.5")
    assert "goodwill" not in got
    assert xbrl.parse_reports(docs).where("row = 'error'").count() == 1


def test_instance(spark):
    doc = b"""<x xmlns:c="urn:c"><context id="d"><period><startDate>2024-01-01</startDate><endDate>2024-03-31</endDate></period></context><unit id="u"><measure>iso4217:INR</measure></unit><c:Revenue contextRef="d" unitRef="u" decimals="-5">250</c:Revenue></x>"""
    row = xbrl.values(xbrl.parse_reports(spark.createDataFrame([("f", bytearray(doc))], "filing_id string, content binary"))).first()
    assert (row["concept"], row["value"], row["unit"], row["fiscal_period"]) == ("Revenue", Decimal(250), "INR", "Q")


def test_bmv_json(spark):
    doc = {"ContextosPorId": {"c": {"Periodo": {"FechaInicio": "2024-01-01T00:00:00", "FechaFin": "2024-12-31T00:00:00"}, "ValoresDimension": []}}, "UnidadesPorId": {"u": {"Medidas": [{"Nombre": "MXN"}]}},
           "HechosPorId": {"h": {"NombreConcepto": "Revenue", "EspacioNombres": "ns", "IdContexto": "c", "IdUnidad": "u", "Decimales": "0", "Valor": "12.50", "EsNumerico": True, "EsValorNil": False}}, "Taxonomia": {"mapaPrefijos": {"ns": "ifrs-full"}}}
    row = structured.bmv_values(spark.createDataFrame([("f", json.dumps(doc))], "filing_id string, json string")).first()
    assert (row["concept"], row["value"], row["unit"], row["end_date"]) == ("ifrs-full:Revenue", Decimal("12.5"), "MXN", dt.date(2024, 12, 31))


def test_structured(spark):
    ddl = "filing_id string, CD_CONTA string, DS_CONTA string, ESCALA_MOEDA string, MOEDA string, ORDEM_EXERC string, DT_INI_EXERC string, DT_FIM_EXERC string, VL_CONTA string, VERSAO string, pos int"
    row = lambda c, d, v, p: ("f", c, d, "MIL", "REAL", "ÚLTIMO", None, "2024-12-31", v, "1", p)
    got = {r["code"]: r["value"] for r in structured.cvm_statements(spark.createDataFrame([row("1", "Ativo Total", "1223389000", 0), row("1.01.04", "Estoques", "45173000", 1), row("1.02.01.05", "Estoques", "7", 2)], ddl)).collect()}
    assert got == {"total_assets": Decimal(1223389000000), "inventory": Decimal(45173000000)}
    ddl = "filing_id string, sj_div string, account_id string, thstrm_amount string, currency string, start_date date, end_date date, fs_div string, pos int"
    day = dt.date(2024, 12, 31)
    rows = [("f", "BS", "ifrs-full_Assets", "1,000", None, None, day, "CFS", 0), ("f", "BS", "ifrs-full_Assets", "9", None, None, day, "OFS", 1), ("f", "IS", "ifrs-full_Assets", "7", None, None, day, "CFS", 2), ("g", "BS", "ifrs-full_Equity", "5", "USD", None, day, "OFS", 0)]
    got = {(r["filing_id"], r["code"], r["value"], r["unit"]) for r in structured.dart_statements(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {("f", "total_assets", Decimal(1000), "KRW"), ("g", "total_equity", Decimal(5), "USD")}
    rows = [("f", "100000", "-", "5", day, 0), ("f", "100000", "+", "6", day, 1), ("f", "999", "+", "6", day, 2)]
    got = [(r["code"], r["value"]) for r in structured.sfc_balance_sheet(spark.createDataFrame(rows, "filing_id string, cuenta string, signo_valor string, valor string, fecha_corte date, pos int")).collect()]
    assert got == [("total_assets", Decimal(-5))]
    body = '<table><tr><td class="context-header">31.12.2024</td><td class="context-header">31.12.2023</td></tr><tr class="data-input-row"><td class="taxonomy-field-name-cell">ifrs-full_Assets:Assets</td><td class="taxonomy-context-value"><div title="8.530.658.585">8</div></td><td class="taxonomy-context-value"><div title="8.235.745.263">8</div></td></tr></table>'
    got = {(r["end_date"].year, r["value"]) for r in structured.kap_statements(spark.createDataFrame([("f", body)], "filing_id string, body string")).collect()}
    assert got == {(2024, Decimal(8530658585)), (2023, Decimal(8235745263))}
    assert structured.unwrap_java_bytes(b"\xac\xed\x00\x05ur\x00\x02[B\xac\xf3\x17\xf8xp\x00\x00\x00\x02ok") == b"ok"


def test_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.htm", "<p>short</p>")
        z.writestr("b.xhtml", "<p>much longer</p>")
        z.writestr("c.txt", "x" * 99)
    df = spark.createDataFrame([("f", bytearray(out.getvalue())), ("g", bytearray(b"no zip"))], "filing_id string, content binary")
    assert [r["member"] for r in structured.largest_html(df).collect()] == ["b.xhtml"]
    assert structured.unzip(df).where("error is not null").count() == 1


def test_markdown():
    text = html.to_markdown("<html><head><title>t</title></head><body><h1>A  b</h1><p>x&nbsp;y<script>var a='</p>'</script></p><ul><li>one<li>two</ul><table><tr><th>k<th>2024</tr><tr><td>a|b<td>1</table></body></html>")
    assert text.splitlines()[0] == "# A b" and "- one\n- two" in text and "x y" in text and "var" not in text
    assert "| k | 2024 |\n| --- | --- |\n| a\\|b | 1 |" in text


@pytest.mark.parametrize(("text", "value"), [("1,234", 1234), ("(1,234.5)", Decimal("-1234.5")), ("1.234,5", Decimal("1234.5")), ("0.420", 420), ("12,34,567", 1234567), ("-", None), ("n/a", None), ("1,5", Decimal("1.5")), ("£ 1 234", 1234), ("2024", 2024), ("12.5", Decimal("12.5"))])
def test_numbers(spark, text, value):
    got = spark.range(1).select(numbers.parse_number(F.lit(text)).alias("v")).first()["v"]
    assert got == value and statements.number(text) == value


def test_scale_and_currency(spark):
    row = spark.range(1).select(numbers.scale_of(F.lit("in £ millions")).alias("a"), numbers.scale_of(F.lit("£'000")).alias("b"), numbers.scale_of(F.lit("Rs crore")).alias("c"), numbers.currency_of(F.lit("US$ m")).alias("d"), numbers.currency_of(F.lit("europe")).alias("e")).first()
    assert tuple(row) == (1000000, 1000, 10000000, "USD", None)


def test_printed_statements(spark):
    table = "# Consolidated income statement\n\n£ million\n\n| | 2025 | 2024 |\n|---|---|---|\n| Revenue | 1,234 | 1,100 |\n| Gross profit | 500 | (20) |\n"
    text = "Consolidated balance sheet\n2025\n2024\n£'000\nTotal assets\n12\n9,000\n8,000\nTotal equity\n4,000\n3,000\n"
    df = spark.createDataFrame([("t", table, dt.date(2025, 6, 30)), ("x", text, dt.date(2025, 12, 31))], "filing_id string, markdown string, period_end date")
    got = {(r["filing_id"], r["code"], r["year"]): (r["value"], r["unit"]) for r in statements.read_statements(df).collect()}
    assert got[("t", "revenue", 2025)] == (Decimal(1234000000), "GBP") and got[("t", "gross_profit", 2024)][0] == Decimal(-20000000)
    assert got[("x", "total_assets", 2025)] == (Decimal(9000000), "GBP") and got[("x", "total_equity", 2024)][0] == Decimal(3000000)


def test_labels_and_folds(spark):
    assert lineitems.code_of_label("Total assets") == "total_assets" and lineitems.code_of_label("Totl assets") == "total_assets"
    assert lineitems.code_of_label("Revenue growth") is None and lineitems.code_of_label("Something else") is None
    df = spark.createDataFrame([("Société Générale Øst",)], "t string")
    assert df.select(folds.fold(F.col("t"), "match").alias("x")).first()["x"] == "societe generale ost"
    assert round(folds.indel_ratio("abc", "abd"), 1) == 66.7


def test_forms():
    holding = forms.major_holding("<table><tr><td>1a. Identity of the issuer</td><td>ACME PLC</td></tr><tr><td>Name</td><td>Big Fund</td></tr><tr><td>5. Date on which the threshold was crossed</td><td>1st March 2024</td></tr><tr><td>Resulting situation on the date</td><td>4.1</td><td>0.9</td><td>5.0%</td></tr></table>")
    assert (holding["issuer_name"], holding["holder_name"], holding["crossed_date"], holding["percent"]) == ("ACME PLC", "Big Fund", dt.date(2024, 3, 1), Decimal("5.0"))
    found = forms.dealings("<table><tr><td>a) Name</td><td>Jo Doe</td></tr><tr><td>a) Position/status</td><td>CFO</td></tr><tr><td>Identification code</td><td>GB0008847096</td></tr><tr><td>b) Nature of the transaction</td><td>Purchase</td></tr><tr><td>c) Price(s) and volume(s)</td><td>Price(s)</td><td>Volume(s)</td><td>£2.50</td><td>1,000</td></tr><tr><td>e) Date of the transaction</td><td>2024-03-01</td></tr></table>")
    assert len(found) == 1 and found[0]["position"] == "CFO" and found[0]["lots"] == [{"price": Decimal("2.50"), "currency": "GBP", "volume": Decimal(1000)}]


def test_landed(spark):
    hits = spark.createDataFrame([(1, "d1", "Acme plc; Beta plc", "213800ABCDEFGHIJKL12;", [("Gamma ltd", None)], "Results", "ACS", "FR", "2024-03-01T07:00:00", "2023-12-31", "p", "Y", 1)], "seq int, disclosure_id string, company string, lei string, related_org array<struct<company:string,lei:string>>, headline string, type string, type_code string, publication_date string, document_date string, download_link string, latest_flag string, hist_seq int")
    assert {r["name"] for r in landed.uk_issuers(hits).collect()} == {"Acme plc", "Beta plc", "Gamma ltd"}
    assert landed.uk_filings(hits).first()["company_id"] == "uk_lei_213800ABCDEFGHIJKL12"
    assert landed.search_headlines(landed.uk_filings(hits), " ").count() == 0 and landed.search_headlines(landed.uk_filings(hits), "RESULT").count() == 1
    page = json.dumps({"data": [{"id": "1", "attributes": {"period_end": "2023-12-31", "date_added": "2024-04-01", "report_url": "/x/report-en.xhtml"}, "relationships": {"entity": {"data": {"id": "9"}}}}], "included": [{"id": "9", "attributes": {"name": "A", "identifier": "213800abcdefghijkl12"}}]})
    row = landed.esef_filings(spark.createDataFrame([(page,)], "json string"), "nl").first()
    assert (row["company_id"], row["language"]) == ("nl_lei_213800ABCDEFGHIJKL12", "en")
    days = spark.createDataFrame([(1, "S1", "E00001", "120", "t", "2024-06-20 15:00", "2024-03-31", "1", "1", "0", "0", "1"), (2, "S2", "E00001", "999", "t", "2024-06-20 15:00", None, "0", "1", "2", "0", "1")], "seq int, docID string, edinetCode string, docTypeCode string, docDescription string, submitDateTime string, periodEnd string, xbrlFlag string, pdfFlag string, withdrawalStatus string, disclosureStatus string, legalStatus string")
    (row,) = landed.edinet_filings(days).collect()
    assert (row["filing_type"], row["published_at"]) == ("annual", dt.datetime(2024, 6, 20, 6, 0))


def test_sections_and_search(spark):
    text = "# One\nalpha revenue\n## Two\nrevenue growth\n# 1,234\n# Three\nomega"
    df = spark.createDataFrame([("f", text)], "filing_id string, markdown string")
    s = documents.sections(df)
    assert [(r["title"], r["start_line"], r["end_line"]) for r in s.orderBy("section_no").collect()] == [("One", 1, 5), ("Two", 3, 5), ("Three", 6, 7)]
    found = documents.bm25(s, "revenue growth", ["filing_id"], ["title"], "markdown", "title").orderBy(F.desc("score")).collect()
    assert [r["title"] for r in found] == ["Two", "One"]


def test_derived_and_audit(spark):
    ddl = "filing_id string, code string, value decimal(38,10), confidence int, start_date date, end_date date, kind string, unit string, provenance string, dimensions array<struct<axis:string,member:string>>"
    row = lambda c, v: ("f", c, Decimal(v), 100, None, dt.date(2024, 12, 31), "instant", "GBP", "tagged_xbrl", [])
    facts = spark.createDataFrame([row("current_assets", 2), row("noncurrent_assets", 3), row("total_equity", 2)], ddl)
    got = {r["code"]: (r["value"], r["derived_from"]) for r in derive.derive_totals(facts).where("provenance = 'derived'").collect()}
    assert got == {"total_assets": (Decimal(5), ["current_assets", "noncurrent_assets"]), "total_liabilities": (Decimal(3), ["total_assets", "total_equity"])}
    assert derive.audit(derive.derive_totals(facts)).where("status <> 'not_applicable'").count() == 0
    full = spark.createDataFrame([row("total_assets", 5), row("total_liabilities", 3), row("total_equity", 2)], ddl)
    assert derive.smoke_identity(full).first()["status"] == "held"


def test_greedy_and_history(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, "c", d, "m1", "u1", 1), (2, "c", d, "m1", "u2", 2), (3, "c", d, "m3", "u2", 3)]
    kept = windows.greedy_filings(spark.createDataFrame(rows, "id int, company_id string, filing_date date, title string, source_url string, seq int"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    ddl = "filing_id string, company_id string, reported_at date, statement_type string, code string, start_date date, end_date date, kind string, value int, seq int"
    facts = spark.createDataFrame([("a", "c", d, "s", "x", None, d, "instant", 100, 1), ("b", "c", dt.date(2025, 1, 1), "s", "x", None, d, "instant", 110, 1)], ddl)
    assert windows.fact_history(facts).first()["value"] == 110
    assert windows.fact_history(facts, "as_of", as_of="2024-12-31").first()["value"] == 100
    assert windows.fact_history(facts, "as_reported").count() == 2


def test_storage_and_search(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    assert {(r["id"], r["v"]) for r in storage.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    df = spark.createDataFrame([("1", "Acme PLC", "GB", ["s"], None, 1), ("2", "ACME", "GB", ["t"], "L", 2)], "id string, name string, market string, sources array<string>, lei string, seq int")
    (row,) = search.merge_companies(df).collect()
    assert (row["id"], row["sources"], row["lei"]) == ("1", ["s", "t"], "L")
    assert search.two_tiers(df, " ", ["name"]).count() == 0
    assert df.select(search.source_of_id(F.lit("nl_lei_X"))).first()[0] == "esef"
