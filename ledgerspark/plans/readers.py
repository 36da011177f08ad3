"""Registered queries of the readers: feeds and reports are made of the star schema's rows and read back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import documents, search, windows
from ..sources import dispatch, landed, structured, xbrl
from ..streaming import streams
from ..tables import table
from .queries import query


def _orders(spark, d):
    """Orders with a number and the day as text, which all feeds are made of."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_orderdate").cast("date").alias("day"))
    return rows.withColumn("n", F.col("k") % 10000).withColumn("at", F.col("day").cast("string"))


def _spread(docs):
    """Documents over all cores: a few MB of rows make many reports, and reading one is work."""
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism, "filing_id")


def _text(template: str):
    """The template with {column} filled in; a native expression."""
    parts = template.replace("{", "\0{").replace("}", "}\0").split("\0")
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts if p])


O = "o as (select o_orderkey k, o_custkey c, o_orderstatus s, o_orderpriority p, cast(o_orderdate as date) as day, o_orderkey % 10000 n from orders)"  # noqa: E741

INLINE = (
    '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:ix="i"><head><title>t</title></head><body><ix:header><context id="c"><period><startDate>2020-01-01</startDate><endDate>{at}</endDate></period></context>'
    '<context id="i"><period><instant>{at}</instant></period></context><unit id="u"><measure>iso4217:GBP</measure></unit></ix:header>'
    '<p>Sales <ix:nonFraction name="ifrs-full:Revenue" contextRef="c" unitRef="u" decimals="-3" scale="3" sign="{sign}">{n}</ix:nonFraction> and <ix:nonFraction name="ifrs-full:Assets" contextRef="i" unitRef="u" decimals="0" format="ixt:num-comma-decimal">{n},5</ix:nonFraction>'
    '<ix:nonFraction name="own:Other" contextRef="none" unitRef="u" decimals="0">1</ix:nonFraction></p></body></html>'
)


@query(f"""with {O} select k::varchar filing_id, 'ifrs-full:Revenue' concept, date '2020-01-01' start_date, day end_date, 'duration' kind, (case when s = 'F' then -1000 else 1000 end * n)::double as value, 'GBP' unit, '-3' decimals from o
union all select k::varchar, 'ifrs-full:Assets', null, day, 'instant', n + 0.5, 'GBP', '0' from o""")
def inline_xbrl_values(spark, d):
    """Every order as an inline report of two facts and one without a context."""
    docs = _orders(spark, d).withColumn("sign", F.when(F.col("s") == "F", "-").otherwise("")).select(F.col("k").alias("filing_id"), F.encode(_text(INLINE), "UTF-8").alias("content"))
    return xbrl.values(xbrl.parse_reports(_spread(docs))).select("filing_id", "concept", "start_date", "end_date", "kind", F.col("value").cast("double").alias("value"), "unit", "decimals")


INSTANCE = (
    '<?xml version="1.0"?><xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:f="urn:f"><context id="c"><period><instant>{at}</instant></period></context><context id="d"><period><instant>{at}</instant></period><entity><segment>'
    '<explicitMember dimension="f:Axis">f:Member</explicitMember></segment></entity></context><unit id="u"><measure>iso4217:INR</measure></unit>'
    '<f:Equity contextRef="c" unitRef="u" decimals="0">{n}</f:Equity><f:EquityAttributableToOwnersOfParent contextRef="c" unitRef="u" decimals="0">{c}</f:EquityAttributableToOwnersOfParent>'
    '<f:Assets contextRef="c" unitRef="u" decimals="-3">1000</f:Assets><f:Assets contextRef="c" unitRef="u" decimals="INF">{k}</f:Assets><f:Assets contextRef="d" unitRef="u" decimals="INF">7</f:Assets></xbrl>'
)


@query(f"with {O} select k::varchar filing_id, 'total_equity' code, day end_date, n::double as value from o union all select k::varchar, 'total_assets', day, k::double from o")
def instance_statements(spark, d):
    """Every order as an instance: the preferred concept, the most precise value, no segment."""
    docs = _orders(spark, d).select(F.col("k").alias("filing_id"), F.encode(_text(INSTANCE), "UTF-8").alias("content"))
    return xbrl.statements(_spread(docs)).select("filing_id", "code", "end_date", F.col("value").cast("double").alias("value"))


@query(f"""with {O} select k::varchar filing_id, 'total_assets' code, 'instant' kind, n::double as value, 'tagged_xbrl' provenance from o where s <> 'F' union all select k::varchar, 'total_equity', 'instant', (n // 2)::double, 'tagged_xbrl' from o where s <> 'F'
union all select k::varchar, 'total_liabilities', 'instant', (n - n // 2)::double, 'derived' from o where s <> 'F'
union all select k::varchar, 'total_assets', 'instant', 1000.0 * (n + 1), 'pdf_table' from o where s = 'F' union all select k::varchar, 'total_liabilities', 'instant', 1000.0, 'pdf_table' from o where s = 'F' union all select k::varchar, 'total_equity', 'instant', 1000.0 * n, 'derived' from o where s = 'F'""")
def dispatched_line_items(spark, d):
    """Open orders as inline reports, finished ones as printed balance sheets: routed, read, totals derived."""
    page = (
        '<html xmlns:ix="i"><body><context id="i"><period><instant>2024-12-31</instant></period></context><unit id="u"><measure>iso4217:GBP</measure></unit><ix:nonFraction name="ifrs-full:Assets" contextRef="i" unitRef="u" decimals="0">{n}</ix:nonFraction>'
        '<ix:nonFraction name="ifrs-full:Equity" contextRef="i" unitRef="u" decimals="0">{half}</ix:nonFraction></body></html>'
    )
    sheet = "# Balance sheet\n\nGBP thousands\n\n| Item | 2024 |\n| --- | --- |\n| Total assets | {more} |\n| Total liabilities | 1 |\n"
    rows = _orders(spark, d).withColumn("half", F.floor(F.col("n") / 2)).withColumn("more", F.col("n") + 1)
    tagged = F.col("s") != "F"
    docs = rows.select(
        F.col("k").cast("string").alias("filing_id"), F.when(tagged, F.encode(_text(page), "UTF-8")).otherwise(F.encode(F.lit("%PDF-1.7"), "UTF-8")).alias("content"), F.when(tagged, "text/html").otherwise("application/pdf").alias("media_type"),
        F.lit(None).cast("string").alias("profile"), F.when(~tagged, _text(sheet)).alias("markdown"), F.lit("2024-12-31").cast("date").alias("period_end"),
    )
    return dispatch.line_items(_spread(docs)).select("filing_id", "code", "kind", F.col("value").cast("double").alias("value"), "provenance")


@query(f"with {O} select k filing_id, 'total_assets' code, (1000 * n)::double as value, 'BRL' unit, day end_date, 'ULTIMO' ordem from o where s <> 'P' union all select k, 'inventory', (1000 * c)::double, 'BRL', day, 'ULTIMO' from o")
def cvm_accounts(spark, d):
    """Account rows: the shallowest account of a code that has a value."""
    rows = _orders(spark, d)
    account = lambda code, name, value, pos: F.struct(F.lit(code).alias("CD_CONTA"), F.lit(name).alias("DS_CONTA"), value.cast("string").alias("VL_CONTA"), F.lit(pos).alias("pos"))
    cells = F.array(account("1", "Ativo Total", F.when(F.col("s") != "P", F.col("n")), 1), account("1.01.04.02", "Estoques", F.col("n"), 2), account("1.01.04", "Estoques", F.col("c"), 3), account("9", "Outra conta", F.lit(5), 4))
    rows = rows.select(F.col("k").alias("filing_id"), F.explode(cells).alias("a"), F.lit("MIL").alias("ESCALA_MOEDA"), F.lit("REAL").alias("MOEDA"), F.lit("ULTIMO").alias("ORDEM_EXERC"), F.lit(None).cast("string").alias("DT_INI_EXERC"), F.col("at").alias("DT_FIM_EXERC"), F.lit("1").alias("VERSAO"))
    return structured.cvm_statements(rows.select("*", "a.*").drop("a")).select("filing_id", "code", F.col("value").cast("double").alias("value"), "unit", "end_date", F.lit("ULTIMO").alias("ordem"))


@query(f"with {O} select k filing_id, 'total_assets' code, n::double as value, null::date start_date from o union all select k, 'revenue', (case when s = 'F' then c else k end)::double, date '2020-01-01' from o")
def dart_accounts(spark, d):
    """Rows of a company's accounts: consolidated before separate, the code's own statement, a value."""
    text = lambda c: F.format_number(c, 0)
    cell = lambda div, account, value, fs, pos: F.struct(F.lit(div).alias("sj_div"), F.lit(account).alias("account_id"), value.alias("thstrm_amount"), F.lit(fs).alias("fs_div"), F.lit(pos).alias("pos"))
    cells = F.array(
        cell("BS", "ifrs-full_Assets", F.lit(""), "CFS", 1), cell("BS", "ifrs-full_Assets", text(F.col("n")), "CFS", 2), cell("BS", "ifrs-full_Assets", F.lit("1"), "OFS", 3), cell("CIS", "ifrs-full_Revenue", F.lit("9"), "CFS", 4),
        cell("IS", "ifrs-full_Revenue", F.when(F.col("s") == "F", text(F.col("c"))), "CFS", 5), cell("IS", "ifrs-full_Revenue", text(F.col("k")), "CFS", 6),
    )
    rows = _orders(spark, d).select(F.col("k").alias("filing_id"), F.explode(cells).alias("a"), F.lit("KRW").alias("currency"), F.lit("2020-01-01").cast("date").alias("start_date"), F.col("day").alias("end_date")).select("*", "a.*").drop("a")
    return structured.dart_statements(rows).select("filing_id", "code", F.col("value").cast("double").alias("value"), "start_date")


@query(f"with {O} select k filing_id, 'total_assets' code, (case when s = 'F' then -n else n end)::double as value, day end_date from o")
def sfc_accounts(spark, d):
    rows = _orders(spark, d).select(F.col("k").alias("filing_id"), F.explode(F.array(F.lit("100000"), F.lit("999999"))).alias("cuenta"), F.when(F.col("s") == "F", "-").otherwise("+").alias("signo_valor"), F.col("n").cast("string").alias("valor"), F.col("day").alias("fecha_corte"), F.lit(1).alias("pos"))
    return structured.sfc_balance_sheet(rows).select("filing_id", "code", F.col("value").cast("double").alias("value"), "end_date")


@query(f"with {O} select k::varchar filing_id, 'mx:Assets' concept, null::date start_date, day end_date, n::double as value, 'MXN' unit from o union all select k::varchar, 'mx:Revenue', date '2020-01-01', day, c::double, 'MXN' from o")
def bmv_facts(spark, d):
    """Every order as a JSON report with an instant, a duration and a nil fact."""
    fact = '"{id}":{"Id":"{id}","EspacioNombres":"ns","NombreConcepto":"{name}","IdContexto":"{context}","IdUnidad":"u","Decimales":"0","Valor":"{value}","EsNumerico":true,"EsValorNil":{nil}}'
    one = lambda i, name, context, value, nil="false": fact.replace("{id}", i).replace("{name}", name).replace("{context}", context).replace("{value}", value).replace("{nil}", nil)
    body = ",".join([one("a", "Assets", "i", "\1{n}\1"), one("b", "Revenue", "p", "\1{c}\1"), one("e", "Equity", "i", "1", "true")])
    text = '{"ContextosPorId":{"i":{"Periodo":{"FechaInstante":"\1{at}\1"}},"p":{"Periodo":{"FechaInicio":"2020-01-01","FechaFin":"\1{at}\1"}}},"UnidadesPorId":{"u":{"Medidas":[{"Nombre":"MXN"}]}},"HechosPorId":{' + body + '},"Taxonomia":{"mapaPrefijos":{"ns":"mx"}}}'
    filled = F.concat(*[F.col(p[1:-1]).cast("string") if p in ("{n}", "{c}", "{at}") else F.lit(p) for p in text.split("\1")])
    docs = _orders(spark, d).select(F.col("k").cast("string").alias("filing_id"), filled.alias("json"))
    return structured.bmv_values(docs).where("value is not null").select("filing_id", "concept", "start_date", "end_date", F.col("value").cast("double").alias("value"), "unit")


@query("select o_orderkey::varchar filing_id, 'b.html' member, length('<p>' || o_orderkey || o_orderpriority || '</p>') as size from orders")
def archive_largest_page(spark, d):
    """Every order as an archive of pages: the largest one."""

    def pack(frames):
        for frame in frames:
            out = []
            for k, p in zip(frame["k"], frame["p"]):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for name, text in (("a.html", "<p></p>"), ("b.html", f"<p>{k}{p}</p>"), ("c.txt", "x" * 100)):
                        z.writestr(name, text)
                out.append(data.getvalue())
            yield frame.assign(filing_id=frame["k"].astype(str), content=out)[["filing_id", "content"]]

    archives = _orders(spark, d).select("k", "p").mapInPandas(pack, "filing_id string, content binary")
    return structured.largest_html(_spread(archives)).select("filing_id", "member", F.length("content").cast("long").alias("size"))


@query(f"""with {O} select 'jp_edinet_S' || k id, 'jp_e' || lpad(c::varchar, 5, '0') company_id, case when s = 'F' then 'accounts' when s = 'O' then 'capital' else 'other' end category, case when s = 'F' then 'annual' when s = 'O' then 'share_buyback' else '999' end filing_type,
day filing_date, day + interval '6 hours' - interval '9 hours' published_at from o where k % 10 <> 0""")
def edinet_documents(spark, d):
    rows = _orders(spark, d).select(
        F.col("k").alias("seq"), _text("S{k}").alias("docID"), F.concat(F.lit("E"), F.lpad(F.col("c").cast("string"), 5, "0")).alias("edinetCode"), F.when(F.col("s") == "F", "120").when(F.col("s") == "O", "220").otherwise("999").alias("docTypeCode"), F.col("p").alias("docDescription"),
        _text("{at} 06:00").alias("submitDateTime"), F.lit(None).cast("string").alias("periodEnd"), F.lit("1").alias("xbrlFlag"), F.lit("1").alias("pdfFlag"), F.when(F.col("k") % 10 == 0, "2").otherwise("0").alias("withdrawalStatus"), F.lit("0").alias("disclosureStatus"), F.lit("1").alias("legalStatus"),
    )
    return landed.edinet_filings(rows).select("id", "company_id", "category", "filing_type", "filing_date", "published_at")


@query(f"""with {O} select 'br_cvm_' || k id, 'br_cvm_' || lpad(c::varchar, 6, '0') company_id, case when s = 'F' then 'accounts' else 'fato_relevante' end category, case when s = 'F' then 'annual' else 'assembleia_geral' end filing_type,
case when s = 'F' then 'Demonstrações Financeiras Anuais Completas' else 'Assembleia Geral' end || ' for period ended ' || strftime(day, '%Y-%m-%d') title, day filing_date, case when s = 'O' then p end description from o where s <> 'P'""")
def cvm_deliveries(spark, d):
    link = F.when(F.col("s") != "P", _text("https://x/f.aspx?numSequencia={k}&numVersao=1")).otherwise("https://x/f.aspx")
    rows = _orders(spark, d).select(
        F.col("k").alias("seq"), F.col("c").cast("string").alias("Codigo_CVM"), F.lit("Fato Relevante").alias("Categoria"), F.when(F.col("s") == "F", "Demonstrações Financeiras Anuais Completas").otherwise("Assembleia Geral").alias("Tipo"),
        F.when(F.col("s") == "O", F.col("p")).otherwise(" ").alias("Assunto"), F.col("at").alias("Data_Entrega"), F.col("at").alias("Data_Referencia"), F.lit("x").alias("Protocolo_Entrega"), link.alias("Link_Download"),
    )
    return landed.cvm_filings(rows).select("id", "company_id", "category", "filing_type", "title", "filing_date", "description")


@query("select distinct 'uk_nsm_issuer_' || left(sha256(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))), 16) id from part")
def uk_issuer_ids(spark, d):
    rows = table(spark, d, "part").select(F.lit("").alias("lei"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(".")).alias("name"))
    return rows.select(landed.uk_company_id(F.col("lei"), F.col("name")).alias("id")).distinct()


@query(f"with {O} select 'uk_nsm_' || k id, day filing_date, case when s = 'F' then 'ACS' else 'FCA' end filing_type from o where s <> 'P' and contains(lower(p), 'high')")
def uk_disclosure_search(spark, d):
    """Hits whose headline has the keyword, in their latest version."""
    rows = _orders(spark, d).select(
        F.col("k").alias("seq"), F.col("k").cast("string").alias("disclosure_id"), _text("Issuer {c}; Other").alias("company"), F.lit("").alias("lei"), F.lit(None).cast("array<struct<company:string,lei:string>>").alias("related_org"), F.col("p").alias("headline"), F.lit("t").alias("type"),
        F.when(F.col("s") == "F", "ACS").otherwise("FCA").alias("type_code"), F.col("at").alias("publication_date"), F.col("at").alias("document_date"), F.lit("u").alias("download_link"), F.when(F.col("s") != "P", "Y").otherwise("N").alias("latest_flag"), F.lit(1).alias("hist_seq"),
    )
    return landed.search_headlines(landed.uk_filings(rows), " HIGH ").select("id", "filing_date", "filing_type")


@query("select 'kr_dart_' || c_custkey id, c_name as name, c_custkey::varchar ticker from customer where c_custkey % 3 <> 0")
def dart_registry(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("corp_code"), F.col("c_name").alias("corp_name"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.col("c_custkey").cast("string"), F.lit(" "))).otherwise(" ").alias("stock_code"))
    return landed.dart_companies(rows).select("id", "name", "ticker")


@query(f"with {O}, r as (select *, row_number() over (partition by c, day order by case when p like '1%' then 0 else 1 end, case when s = 'F' then 0 else 1 end, k) r from o where p not like '5%') select c symbol, day qe_date, k seq from r where r = 1")
def nse_best_report(spark, d):
    """Of each symbol and day the consolidated, then audited, then first report."""
    kind = F.when(F.startswith("p", F.lit("5")), "Other").when(F.startswith("p", F.lit("2")), "Revision").otherwise("Original")
    rows = _orders(spark, d).select(F.col("c").alias("symbol"), F.col("day").alias("qe_date"), kind.alias("type"), F.when(F.startswith("p", F.lit("1")), "Consolidated").otherwise("Non-Consolidated").alias("consolidated"), F.when(F.col("s") == "F", "Audited").otherwise("Un-Audited").alias("audited"), F.col("k").alias("seq"))
    return landed.nse_best_xbrl(rows).select("symbol", "qe_date", "seq")


@query(f"with {O} select 'pe_smv_' || s || '_' || year(day) || '_' || lower(x) id, make_date(year(day) + 1, 4, 30) filing_date from (select distinct s, year(day) y, make_date(year(day), 1, 1) as day from o) cross join (values ('C'), ('I')) t(x)")
def smv_reports(spark, d):
    """Two reports of each company and year."""
    rows = _orders(spark, d).select(F.col("s").alias("rpj"), F.col("p").alias("name"), F.year("day").alias("year")).dropDuplicates(["rpj", "year"])
    return landed.smv_filings(rows).select("id", "filing_date")


@query("select doc_id filing_id, 0 section_no, source title, 1 as level from documents where text is not null union all select doc_id, 1, 'Part ' || lang, 2 from documents where text is not null and lang is not null")
def document_sections(spark, d):
    """Texts below headings made of their source and language."""
    rows = table(spark, d, "documents").where("text is not null")
    part = F.when(F.col("lang").isNotNull(), F.concat(F.lit("\n## Part "), "lang", F.lit("\n"))).otherwise("\n")
    body = F.regexp_replace("text", "#", "")
    return documents.sections(rows.select(F.col("doc_id").alias("filing_id"), F.concat(F.lit("# "), "source", part, body).alias("markdown"))).select("filing_id", "section_no", "title", "level")


@query(f"with {O} select k id, case k % 4 when 0 then 'edinet' when 1 then 'cvm' when 2 then 'esef' end source from o")
def id_routes(spark, d):
    own = F.when(F.col("k") % 4 == 0, _text("jp_e{c}")).when(F.col("k") % 4 == 1, _text("br_cvm_{c}")).when(F.col("k") % 4 == 2, _text("fr_lei_{c}")).otherwise(_text("xx_{c}"))
    return _orders(spark, d).select(F.col("k").alias("id"), search.source_of_id(own).alias("source"))


@query(f"with {O} select k id, case when s = 'F' then null when p like '1%' then make_date(year(day) - 1, 12, 31) + 1 else day - interval '1 year' + interval '1 day' end::date start_date, day end_date from o where month(day) = 12 and dayofmonth(day) = 31")
def reporting_periods(spark, d):
    """Periods of columns headed by a year, of orders on the last day of one."""
    rows = _orders(spark, d).where("month(day) = 12 and day(day) = 31").withColumn("begin", F.when(F.startswith("p", F.lit("1")), F.make_date(F.year("day"), F.lit(1), F.lit(1))))
    start, end = dates.reporting_period(F.year("day"), F.col("s") == "F", F.col("day"), F.col("begin"))
    return rows.select(F.col("k").alias("id"), start.alias("start_date"), end.alias("end_date"))


@query("select event_id, event_type, strftime(ts, '%d.%m.%Y') printed, cast(ts as date) as day from events")
def dates_printed(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.date_format("ts", "dd.MM.yyyy").alias("printed"))
    return rows.withColumn("day", dates.parse_date(F.col("printed")))


@query("select event_type, min(cast(ts as date)) first_day, count(*) n from events where cast(ts as date) >= date '2024-01-10' group by event_type")
def watched_events(spark, d):
    """The watchlist's rule over the table that a stream would bring."""
    rows = streams.watch(table(spark, d, "events").withColumn("filing_date", F.col("ts").cast("date")), "2024-01-10")
    return rows.groupBy("event_type").agg(F.min("filing_date").alias("first_day"), F.count("*").alias("n"))


@query("select k filing_id, i dealing_no, c || '-' || i person from (select o_orderkey k, o_custkey c, unnest(range(0, o_orderkey % 3)) i from orders)")
def dealings_flat(spark, d):
    """Insiders' dealings one by one."""
    people = F.transform(F.sequence(F.lit(1), F.col("k") % 3), lambda i: F.struct(F.concat_ws("-", F.col("c").cast("string"), (i - 1).cast("string")).alias("person")))
    rows = _orders(spark, d).select(F.col("k").alias("id"), F.lit(None).cast("timestamp").alias("published_at"), F.col("day").alias("filing_date"), F.when(F.col("k") % 3 > 0, people).otherwise(F.array().cast("array<struct<person:string>>")).alias("dealings"))
    return windows.flatten_dealings(rows).select(F.col("id").alias("filing_id"), F.col("dealing_no").cast("long").alias("dealing_no"), "dealing.person")
