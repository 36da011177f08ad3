"""Landed regulator files to canonical companies and filings, one function for each feed.

Each takes a DataFrame of the feed's own rows (as Spark's JSON, CSV or XML
readers give them) and returns columns of the canonical tables. Nothing here
touches a network: landing files is another job's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import KINDS, fold
from ..operators.windows import top_per_group

LEI = r"^[A-Z0-9]{18}[0-9]{2}$"


def _split(column: Column, upper: bool = False) -> Column:
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda x: F.trim(x))
    parts = F.transform(parts, F.upper) if upper else parts
    return F.filter(parts, lambda x: x != "")


def _slug(text: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 16)


def _day(column: str, fmt: str) -> Column:
    return F.try_to_timestamp(F.col(column), F.lit(fmt)).cast("date")


def last_wins(df: DataFrame, key: str) -> DataFrame:
    return top_per_group(df, [key], [F.col("seq").desc()])


def first_wins(df: DataFrame, key: str) -> DataFrame:
    return top_per_group(df, [key], [F.col("seq").asc()])


# ---- United Kingdom --------------------------------------------------------


def uk_company_id(lei: Column, name: Column) -> Column:
    return F.when(F.upper(lei).rlike(LEI), F.concat(F.lit("uk_lei_"), F.upper(lei))).otherwise(F.concat(F.lit("uk_nsm_issuer_"), _slug(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))))


def uk_issuers(hits: DataFrame) -> DataFrame:
    """Issuers and related organisations of disclosure hits, one row each. Names and codes in one
    cell belong together by place."""
    own = hits.select("seq", F.posexplode_outer(F.arrays_zip(_split(F.col("company")).alias("name"), _split(F.col("lei"), upper=True).alias("lei"))).alias("pos", "x"))
    related = hits.select("seq", F.posexplode("related_org").alias("pos", "x")).select("seq", (F.col("pos") + 1000).alias("pos"), F.col("x.company").alias("name"), F.upper("x.lei").alias("lei"))
    rows = own.select("seq", "pos", F.col("x.name").alias("name"), F.col("x.lei").alias("lei")).unionByName(related).where("name is not null")
    rows = rows.withColumn("lei", F.when(F.col("lei").rlike(LEI), F.col("lei"))).withColumn("id", uk_company_id(F.col("lei"), F.col("name")))
    return top_per_group(rows, ["id"], [F.col("seq").asc(), F.col("pos").asc()]).select("id", "name", "lei", F.lit("GB").alias("country_code"), F.array(F.lit("fca_nsm")).alias("sources"))


def uk_filings(hits: DataFrame, type_codes: Sequence[str] | None = None, latest_only: bool = True) -> DataFrame:
    rows = hits.where("latest_flag = 'Y'") if latest_only else top_per_group(hits, ["disclosure_id"], [(F.col("latest_flag") == "Y").desc(), F.col("hist_seq").desc()])
    if type_codes:
        rows = rows.where(F.col("type_code").isin(list(type_codes)))
    name, lei = F.element_at(_split(F.col("company")), 1), F.try_element_at(_split(F.col("lei"), upper=True), F.lit(1))
    return rows.select(
        F.concat(F.lit("uk_nsm_"), "disclosure_id").alias("id"), uk_company_id(F.coalesce(lei, F.lit("")), name).alias("company_id"), F.lit("fca_nsm").alias("source"), F.col("headline").alias("title"),
        F.col("type").alias("category"), F.col("type_code").alias("filing_type"), F.to_timestamp("publication_date").alias("published_at"), F.to_date("publication_date").alias("filing_date"), F.to_date("document_date").alias("period_end"),
        F.col("download_link").alias("document_id"), F.transform(F.coalesce("related_org", F.array().cast("array<struct<company:string,lei:string>>")), lambda r: F.struct(r["company"].alias("name"), r["lei"].alias("lei"))).alias("related_issuers"),
    )


def search_headlines(filings: DataFrame, keyword: str | None, type_codes: Sequence[str] | None = None) -> DataFrame:
    """Filings whose title has the keyword; without one those of the type codes; a blank one finds nothing."""
    out = filings.where(F.col("filing_type").isin(list(type_codes))) if type_codes else filings
    if keyword is None:
        return out
    return out.where(F.contains(fold(F.col("title"), "search"), F.lit(keyword.casefold().strip()))) if keyword.strip() else out.limit(0)


# ---- Japan -----------------------------------------------------------------

# Document types, with category and type.
EDINET_TYPES = {
    "120": ("accounts", "annual"),
    "130": ("accounts", "annual_amendment"),
    "135": ("confirmation", "confirmation"),
    "136": ("confirmation", "confirmation_amendment"),
    "140": ("accounts", "quarterly"),
    "150": ("accounts", "quarterly_amendment"),
    "160": ("accounts", "semiannual"),
    "170": ("accounts", "semiannual_amendment"),
    "180": ("current", "current_report"),
    "190": ("current", "current_report_amendment"),
    "200": ("governance", "parent_company_status"),
    "210": ("governance", "parent_company_status_amendment"),
    "220": ("capital", "share_buyback"),
    "230": ("capital", "share_buyback_amendment"),
    "235": ("internal_control", "internal_control"),
    "236": ("internal_control", "internal_control_amendment"),
}


def edinet_filings(rows: DataFrame) -> DataFrame:
    """Daily document lists; withdrawn, undisclosed and expired ones go; times are Japan's."""
    live = rows.where("coalesce(withdrawalStatus, '0') <> '2' and coalesce(disclosureStatus, '0') <> '2' and coalesce(legalStatus, '1') <> '0'")
    kind = F.create_map(*[x for k, (c, t) in EDINET_TYPES.items() for x in (F.lit(k), F.struct(F.lit(c).alias("category"), F.lit(t).alias("filing_type")))])[F.col("docTypeCode")]
    sent = F.to_utc_timestamp(F.try_to_timestamp("submitDateTime", F.lit("yyyy-MM-dd HH:mm")), "Asia/Tokyo")
    out = live.select(
        F.concat(F.lit("jp_edinet_"), "docID").alias("id"), F.concat(F.lit("jp_"), F.lower("edinetCode")).alias("company_id"), F.lit("edinet").alias("source"), F.col("docDescription").alias("title"), F.coalesce(kind["category"], F.lit("other")).alias("category"),
        F.coalesce(kind["filing_type"], F.col("docTypeCode")).alias("filing_type"), sent.alias("published_at"), F.to_date("submitDateTime").alias("filing_date"), F.try_to_timestamp("periodEnd", F.lit("yyyy-MM-dd")).cast("date").alias("period_end"),
        (F.col("xbrlFlag") == "1").alias("xbrl_available"), (F.col("pdfFlag") == "1").alias("pdf_available"), F.col("docID").alias("document_id"), "seq",
    )
    return last_wins(out, "id").drop("seq")


def edinet_companies(rows: DataFrame) -> DataFrame:
    """The code list: edinet_code, name, english_name, securities_code, address by place."""
    return rows.where(F.col("edinet_code").rlike("^E\\d{5}$")).select(F.concat(F.lit("jp_"), F.lower("edinet_code")).alias("id"), "name", "english_name", F.substring("securities_code", 1, 4).alias("ticker"), F.lit("JP").alias("country_code"), "address", F.array(F.lit("edinet")).alias("sources"))


# ---- Europe ----------------------------------------------------------------


def esef_filings(payloads: DataFrame, country: str) -> DataFrame:
    """JSON:API pages: data joined with included entities; filings without a period, a path or a valid code go."""
    schema = "data array<struct<id:string,attributes:struct<period_end:string,date_added:string,report_url:string,package_url:string,country:string>,relationships:struct<entity:struct<data:struct<id:string>>>>>, included array<struct<id:string,attributes:struct<name:string,identifier:string>>>"
    page = payloads.select(F.from_json("json", schema).alias("p"))
    data = page.select(F.explode("p.data").alias("d"))
    entity = page.select(F.explode("p.included").alias("e")).select(F.col("e.id").alias("entity"), F.col("e.attributes.name").alias("issuer_name"), F.upper("e.attributes.identifier").alias("lei")).dropDuplicates(["entity"])
    rows = data.select("d.id", F.col("d.relationships.entity.data.id").alias("entity"), "d.attributes.*").join(entity, "entity", "left")
    path = F.coalesce("report_url", "package_url")
    rows = rows.where(F.col("period_end").isNotNull() & F.col("date_added").isNotNull() & path.isNotNull() & F.col("lei").rlike(LEI))
    language = F.coalesce(F.element_at(F.regexp_extract_all(F.lower(path), F.lit(r"[-_]([a-z]{2})(?=[-_.])"), 1), -1), F.lit("und"))
    return rows.select(
        F.concat(F.lit(f"{country}_esef_"), "id").alias("id"), F.concat(F.lit(f"{country}_lei_"), "lei").alias("company_id"), F.lit("esef").alias("source"), "issuer_name", F.col("lei").alias("issuer_lei"), F.lit("accounts").alias("category"),
        F.lit("annual_report").alias("filing_type"), F.lit(None).cast("timestamp").alias("published_at"), F.to_date("date_added").alias("filing_date"), F.to_date("period_end").alias("period_end"), path.alias("document_id"), language.alias("language"),
    )


# ---- Brazil ----------------------------------------------------------------


def cvm_companies(rows: DataFrame) -> DataFrame:
    """The registry's companies that are active, listed and operating; the last row of a code stays."""
    same = lambda c, v: fold(F.col(c), "search") == v
    live = rows.where(same("SIT", "ativo") & same("TP_MERC", "bolsa") & same("SIT_EMISSOR", "fase operacional"))
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = live.select(
        F.concat(F.lit("br_cvm_"), F.lpad(F.regexp_replace("CD_CVM", r"\D", ""), 6, "0")).alias("id"), F.col("DENOM_SOCIAL").alias("name"), F.col("DENOM_COMERC").alias("english_name"), F.regexp_replace("CNPJ_CIA", r"\D", "").alias("local_code"),
        F.concat_ws(", ", *[part(F.col(c)) for c in ("LOGRADOURO", "COMPL", "BAIRRO", "MUN", "UF", "PAIS")]).alias("address"), F.lit("BR").alias("country_code"), F.array(F.lit("cvm")).alias("sources"), "seq",
    )
    return last_wins(out, "id").drop("seq")


# Kinds of deliveries that hold accounts, and what they are.
CVM_ACCOUNTS = {
    "demonstracoes financeiras anuais completas": "annual",
    "demonstracoes financeiras intermediarias": "interim",
    "demonstracoes financeiras adicionais": "additional_financial_statements",
}


def _name(column: Column) -> Column:
    """Words of ASCII letters and digits, joined by underscores."""
    words = F.array_join(F.regexp_extract_all(fold(column, "search"), F.lit("[a-z0-9]+"), 0), "_")
    return F.when(words != "", words).otherwise("document")


def cvm_filings(rows: DataFrame, category: str | None = None) -> DataFrame:
    """The delivery index; the last row of a delivery stays. Rows without a code, a sequence number in
    the address, or one of the two dates go. category: accounts are the kinds that hold them, insider
    takes every row as such, any other is compared with the row's own."""
    kind, own = F.trim(F.coalesce("Tipo", F.lit(""))), F.trim(F.coalesce("Categoria", F.lit("")))
    accounts = F.create_map(*[F.lit(x) for pair in CVM_ACCOUNTS.items() for x in pair])[fold(kind, "search")]
    insider = category is not None and category.casefold() == "insider"
    out = rows.withColumn("__accounts", accounts)
    if category and category.casefold() == "accounts":
        out = out.where("__accounts is not null")
    elif category and not insider:
        out = out.where(fold(own, "search") == KINDS["search"](category))
    period, number = _day("Data_Referencia", "yyyy-MM-dd"), F.regexp_extract(F.coalesce("Link_Download", F.lit("")), r"[?&]numSequencia=(\d+)(?:&|$)", 1)
    digits = F.regexp_replace("Codigo_CVM", r"\D", "")
    out = out.withColumn("__number", number).where((F.col("__number") != "") & (digits != "") & period.isNotNull() & _day("Data_Entrega", "yyyy-MM-dd").isNotNull())
    insiders = F.lit("insider" if insider else None).cast("string")
    title = F.concat(F.when(kind != "", kind).otherwise("CVM filing"), F.lit(" for period ended "), period.cast("string"))
    first = F.when(kind != "", kind).when(own != "", own).otherwise("document")
    out = out.select(
        F.concat(F.lit("br_cvm_"), "__number").alias("id"), F.concat(F.lit("br_cvm_"), F.lpad(digits, 6, "0")).alias("company_id"), F.lit("cvm").alias("source"), title.alias("title"),
        F.when(F.col("__accounts").isNotNull(), "accounts").otherwise(F.coalesce(insiders, _name(own))).alias("category"), F.coalesce("__accounts", insiders, _name(first)).alias("filing_type"),
        _day("Data_Entrega", "yyyy-MM-dd").alias("filing_date"), period.alias("period_end"), _day("Data_Entrega", "yyyy-MM-dd").cast("timestamp").alias("published_at"),
        F.nullif(F.trim("Assunto"), F.lit("")).alias("description"), F.col("Link_Download").alias("document_id"), "seq",
    )
    return last_wins(out, "id").drop("seq")


def cvm_major_holders(positions: DataFrame, companies: DataFrame) -> DataFrame:
    """Shareholder positions of registered companies, by digits of their tax number; the last of a holder stays."""
    rows = positions.withColumn("local_code", F.regexp_replace("CNPJ_Companhia", r"\D", "")).join(companies.select("local_code", F.col("id").alias("company_id")), "local_code")
    digits = F.regexp_replace(F.coalesce("CPF_CNPJ_Acionista", F.lit("")), r"\D", "")
    rows = rows.withColumn("holder_key", F.when(digits != "", digits).otherwise(F.col("Acionista")))
    out = top_per_group(rows, ["ID_Documento", "holder_key"], [F.col("seq").desc()])
    number = lambda c: F.expr(f"try_cast(replace({c}, ',', '.') as decimal(38,10))")
    return out.select(F.col("ID_Documento").alias("filing_id"), "company_id", F.col("Acionista").alias("holder_name"), number("Percentual_Total_Acoes_Circulacao").alias("percent"), number("Quantidade_Total_Acoes_Circulacao").alias("shares"), _day("Data_Referencia", "yyyy-MM-dd").alias("position_date"))


# ---- Singapore, Mexico, India ----------------------------------------------


def sgx_companies(stocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Main-board and Catalist stocks with their names; one row for each issuer code, all aliases kept."""
    names = last_wins(metadata, "stockCode").drop("seq")
    rows = stocks.where(F.upper("board").isin("MAINBOARD", "CATALIST") & (F.lower("type") == "stocks")).join(names, "stockCode")
    order = Window.partitionBy("ibmCode").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("aliases", F.array_distinct(F.collect_list("name").over(whole))).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return rows.select(F.concat(F.lit("sg_sgx_"), F.lower("ibmCode")).alias("id"), "name", F.col("stockCode").alias("ticker"), F.lit("SG").alias("country_code"), "aliases", F.array(F.lit("sgx")).alias("sources"))


def sgx_filings(rows: DataFrame, since_year: int) -> DataFrame:
    """Annual reports; times are milliseconds, dates Singapore's."""
    sent = F.timestamp_millis("broadcastDateTime")
    day = F.from_utc_timestamp(sent, "Asia/Singapore").cast("date")
    end = F.from_utc_timestamp(F.timestamp_millis("periodEnd"), "Asia/Singapore").cast("date")
    out = rows.where(F.lower(F.trim("title")) == "annual report")
    out = out.select(F.concat(F.lit("sg_sgx_"), "announcementId").alias("id"), F.concat(F.lit("sg_sgx_"), F.lower("ibmCode")).alias("company_id"), F.lit("sgx").alias("source"), "title", F.lit("accounts").alias("category"), F.lit("annual_report").alias("filing_type"), sent.alias("published_at"), day.alias("filing_date"), end.alias("period_end"))
    return out.where(F.coalesce("period_end", "filing_date") >= F.make_date(F.lit(since_year), F.lit(1), F.lit(1)))


def best_attachment(links: DataFrame) -> DataFrame:
    """filing_id, url of the likeliest report among links (filing_id, url, filename)."""
    name = F.regexp_replace(F.lower("filename"), "[^a-z]", "")
    score = F.when(F.contains(name, F.lit("annualreport")), 10).otherwise(0) - F.when(name.rlike("notice|proxy|circular|letter|appendix"), 100).otherwise(0)
    return links.withColumn("score", score).where("score >= 0").groupBy("filing_id").agg(F.max_by("url", F.struct("score", "filename")).alias("url"))


def bmv_filings(rows: DataFrame) -> DataFrame:
    """Listed documents (issuer, date, text, href): the period comes from the text."""
    text = F.lower("text")
    quarter, year = F.regexp_extract(text, r"(?:trimestre|trim)\D{0,5}([1-4])|([1-4])\D{0,3}(?:trimestre|trim|t)", 0), F.regexp_extract(text, r"\b(20\d{2})\b", 1).try_cast("int")
    month = F.regexp_extract(quarter, r"([1-4])", 1).try_cast("int") * 3
    end = F.when(F.contains(text, F.lit("informe anual")) & year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31))).when(month.isNotNull() & year.isNotNull(), F.last_day(F.make_date(year, month, F.lit(1))))
    return rows.select(F.concat(F.lit("mx_bmv_"), _slug(F.col("href"))).alias("id"), F.concat(F.lit("mx_bmv_"), F.lower("issuer")).alias("company_id"), F.lit("bmv").alias("source"), F.col("text").alias("title"), F.to_date("date").alias("filing_date"), end.alias("period_end"), F.col("href").alias("document_id"))


def nse_companies(rows: DataFrame) -> DataFrame:
    """Equities of the listing; headers may begin with blanks."""
    rows = rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])
    return rows.where(F.col("ISIN NUMBER").startswith("INE") & F.trim("SERIES").isin("EQ", "BE", "BZ")).select(F.concat(F.lit("in_nse_"), F.lower("SYMBOL")).alias("id"), F.col("NAME OF COMPANY").alias("name"), F.col("SYMBOL").alias("ticker"), F.lit("IN").alias("country_code"), F.array(F.lit("nse")).alias("sources"))


def nse_filings(accounts: DataFrame, insider: DataFrame, holdings: DataFrame) -> DataFrame:
    """Three feeds (symbol, id, title, timestamp string, end_date date, href) as one."""
    out = None
    for category, df in (("accounts", accounts), ("insider", insider), ("major_holdings", holdings)):
        sent = F.coalesce(F.try_to_timestamp("timestamp", F.lit("dd-MMM-yyyy HH:mm:ss")), F.try_to_timestamp("timestamp", F.lit("dd-MMM-yyyy HH:mm")))
        # Of a fiscal year (April to March) without a time of filing: 1 August of its end.
        day = F.coalesce(sent.cast("date"), F.when(F.col("end_date").isNotNull(), F.make_date(F.year("end_date"), F.lit(8), F.lit(1))))
        own = df.select(F.concat(F.lit("in_nse_"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("in_nse_"), F.lower("symbol")).alias("company_id"), F.lit("nse").alias("source"), F.lit(category).alias("category"), "title", sent.alias("published_at"), day.alias("filing_date"), F.col("end_date").alias("period_end"), F.col("href").alias("document_id"))
        out = own if out is None else out.unionByName(own)
    return out


def nse_best_xbrl(rows: DataFrame) -> DataFrame:
    """Of each symbol and period the consolidated, then audited, then first of original and revised rows."""
    live = rows.where(F.lower("type").isin("original", "revision"))
    return top_per_group(live, ["symbol", "qe_date"], [(F.lower("consolidated") == "consolidated").desc(), (F.lower("audited") == "audited").desc(), F.col("seq").asc()])


# ---- Canada, Peru, Colombia, Korea, Australia, Turkey ----------------------

FUNDS = r"(?i)\b(?:etf|fund|trust|split corp)\b"


def sedar_companies(tsx: DataFrame, venture: DataFrame) -> DataFrame:
    """Issuers of both boards (symbol, name), without funds."""
    rows = tsx.withColumn("market", F.lit("TSX")).unionByName(venture.withColumn("market", F.lit("TSXV"))).where(~F.col("name").rlike(FUNDS))
    return rows.select(F.concat(F.lit("ca_sedar_"), F.lower("symbol")).alias("id"), "name", F.col("symbol").alias("ticker"), "market", F.lit("CA").alias("country_code"), F.array(F.lit("sedar")).alias("sources"))


def sedar_import(company_id: str, documents: DataFrame) -> DataFrame:
    """Filings of documents that a user brings: title, filing_date, period_end, filing_type, category, source_url, content."""
    digest = F.sha2("content", 256)
    return documents.select(F.concat(F.lit("ca_sedar_"), F.substring(F.sha2(F.concat(F.lit(f"{company_id}:"), digest), 256), 1, 24)).alias("id"), F.lit(company_id).alias("company_id"), F.lit("sedar").alias("source"), "title", "filing_date", "period_end", "filing_type", "category", "source_url", digest.alias("sha256"))


def smv_filings(rows: DataFrame) -> DataFrame:
    """Companies by year (rpj, name, year): one consolidated and one separate report, filed by the next 30 April."""
    both = rows.select("rpj", "name", "year", F.explode(F.array(F.lit("C"), F.lit("I"))).alias("kind"))
    return both.select(F.concat_ws("_", F.lit("pe_smv"), "rpj", F.col("year").cast("string"), F.lower("kind")).alias("id"), F.concat(F.lit("pe_smv_"), F.lower("rpj")).alias("company_id"), F.lit("smv").alias("source"), F.lit("accounts").alias("category"), F.make_date(F.col("year") + 1, F.lit(4), F.lit(30)).alias("filing_date"), F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"))


def smv_companies(rows: DataFrame) -> DataFrame:
    """The newest year's name of each company."""
    return top_per_group(rows, ["rpj"], [F.col("year").desc()]).select(F.concat(F.lit("pe_smv_"), F.lower("rpj")).alias("id"), "name", F.lit("PE").alias("country_code"), F.array(F.lit("smv")).alias("sources"))


def sfc_filings(rows: DataFrame) -> DataFrame:
    """Listed documents (nit, title, date, href): financial statements in PDF."""
    low = F.lower("title")
    live = rows.where(F.lower("href").rlike(r"\.pdf") & low.rlike("estados? financieros?|informe|balance"))
    year = F.regexp_extract("title", r"\b(20\d{2})\b", 1).try_cast("int")
    return live.select(F.concat(F.lit("co_sfc_"), _slug(F.col("href"))).alias("id"), F.concat(F.lit("co_sfc_"), "nit").alias("company_id"), F.lit("sfc").alias("source"), "title", F.when(F.contains(low, F.lit("trimestral")), "quarterly_report").otherwise("annual_report").alias("filing_type"), F.to_date("date").alias("filing_date"), F.when(year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31))).alias("period_end"), F.col("href").alias("document_id"))


def dart_companies(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim(F.coalesce("stock_code", F.lit(""))) != "").select(F.concat(F.lit("kr_dart_"), "corp_code").alias("id"), F.col("corp_name").alias("name"), F.trim("stock_code").alias("ticker"), F.lit("KR").alias("country_code"), F.array(F.lit("dart")).alias("sources"))


def dart_filings(rows: DataFrame) -> DataFrame:
    """Reports by their names: annual, half-year, quarterly; `(2024.12)` is the period."""
    name = F.col("report_nm")
    kind = F.when(F.contains(name, F.lit("사업보고서")), "annual_report").when(F.contains(name, F.lit("반기보고서")), "semiannual_report").when(F.contains(name, F.lit("분기보고서")), "quarterly_report")
    period = F.try_to_timestamp(F.concat(F.regexp_extract(name, r"\((\d{4}\.\d{2})\)", 1), F.lit(".01")), F.lit("yyyy.MM.dd")).cast("date")
    return rows.select(F.concat(F.lit("kr_dart_"), "rcept_no").alias("id"), F.concat(F.lit("kr_dart_"), "corp_code").alias("company_id"), F.lit("dart").alias("source"), name.alias("title"), kind.alias("filing_type"), F.lit("accounts").alias("category"), _day("rcept_dt", "yyyyMMdd").alias("filing_date"), F.last_day(period).alias("period_end")).where("filing_type is not null")


def asx_companies(lines: DataFrame) -> DataFrame:
    """Rows of the listing (pos, a, b, c), which has its header anywhere at its top."""
    header = lines.where(F.lower("a").rlike("company name|asx code") & F.lower("b").rlike("asx code|company name|gics")).agg(F.min("pos").alias("head"))
    rows = lines.crossJoin(F.broadcast(header)).where(F.col("pos") > F.coalesce("head", F.lit(-1)))  # one row: where the header is
    return rows.where(F.trim("b").rlike("^[A-Z0-9]{2,6}$")).select(F.concat(F.lit("au_asx_"), F.lower(F.trim("b"))).alias("id"), F.trim("a").alias("name"), F.trim("b").alias("ticker"), F.col("c").alias("company_type"), F.lit("AU").alias("country_code"), F.array(F.lit("asx")).alias("sources"))


def kap_filings(rows: DataFrame, categories: Sequence[str] = ("FR", "ODA", "DG", "CA")) -> DataFrame:
    """Disclosures of the four classes or none; the last row of an index stays."""
    live = rows.where(F.col("disclosureClass").isNull() | F.col("disclosureClass").isin(list(categories)))
    out = live.select(F.concat(F.lit("tr_kap_"), F.col("disclosureIndex").cast("string")).alias("id"), F.concat(F.lit("tr_kap_"), "companyOid").alias("company_id"), F.lit("kap").alias("source"), F.concat_ws(" - ", "kapTitle", "subject").alias("title"), F.when(F.col("disclosureClass") == "FR", "accounts").otherwise("disclosure").alias("category"), F.col("disclosureType").alias("filing_type"), F.try_to_timestamp("publishDate", F.lit("dd.MM.yyyy HH:mm:ss")).alias("published_at"), F.try_to_timestamp("publishDate", F.lit("dd.MM.yyyy HH:mm:ss")).cast("date").alias("filing_date"), "seq")
    return last_wins(out, "id").drop("seq")


def merge_sources(found: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Results of several sources in their order, each row with its source's place."""
    out = None
    for pos, (_, df) in enumerate(found):
        own = df.withColumn("source_pos", F.lit(pos))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
