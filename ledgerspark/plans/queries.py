"""The registered queries on the star schema, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import derive, documents, search, storage, views, windows
from ..streaming import streams
from ..tables import FACT_TIES, companies, facts, filings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FACTS = """facts as (select l_orderkey filing_id, o_custkey company_id, cast(o_orderdate as date) reported_at, l_returnflag statement_type, l_returnflag || l_linestatus code,
 cast(l_shipdate as date) end_date, l_extendedprice value, l_linestatus provenance, l_quantity confidence, l_discount decimals, l_linenumber seq, l_partkey part, l_suppkey supplier, l_tax tax
 from lineitem join orders on l_orderkey = o_orderkey)"""
FILINGS = "filings as (select o_orderkey id, o_custkey company_id, cast(o_orderdate as date) filing_date, o_orderpriority category, o_orderstatus filing_type, o_totalprice amount from orders)"
COMPANIES = "companies as (select c_custkey id, c_name as name, n_name market, r_name country_code, c_mktsegment company_type from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
TIES = ", ".join(FACT_TIES)
FACT_OUT = ["filing_id", "company_id", "reported_at", "statement_type", "code", "end_date", "value", "provenance", "seq", "part", "supplier"]
OUT = ", ".join(FACT_OUT)
LATEST = f"row_number() over (partition by company_id, statement_type, code, end_date order by reported_at desc, filing_id desc, {TIES})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- history and facts -----------------------------------------------------


@query(f"with {FACTS} select {OUT} from (select *, {LATEST} r from facts) where r = 1")
def historical_latest_restated(spark, d):
    return windows.fact_history(facts(spark, d), "latest_restated", ties=FACT_TIES).select(FACT_OUT)


@query(f"with {FACTS} select {OUT} from (select *, {LATEST} r from facts where reported_at <= date '1998-06-30') where r = 1")
def historical_as_of(spark, d):
    return windows.fact_history(facts(spark, d), "as_of", as_of="1998-06-30", ties=FACT_TIES).select(FACT_OUT)


@query(f"with {FACTS} select {OUT} from facts where code in ('AF', 'NO') and reported_at <= date '1999-12-31'")
def historical_as_reported(spark, d):
    return windows.fact_history(facts(spark, d).where("reported_at <= date'1999-12-31'"), "as_reported", codes=["AF", "NO"], ties=FACT_TIES).select(FACT_OUT)


@query(f"with {FACTS} select {OUT} from (select *, row_number() over (partition by company_id, statement_type, code order by end_date desc, reported_at desc, filing_id desc, {TIES}) r from facts) where r <= 4")
def financials_query_topk(spark, d):
    return windows.newest_values(facts(spark, d), 4, FACT_TIES).select(FACT_OUT)


@query(f"with {FACTS} select {OUT} from (select *, dense_rank() over (partition by filing_id, statement_type order by end_date desc) r from facts) where r <= 2")
def statement_newest_labels(spark, d):
    return windows.newest_labels(facts(spark, d), 2).select(FACT_OUT)


@query(f"with {FACTS}, ranked as (select *, dense_rank() over (partition by company_id order by reported_at desc, filing_id desc) f from facts) select {OUT} from (select *, row_number() over (partition by company_id, statement_type, code, end_date order by f, {TIES}) r from ranked where f <= 8) where r = 1")
def company_facts_merge(spark, d):
    return windows.merge_company_facts(facts(spark, d), 8, FACT_TIES).select(FACT_OUT)


@query(f"with {FACTS} select {OUT} from (select *, row_number() over (partition by company_id, statement_type, code order by end_date desc, reported_at desc, filing_id desc, {TIES}) r from facts where company_id in (3, 7, 11, 19) and code = 'NO') where r <= 4")
def companies_compare(spark, d):
    return windows.compare_companies(facts(spark, d), [3, 7, 11, 19], "NO", 4, FACT_TIES).select(FACT_OUT)


def _as_tagged(df: DataFrame) -> DataFrame:
    """Facts with dimensions (of discounted rows) and part as concept, for the choice of concepts and precision."""
    axis = F.struct(F.lit("discount").alias("axis"), F.col("decimals").cast("string").alias("member"))
    return df.withColumn("concept", F.pmod(F.col("part"), F.lit(7)).cast("string")).withColumn("dimensions", F.when(F.col("decimals") > 0, F.array(axis)).otherwise(F.array().cast("array<struct<axis:string,member:string>>"))).withColumn("standard", (F.pmod("part", F.lit(2)) == 0).cast("int")).withColumn("alias_rank", F.pmod("part", F.lit(5))).withColumn("seq", F.col("seq") * 1000000 + F.col("part") * 100 + F.col("supplier") % 100)


TAGGED = f"{FACTS}, tagged as (select * exclude (seq), cast(part % 7 as varchar) concept, decimals > 0 dim, cast(part % 2 = 0 as int) standard, part % 5 alias_rank, seq * 1000000 + part * 100 + supplier % 100 seq from facts)"


@query(f"""with {TAGGED}, scored as (select filing_id, statement_type, code, concept, count(*) filter (not dim) plain, count(distinct end_date) periods, max(standard) standard, count(*) n, min(alias_rank) alias_rank, min(seq) first_seq from tagged group by all)
select filing_id, statement_type, code, concept, plain, n from (select *, row_number() over (partition by filing_id, statement_type, code order by plain desc, periods desc, standard desc, n desc, alias_rank, first_seq) r from scored) where r = 1""")
def best_concept(spark, d):
    best = windows.best_concepts(_as_tagged(facts(spark, d)))
    return best.groupBy("filing_id", "statement_type", "code", "concept").agg(F.count_if(F.size("dimensions") <= 0).alias("plain"), F.count("*").alias("n"))


@query(f"""with {TAGGED}, pool as (select *, bool_or(not dim) over (partition by filing_id, code, concept) any_plain from tagged)
select filing_id, code, concept, end_date, value, seq from (select *, row_number() over (partition by filing_id, code, concept, end_date, case when dim then decimals end, provenance order by confidence desc, seq) r from pool where not any_plain or not dim) where r = 1""")
def most_precise_fact(spark, d):
    tagged = _as_tagged(facts(spark, d)).withColumn("unit", F.col("provenance")).withColumn("decimals", F.col("confidence").cast("int").cast("string"))
    return windows.most_precise(tagged).select("filing_id", "code", "concept", "end_date", "value", "seq")


@query(f"""with {FACTS}, s as (select filing_id, statement_type, code, min(value) as value, count(*) n from facts group by all),
l as (select * exclude (filing_id), filing_id - 1 k from s where filing_id % 2 = 1), r as (select * exclude (filing_id), filing_id k from s where filing_id % 2 = 0)
select coalesce(l.k, r.k) filing_id, coalesce(l.code, r.code) code, r.value old_value, l.value new_value, r.n old_n, l.n new_n from l full join r on l.k = r.k and l.code = r.code and l.statement_type = r.statement_type
where (l.value is distinct from r.value) or (l.n is distinct from r.n)""")
def filings_diff(spark, d):
    """Every filing of odd number against the one before it."""
    s = facts(spark, d).groupBy("filing_id", "statement_type", "code").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    odd = s.where("filing_id % 2 = 1").withColumn("filing_id", F.col("filing_id") - 1)
    out = windows.diff_filings(s.where("filing_id % 2 = 0"), odd, ["filing_id", "statement_type", "code"], ["value", "n"])
    return out.select("filing_id", "code", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"), F.col("old.n").alias("old_n"), F.col("new.n").alias("new_n"))


@query(f"with {FACTS} select company_id, sum(case when code = 'AF' then cast(value as decimal(18,2)) end)::double af, sum(case when code = 'NO' then cast(value as decimal(18,2)) end)::double no, sum(case when code = 'RF' then cast(value as decimal(18,2)) end)::double rf from facts group by company_id")
def statement_pivot(spark, d):
    out = facts(spark, d).groupBy("company_id").pivot("code", ["AF", "NO", "RF"]).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"))
    return out.toDF("company_id", "af", "no", "rf")


# ---- derivation and audits -------------------------------------------------

SHEET = f"""{FACTS}, sheet as (select filing_id, sum(cast(value as decimal(18,2))) filter (code = 'AF') a, sum(cast(value as decimal(18,2))) filter (code = 'NO') b, sum(cast(value as decimal(18,2))) filter (code = 'RF') c from facts group by 1)"""


def _sheet(spark, d) -> DataFrame:
    """Balance-sheet items of each order: sums by code stand for current, noncurrent and equity."""
    names = F.create_map(*[F.lit(x) for k, v in {"AF": "current_assets", "NO": "noncurrent_assets", "RF": "total_equity"}.items() for x in (k, v)])
    rows = facts(spark, d).where(F.col("code").isin("AF", "NO", "RF")).groupBy("filing_id", "code").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,10)").alias("value"), F.max(F.col("confidence").cast("int")).alias("confidence"))
    return rows.select("filing_id", names[F.col("code")].alias("code"), "value", "confidence", F.lit(None).cast("date").alias("start_date"), F.lit("2000-12-31").cast("date").alias("end_date"), F.lit("instant").alias("kind"), F.lit("USD").alias("unit"), F.lit("tagged_xbrl").alias("provenance"), F.array().cast("array<struct<axis:string,member:string>>").alias("dimensions"))


@query(f"with {SHEET} select filing_id, 'total_assets' code, (a + b)::double as value from sheet where a is not null and b is not null union all select filing_id, 'total_liabilities', (a + b - c)::double from sheet where a is not null and b is not null and c is not null")
def derive_totals(spark, d):
    return derive.derive_totals(_sheet(spark, d)).where("provenance = 'derived'").select("filing_id", "code", F.col("value").cast("double").alias("value"))


@query(f"""with {SHEET} select filing_id, 'FOOT.bs.total_assets' as rule, a::double as total, (b + c)::double as parts, case when abs(a::double - (b + c)::double) <= 0.25 * abs(a::double) then 'held' else 'gap' end status from sheet where a is not null and b is not null and c is not null""")
def identity_audit(spark, d):
    """Does the first code equal the sum of the other two, to a quarter?"""
    other = {"current_assets": "total_assets", "noncurrent_assets": "current_assets", "total_equity": "noncurrent_assets"}
    renamed = F.create_map(*[F.lit(x) for k, v in other.items() for x in (k, v)])
    rows = derive.audit(_sheet(spark, d).withColumn("code", renamed[F.col("code")]), tolerance=0.25)
    return rows.where("rule = 'FOOT.bs.total_assets' and status <> 'not_applicable'").select("filing_id", "rule", F.col("left").alias("total"), F.col("right").alias("parts"), "status")


@query(f"with {FACTS} select provenance, count(*) n, min(confidence) min_confidence, max(confidence) max_confidence from facts group by 1")
def provenance_histogram(spark, d):
    return derive.provenance_histogram(facts(spark, d))


@query(f"with {FACTS}, k as (select filing_id, statement_type, case when supplier % 3 = 0 then 'USD' when supplier % 3 = 1 then 'EUR' else 'GBP' end currency, count(*) n, min(seq::bigint * 1000000000 + part * 10000 + supplier) first_seq from facts group by all) select filing_id, statement_type, currency from (select *, row_number() over (partition by filing_id, statement_type order by n desc, first_seq) r from k) where r = 1")
def currency_mode(spark, d):
    unit = F.element_at(F.array(F.lit("iso4217:USD"), F.lit("EUR"), F.lit("gbp")), (F.col("supplier") % 3 + 1).cast("int"))
    return derive.statement_currency(facts(spark, d).withColumn("unit", unit).withColumn("seq", F.col("seq").cast("long") * 1000000000 + F.col("part") * 10000 + F.col("supplier")))


# ---- filings and companies -------------------------------------------------


@query(f"with {FILINGS} select id, company_id, filing_date, category, filing_type, amount from (select *, row_number() over (partition by company_id order by filing_date desc, id desc) r from filings) where r <= 3")
def newest_n_filings(spark, d):
    return windows.newest_filings(filings(spark, d), 3).select("id", "company_id", "filing_date", "category", "filing_type", "amount")


@query(f"with {FILINGS} select company_id, arg_max(id, (filing_date, id)) id, max(filing_date) filing_date from filings group by 1")
def latest_filing(spark, d):
    return windows.newest_filings(filings(spark, d), 1).select("company_id", "id", "filing_date")


@query(f"with {FILINGS} select id, company_id, filing_date, category, filing_type, amount from filings where lower(filing_type) in ('f', 'p') and lower(category) = '1-urgent' and filing_date between date '1996-01-01' and date '1998-12-31'")
def filter_filings(spark, d):
    return windows.filter_filings(filings(spark, d), types=["f", "P"], category="1-Urgent", date_from="1996-01-01", date_to="1998-12-31").select("id", "company_id", "filing_date", "category", "filing_type", "amount")


@query(f"with {FILINGS} select id, company_id, filing_date from (select *, row_number() over (partition by company_id order by filing_date desc, id desc) r from filings) where r <= 50 and filing_date >= date '2001-01-01'")
def watchlist_since(spark, d):
    return windows.watchlist(filings(spark, d), "2001-01-01").select("id", "company_id", "filing_date")


@query("""with recursive f as (select o_orderkey id, o_custkey c, o_orderdate::date d, floor(o_totalprice / 50000)::bigint u, o_orderdate::date::varchar || o_orderpriority t, row_number() over (partition by o_custkey order by o_orderkey) n from orders),
g as (select c, n, id, d, true k, [u] us, [t] ts from f where n = 1 union all
select f.c, f.n, f.id, f.d, not list_contains(us, u) and not list_contains(ts, t), case when list_contains(us, u) or list_contains(ts, t) then us else list_append(us, u) end, case when list_contains(us, u) or list_contains(ts, t) then ts else list_append(ts, t) end from g join f on f.c = g.c and f.n = g.n + 1)
select id, c company_id, d filing_date from g where k""")
def greedy_filing_dedupe(spark, d):
    """Sequential within a company."""
    rows = filings(spark, d).select("id", "company_id", "filing_date", F.col("category").alias("title"), F.col("id").alias("seq"), F.concat(F.lit("u"), F.floor(F.col("amount") / 50000)).alias("source_url"))
    return windows.greedy_filings(rows).select("id", "company_id", "filing_date")


@query("select p_partkey id, p_name as name, case when lower(p_name) = 'red' or lower(p_brand) = 'red' then 0 when lower(p_name) like 'red%' or lower(p_brand) like 'red%' then 1 else 2 end match_rank from part where lower(p_name) like '%red%' or lower(p_brand) like '%red%'")
def company_rank_three_tier(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("ticker"))
    return search.three_tiers(parts, "Red", ["name", "ticker"], "name").select("id", "name", "match_rank")


@query("select p_partkey id, p_name as name, case when lower(p_brand) = 'brand#1' then 0 when lower(p_name) like 'brand#1%' then 1 else 2 end match_rank from part where lower(p_brand) like '%brand#1%' or lower(p_name) like '%brand#1%'")
def company_rank_id_or_name(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("ticker"))
    return search.id_or_name(parts, "BRAND#1", ["ticker"], ["name"]).select("id", "name", "match_rank")


@query("select p_partkey id, case when lower(p_brand) = 'brand#2' then 0 else 1 end match_rank from part where lower(p_brand) like '%brand#2%' or lower(p_type) like '%brand#2%'")
def company_rank_offline(spark, d):
    return search.two_tiers(table(spark, d, "part"), "Brand#2", ["p_brand", "p_type"]).select(F.col("p_partkey").alias("id"), "match_rank")


@query("select p_partkey id, p_brand from part where lower(p_brand) = 'brand#17' order by p_partkey limit 1")
def find_company(spark, d):
    return search.find_first(table(spark, d, "part"), "BRAND#17", ["p_name", "p_brand"], "p_partkey").select(F.col("p_partkey").alias("id"), "p_brand")


@query(f"with {COMPANIES} select id, name, market, country_code from companies where lower(market) = 'nation_3' or false")
def filter_companies(spark, d):
    return search.filter_companies(companies(spark, d), market="Nation_3").select("id", "name", "market", "country_code")


@query("""with p as (select p_partkey seq, p_type market, p_name as name, p_brand src, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) k from part)
select market, k merge_key, arg_min(name, seq) as name, count(*) records, count(distinct src) n_sources, min(seq) seq from p group by market, k""")
def merge_companies(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("market"), F.col("p_name").alias("name"), F.array("p_brand").alias("sources"), F.lit(None).cast("string").alias("lei"))
    out = search.merge_companies(parts)
    return out.select("market", F.substring_index("merge_key", ":", -1).alias("merge_key"), "name", "records", F.size("sources").cast("long").alias("n_sources"), "seq")


@query("select s_suppkey, n_name market, s_name holder_name from supplier join nation on s_nationkey = n_nationkey where contains(lower(s_name), '00001') order by s_suppkey desc limit 25")
def holder_search(spark, d):
    """The 25 newest positions of holders by name."""
    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("s_suppkey").alias("filing_id"), F.col("n_name").alias("market"), F.col("s_name").alias("holder_name"), *[F.lit(None).cast("date").alias(c) for c in ("position_date", "notified_date", "crossed_date")])
    return windows.holders(rows, "00001", 25).select(F.col("filing_id").alias("s_suppkey"), "market", "holder_name")


@query(f"with {FILINGS}, {COMPANIES} select c.country_code, c.market, f.filing_type, count(*) n_filings, count(distinct f.company_id) n_companies from filings f join companies c on c.id = f.company_id group by rollup (c.country_code, c.market, f.filing_type)")
def coverage_rollup(spark, d):
    joined = filings(spark, d).withColumnRenamed("id", "filing").join(companies(spark, d), F.col("company_id") == F.col("id"))
    return joined.rollup("country_code", "market", "filing_type").agg(F.count("*").alias("n_filings"), F.count_distinct("company_id").alias("n_companies"))


# ---- documents -------------------------------------------------------------

SCORE = r"""d as (select doc_id, text, length(regexp_replace(text, '\s', '', 'g')) n, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) a, length(text) - length(replace(text, '�', '')) u,
 len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) lines from documents),
q as (select doc_id, case when n = 0 then 0 else greatest(0, least(100, 100 - case when n < 80 then 60 when n < 300 then 25 else 0 end - case when a / n < 0.35 then 30 when a / n < 0.5 then 15 else 0 end
 - case when u / n > 0.01 then 30 when u / n > 0.001 then 10 else 0 end - case when n > 500 and lines <= 2 then 20 else 0 end)) end score from d)"""


@query(f"with {SCORE} select doc_id, score, case when score >= 70 then 'good' when score >= 35 then 'degraded' else 'unusable' end status from q")
def quality_score(spark, d):
    scored = table(spark, d, "documents").select("doc_id", documents.quality_score(F.col("text")).alias("score"))
    return scored.withColumn("status", documents.quality_status(F.col("score")))


@query(f"with {SCORE} select case when score >= 70 then 'good' when score >= 35 then 'degraded' else 'unusable' end status, count(*) n from q group by 1")
def quality_status_counts(spark, d):
    return quality_score(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("select sha256(text) sha256, min(doc_id) doc_id, count(*) copies from documents group by 1")
def content_hash_dedupe(spark, d):
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    kept = storage.first_by_hash(rows.withColumnRenamed("doc_id", "filing_id")).withColumnRenamed("filing_id", "doc_id")
    return kept.join(rows.groupBy("sha256").agg(F.count("*").alias("copies")), "sha256").select("sha256", "doc_id", "copies")


@query(r"select lang, sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) n_tokens, max(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) longest from documents group by 1")
def token_stats(spark, d):
    n = F.size(documents.tokens(F.col("text"))).cast("long")
    return table(spark, d, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


@query(r"""with t as (select doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents), c as (select *, len(w) n, len(list_filter(w, lambda x: x = 'license')) f1, len(list_filter(w, lambda x: x = 'the')) f2 from t),
g as (select lang, count(*) total, avg(n) mean, count(*) filter (f1 > 0) d1, count(*) filter (f2 > 0) d2 from c group by 1)
select doc_id, lang, round(case when f1 > 0 then ln(1 + (total - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.5 / (f1 + 1.5 * (0.25 + 0.75 * n / mean)) else 0 end + case when f2 > 0 then ln(1 + (total - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.5 / (f2 + 1.5 * (0.25 + 0.75 * n / mean)) else 0 end, 4) score
from c join g using (lang) where f1 + f2 > 0""")
def bm25_search(spark, d):
    """Every document that holds a term, ranked among those of its language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return documents.bm25(docs, "the License", ["lang"], ["doc_id", "lang"], "text").withColumn("score", F.round("score", 4))


@query("select doc_id, substr(text, 201, 400) part, case when length(text) > 600 then 600 end next_offset from documents")
def text_window(spark, d):
    part, after = documents.text_window(F.col("text"), 200, 400)
    return table(spark, d, "documents").select("doc_id", part.alias("part"), after.alias("next_offset"))


@query("""with c as (select doc_id, text, length(text) n, greatest(0, least(greatest(0, coalesce(nullif(instr(lower(text), 'license'), 0), 1) - 1 - 80), length(text) - 240)) s from documents),
b as (select *, case when s > 0 then '…' || substr(text, s + 2, 239) else substr(text, s + 1, 240) end body from c)
select doc_id, case when n <= 240 then text when s + 240 < n then substr(body, 1, 239) || '…' else body end excerpt from b""")
def query_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", documents.excerpt(F.col("text"), "license", 240).alias("excerpt"))


@query()
def html_visible_text(spark, d):
    """Rows only: pages as Markdown."""
    from ..sources.html import markdown_column

    return table(spark, d, "pages").select("page_id", markdown_column(F.col("html")).alias("markdown"))


# ---- storage ---------------------------------------------------------------


@query("select doc_id, kept_bytes from (select doc_id, sum(n_chars) over (order by doc_id rows between current row and unbounded following) kept_bytes from documents) where kept_bytes > 100000")
def prune_to_budget(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return storage.evict_to_budget(rows, 100000, "n_chars", ["doc_id"]).select("doc_id", "kept_bytes")


@query("select 'documents' table_name, count(*) n_rows, coalesce(sum(strlen(text)), 0)::bigint n_bytes from documents union all select 'pages', count(*), coalesce(sum(strlen(html)), 0)::bigint from pages union all select 'filings', count(*), 0 from orders")
def cache_stats(spark, d):
    return storage.stats(documents=(table(spark, d, "documents"), F.octet_length("text")), pages=(table(spark, d, "pages"), F.octet_length("html")), filings=(table(spark, d, "orders"), None))


@query(f"with {COMPANIES} select id, name from companies where country_code not in ('ASIA', 'EUROPE', 'REGION_0', 'REGION_1') or market not in (select n_name from nation where n_nationkey < 20)")
def orphan_cleanup(spark, d):
    names = table(spark, d, "nation").where("n_nationkey < 20").select("n_name")  # a bounded dimension
    more = spark.createDataFrame([("ASIA",), ("EUROPE",), ("REGION_0",), ("REGION_1",)], "n_name string")
    return storage.orphans(companies(spark, d), names.unionAll(more)).select("id", "name")


@query("select distinct o_custkey company_id, o_orderpriority category, cast(o_orderdate as date) filing_date from orders where o_orderstatus = 'F' except select o_custkey, o_orderpriority, cast(o_orderdate as date) from orders where o_orderstatus = 'O'")
def insert_ignore_new_rows(spark, d):
    keys = ["company_id", "category", "filing_date"]
    rows = filings(spark, d)
    return storage.insert_ignore(rows.where("filing_type = 'O'").select(keys), rows.where("filing_type = 'F'").select(keys), keys)


@query("""with n as (select o_custkey id, o_orderkey seq, o_totalprice amount, row_number() over (partition by o_custkey order by o_orderkey desc) r from orders where o_orderstatus = 'P')
select id, amount from n where r = 1 union all select c_custkey, c_acctbal from customer where c_custkey not in (select id from n)""")
def upsert_latest(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("seq"), F.col("c_acctbal").alias("amount"))
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"))
    return storage.upsert(old, new, ["id"]).select("id", "amount")


# ---- scalars ---------------------------------------------------------------


@query("""with x as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(o_orderdate as date) s, cast(l_shipdate as date) e, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) n from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when n between 75 and 105 then 'Q' when n between 170 and 200 then 'H1' when n between 250 and 290 then '9M' when n between 300 and 380 then 'FY' end tagged,
case when n + 1 between 75 and 105 then 'Q' when n + 1 between 170 and 200 then 'H1' when n + 1 between 250 and 290 then '9M' when n + 1 between 300 and 380 then 'FY' else 'YTD' end pdf from x""")
def fiscal_period_bucket(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", dates.fiscal_period(start, end, "tagged").alias("tagged"), dates.fiscal_period(start, end, "pdf").alias("pdf"))


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) as double) * case when l_linestatus = 'F' then -1 else 1 end as value from lineitem")
def pdf_number_parse(spark, d):
    """Prices written as a statement would print them, and read again."""
    rows = table(spark, d, "lineitem")
    text = F.format_number("l_extendedprice", 2)
    printed = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", numbers.parse_number(printed).cast("double").alias("value"))


@query("select p_partkey, case when p_type = 'ECONOMY' then 1e6 when p_type = 'STANDARD' then 1e3 when p_type = 'PROMO' then 1e9 else 1 end::double scale from part")
def scale_detect(spark, d):
    heading = F.when(F.col("p_type") == "ECONOMY", "Amounts in € millions").when(F.col("p_type") == "STANDARD", "(in thousands of euros)").when(F.col("p_type") == "PROMO", "US$ billion").otherwise("in euros")
    return table(spark, d, "part").select("p_partkey", numbers.scale_of(heading).cast("double").alias("scale"))


@query("select event_type, cast(json_extract(props, '$.k') as bigint) // 10 bucket, count(*) n from events group by all")
def json_props_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_type", F.floor(k / 10).alias("bucket")).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


# ---- windows of time (the batch form of the streams) -----------------------


@query('select cast(ts as date) as "day", event_type, count(*) n from events group by all')
def daily_window(spark, d):
    out = streams.windowed_counts(streams.events(table(spark, d, "events")), "1 day")
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


@query('select "day", event_type, count(*) n from (select cast(ts as date) - k as "day", event_type from events, (values (0), (1)) v(k)) group by all')
def sliding_window(spark, d):
    out = streams.windowed_counts(streams.events(table(spark, d, "events")), "2 days", "1 day")
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts > lag(ts) over w + interval 30 minutes or lag(ts) over w is null then 1 else 0 end is_new from events window w as (partition by user_id order by ts)),
s as (select *, sum(is_new) over (partition by user_id order by ts rows unbounded preceding) session from g)
select user_id, count(*) n, min(ts) first_ts from s group by user_id, session""")
def session_window(spark, d):
    out = streams.bursts(streams.events(table(spark, d, "events")), "30 minutes")
    return out.select("user_id", "n", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"))


# ---- views, counts and briefs ----------------------------------------------


@query(f"""with {FACTS}, i as (select *, row_number() over (partition by filing_id, statement_type order by f, code) r from (select filing_id, statement_type, code, min(seq) f from facts group by all)),
s as (select *, row_number() over (partition by filing_id, statement_type, code order by end_date desc, {TIES}) r from facts where statement_type in ('A', 'R'))
select s.filing_id, s.statement_type, s.code, s.end_date, s.value from s join i on i.filing_id = s.filing_id and i.statement_type = s.statement_type and i.code = s.code and i.r <= 1 where s.r <= 2""")
def statement_view(spark, d):
    """The first item of two statements of each filing, in its two newest periods."""
    return views.statement_view(facts(spark, d), ["A", "R"], periods=2, detail="minimal", max_line_items=1, ties=FACT_TIES, valid=("A", "N", "R"))


@query(f"with {FACTS} select filing_id, count(value) fact_count from facts group by filing_id")
def kept_fact_count(spark, d):
    return views.kept_fact_count(facts(spark, d))


@query("select o_custkey filing_id, o_orderstatus statement_type, case when count(distinct split_part(o_orderpriority, '-', 1)) = 1 then min(split_part(o_orderpriority, '-', 1)) end currency from orders group by all")
def single_currency(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.col("o_orderstatus").alias("statement_type"), F.replace("o_orderpriority", F.lit("-"), F.lit("/")).alias("unit"))
    return views.single_currency(rows)


@query("select o_custkey filing_id, o_orderstatus statement_type, arg_min(o_orderpriority, o_orderkey) filter (where o_orderpriority not like '1%') currency from orders group by all")
def first_unit(spark, d):
    unit = F.when(~F.startswith("o_orderpriority", F.lit("1")), F.col("o_orderpriority"))
    return views.first_unit(table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.col("o_orderstatus").alias("statement_type"), unit.alias("unit"), F.col("o_orderkey").alias("seq")))


@query(f"with {FACTS} select filing_id, statement_type, code, sum(cast(abs(value) as decimal(18,2))) magnitude, bool_and(value = 0) all_zero, max(end_date) latest, count(distinct end_date) n_periods from facts group by all")
def item_magnitude(spark, d):
    rows = facts(spark, d).withColumn("value", F.col("value").cast("decimal(18,2)"))
    found = views.magnitudes(rows)
    return found.select("filing_id", "statement_type", "code", F.col("magnitude").cast("decimal(38,2)").alias("magnitude"), "all_zero", "latest", F.size("period_ids").cast("long").alias("n_periods"))


@query("select user_id, count(*) discovered, count(*) filter (where event_type <> 'error') processed, cast(count(*) filter (where event_type = 'purchase') as double) stored, count(*) filter (where event_type = 'error') n_failures from events group by user_id")
def run_tally(spark, d):
    """Events as results of a run over filings."""
    results = table(spark, d, "events").select("user_id", F.col("event_id").alias("filing_id"), (F.col("event_type") == "purchase").cast("double").alias("stored"), F.when(F.col("event_type") == "error", "Error").alias("error"))
    return views.tally(results, ["user_id"]).select("user_id", "discovered", "processed", "stored", F.size("failures").cast("long").alias("n_failures"))


@query("select filing_id, section_no, truncated from (select o_custkey filing_id, o_orderkey section_no, count(*) over (partition by o_custkey) > 3 truncated, row_number() over (partition by o_custkey order by o_orderkey) r from orders) where r <= 3")
def outline_limit(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("filing_id"), F.col("o_orderkey").alias("section_no"))
    return views.outline(rows, 3)


@query(f"""with {FACTS}, m as (select * from (select *, row_number() over (partition by company_id, statement_type, code, end_date order by f, {TIES}) r from (select *, dense_rank() over (partition by company_id order by reported_at desc, filing_id desc) f from facts) where f <= 3) where r = 1),
i as (select *, row_number() over (partition by company_id, statement_type order by s, code) r from (select company_id, statement_type, code, min(seq) s from m group by all)),
t as (select *, row_number() over (partition by company_id, statement_type, code order by end_date desc, {TIES}) n from m)
select {", ".join("t." + c for c in FACT_OUT)} from t join i on i.company_id = t.company_id and i.statement_type = t.statement_type and i.code = t.code and i.r <= 12 where n <= 3""")
def research_brief_profile(spark, d):
    return views.research_brief(filings(spark, d), facts(spark, d), FACT_TIES)[1].select(FACT_OUT)


@query("""select doc_id, '# ' || source || chr(10) || chr(10) || '- Issuer: ' || coalesce(lang, doc_id::varchar) || chr(10) || '- Company ID: `' || doc_id || '`' || chr(10) || '- Filed: 2024-01-02' || chr(10) || '- Filing type: `annual`' || chr(10)
|| '- Source system: `s`' || chr(10) || '- Source: u' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || chr(10) page, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || chr(10) body from documents""")
def front_matter(spark, d):
    """Texts as filings' bodies, with their particulars and again without."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("issuer_name"), F.col("doc_id").cast("string").alias("company_id"), F.lit("2024-01-02").cast("date").alias("filing_date"), F.lit("annual").alias("filing_type"), F.lit("s").alias("source"), F.lit("u").alias("source_url"))
    pages = rows.select("doc_id", views.with_front_matter(F.col("text")).alias("page"))
    return pages.withColumn("body", views.without_front_matter(F.col("page")))


@query("select doc_id, sha256(text) sha256, strlen(text) size_bytes from documents where text is not null")
def content_rows(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("markdown"))
    return views.content_rows(rows).select("doc_id", "sha256", F.col("size_bytes").cast("long").alias("size_bytes"))


@query("select o_orderkey id, case when o_orderstatus = 'O' then o_orderstatus || ' ' else '' end || strftime(o_orderdate, '%Y-%m-%d') as label from orders")
def period_labels(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), views.period_label(F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus")), F.col("o_orderdate")).alias("label"))


@query("""with s as (select o_orderkey k, case when o_orderstatus <> 'F' then 1.0 * (o_orderkey % 1000) end ca, case when o_orderkey % 3 <> 0 then 1.0 * (o_orderkey % 700) end na, case when o_orderkey % 5 = 0 then 1.0 * (o_orderkey % 400) end li, case when o_orderkey % 7 <> 0 then 1.0 * (o_orderkey % 300) end eq from orders),
t as (select *, ca + na ta from s)
select k filing_id, code, v::bigint as value from (select k, 'total_assets' code, coalesce(ta, case when li is not null and eq is not null then li + eq end) v from t
union all select k, 'total_liabilities', case when li is null and ta is not null and eq is not null then ta - eq end from t union all select k, 'total_equity', case when eq is null and ta is not null and li is not null then ta - li end from t) where v is not null""")
def derive_printed_totals(spark, d):
    """Orders as printed sheets, some with halves and some with two of the three totals; the derived values."""
    k = F.col("o_orderkey")
    cells = {"current_assets": F.when(F.col("o_orderstatus") != "F", k % 1000), "noncurrent_assets": F.when(k % 3 != 0, k % 700), "total_liabilities": F.when(k % 5 == 0, k % 400), "total_equity": F.when(k % 7 != 0, k % 300)}
    rows = table(spark, d, "orders").select(k.alias("filing_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("code"), v.cast("decimal(38,10)").alias("value")) for c, v in cells.items()])).alias("c")).select("filing_id", "c.*").where("value is not null")
    rows = rows.select("*", F.lit(None).cast("date").alias("start_date"), F.lit("2024-12-31").cast("date").alias("end_date"), F.lit("instant").alias("kind"), F.lit("GBP").alias("unit"), F.lit("pdf_table").alias("provenance"), F.lit(75).alias("confidence"), F.array().cast("array<string>").alias("dimensions"))
    # Null-safe keys: a sheet's periods have no start.
    return derive.derive_printed_totals(rows).where("provenance = 'derived'").select("filing_id", "code", F.col("value").cast("long").alias("value"))
