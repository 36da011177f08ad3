"""What a user is shown: statement views, counts and tallies, briefs, front matter, projections and envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STATEMENTS
from .windows import merge_company_facts, newest_filings, top_per_group

# What separates front matter from a body, and the limits of a view.
BODY_MARK = "\n---\n\n"
MOST_PERIODS, MOST_LINE_ITEMS, MOST_SECTIONS = 12, 100, 200
DETAILS = ("minimal", "standard", "full")


# ---- derived columns -------------------------------------------------------


def has_document(document_id: Column) -> Column:
    return document_id.isNotNull()


def period_label(fiscal_period: Column, end_date: Column) -> Column:
    """The fiscal period, if it is known, and the last day."""
    return F.concat(F.when(F.coalesce(fiscal_period, F.lit("")) != "", F.concat(fiscal_period, F.lit(" "))).otherwise(""), F.date_format(end_date, "yyyy-MM-dd"))


def statement_periods(facts: DataFrame) -> DataFrame:
    """The distinct period labels of each statement, in the order in which they are first seen (seq)."""
    named = facts.withColumn("label", period_label(F.col("fiscal_period"), F.col("end_date"))).groupBy("filing_id", "statement_type", "label").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("filing_id", "statement_type").orderBy("seq", "label"))
    return named.select("filing_id", "statement_type", "label", place.alias("place"))


def less_precise(left: Column, right: Column) -> Column:
    """The decimals of less precision; the left one of equals. INF is most precise, what is no number least."""
    rank = lambda c: F.when(F.upper(c) == "INF", 10000).otherwise(F.coalesce(c.try_cast("int"), F.lit(-10000)))
    return F.when(rank(left) <= rank(right), left).otherwise(right)


# ---- statement views -------------------------------------------------------


def _limit(value: int, most: int, name: str) -> None:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be between 1 and {most}")


def statement_view(facts: DataFrame, statements: Sequence[str] | None = None, periods: int = 4, detail: str = "standard", max_line_items: int = 50, ties: Sequence[str] = ("seq",), valid: Sequence[str] = STATEMENTS) -> DataFrame:
    """Of each statement the first line items by seq, and of each item its newest periods.

    detail: minimal has the values alone, standard units and periods with them,
    full also how each value was found.
    """
    _limit(periods, MOST_PERIODS, "periods")
    _limit(max_line_items, MOST_LINE_ITEMS, "max_line_items")
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of {', '.join(DETAILS)}")
    if statements:
        if unknown := sorted(set(statements) - set(valid)):
            raise ValueError(f"unknown statement type {unknown[0]}")
        facts = facts.where(F.col("statement_type").isin(list(statements)))
    statement = ["filing_id", "statement_type"]
    items = facts.groupBy(*statement, "code").agg(F.min("seq").alias("__first"))
    items = top_per_group(items, statement, [F.col("__first"), F.col("code")], max_line_items).select(*statement, "code")
    shown = top_per_group(facts, [*statement, "code"], [F.col("end_date").desc(), *(F.col(t) for t in ties)], periods).join(items, [*statement, "code"], "left_semi")
    columns = [*statement, "code", "end_date", "value"]
    if detail != "minimal":
        columns += ["name", "unit", "start_date", "fiscal_period"]
    if detail == "full":
        columns += ["concept", "decimals", "provenance", "confidence", "derived_from", "dimensions"]
    return shown.select(*[c for c in columns if c in shown.columns])


def without_nulls(*columns: str) -> Column:
    """The columns as a JSON object without its null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


# ---- counts and tallies ----------------------------------------------------


def tagged_fact_count(raw: DataFrame) -> DataFrame:
    """Of a tagged report: its numeric facts that have a value, known concepts or not."""
    return raw.groupBy("filing_id").agg(F.count_if(F.col("numeric") & F.col("value").isNotNull()).alias("fact_count"))


def kept_fact_count(facts: DataFrame) -> DataFrame:
    """Of other documents: the values that were kept."""
    return facts.groupBy("filing_id").agg(F.count("value").alias("fact_count"))


def single_currency(facts: DataFrame, keys: Sequence[str] = ("filing_id", "statement_type")) -> DataFrame:
    """The head of the units of a statement, null if it has none or several."""
    head = F.nullif(F.substring_index("unit", "/", 1), F.lit(""))
    return facts.groupBy(*keys).agg(F.when(F.count_distinct(head) == 1, F.min(head)).alias("currency"))


def first_unit(facts: DataFrame, keys: Sequence[str] = ("filing_id", "statement_type"), order: str = "seq") -> DataFrame:
    """The first unit of a statement that is not null."""
    return facts.groupBy(*keys).agg(F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col(order))).alias("currency"))


def magnitudes(facts: DataFrame, keys: Sequence[str] = ("filing_id", "statement_type", "code")) -> DataFrame:
    """What candidates of an item are compared by: summed size, whether all is zero, last day, periods."""
    return facts.groupBy(*keys).agg(F.sum(F.abs("value")).alias("magnitude"), F.bool_and(F.col("value") == 0).alias("all_zero"), F.max("end_date").alias("latest"), F.array_sort(F.collect_set("end_date")).alias("period_ids"))


def tally(results: DataFrame, keys: Sequence[str] = ("company_id",)) -> DataFrame:
    """discovered, processed, stored and failures ('id: error', in order) of a run's results (filing_id,
    stored, error); at most so many failures are held as a company has filings."""
    failure = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "filing_id", "error"))
    return results.groupBy(*keys).agg(
        F.count("*").alias("discovered"), F.count_if(F.col("error").isNull()).alias("processed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("stored"))), F.lit(0)).alias("stored"),
        F.array_sort(F.collect_list(failure)).alias("failures"),
    )


def outline(sections: DataFrame, limit: int) -> DataFrame:
    """The first sections of each filing, and whether there are more."""
    _limit(limit, MOST_SECTIONS, "limit")
    cut = top_per_group(sections, ["filing_id"], [F.col("section_no")], limit + 1)
    more = F.count("*").over(Window.partitionBy("filing_id")) > limit
    place = F.row_number().over(Window.partitionBy("filing_id").orderBy("section_no"))
    return cut.withColumn("truncated", more).withColumn("__place", place).where(F.col("__place") <= limit).drop("__place")


def research_brief(filings: DataFrame, facts: DataFrame, ties: Sequence[str] = ("seq",), newest: int = 5, periods: int = 3, items: int = 12) -> tuple[DataFrame, DataFrame]:
    """A company's newest filings, and the first items of its merged facts in the newest periods."""
    merged = merge_company_facts(facts, periods, ties)
    codes = merged.groupBy("company_id", "statement_type", "code").agg(F.min("seq").alias("__first"))
    codes = top_per_group(codes, ["company_id", "statement_type"], [F.col("__first"), F.col("code")], items).drop("__first")
    profile = top_per_group(merged, ["company_id", "statement_type", "code"], [F.col("end_date").desc(), *(F.col(t) for t in ties)], periods)
    return newest_filings(filings, newest), profile.join(codes, ["company_id", "statement_type", "code"], "left_semi")


# ---- documents -------------------------------------------------------------


def with_front_matter(body: Column, quality: Column | None = None, method: Column | None = None) -> Column:
    """A filing's Markdown below its title and particulars; columns of the filing are in the row."""
    line = lambda name, c, tick=False: F.concat(F.lit(f"- {name}: `" if tick else f"- {name}: "), c, F.lit("`\n" if tick else "\n"))
    lines = [
        F.concat(F.lit("# "), "title", F.lit("\n\n")), line("Issuer", F.coalesce(F.nullif("issuer_name", F.lit("")), "company_id")), line("Company ID", F.col("company_id"), True), line("Filed", F.date_format("filing_date", "yyyy-MM-dd")),
        line("Filing type", F.col("filing_type"), True), line("Source system", F.col("source"), True),
    ]
    if method is not None:
        lines.append(F.coalesce(line("Extraction method", method, True), F.lit("")))
    if quality is not None:
        lines.append(F.coalesce(line("Extraction quality", F.concat(quality["status"], F.lit(" ("), quality["score"].cast("string"), F.lit("/100)"))), F.lit("")))
    strip = F.regexp_replace(F.regexp_replace(body, r"^\s+", ""), r"\s+$", "")
    return F.concat(*lines, line("Source", F.col("source_url")), F.lit(BODY_MARK), strip, F.lit("\n"))


def without_front_matter(markdown: Column) -> Column:
    """What follows the first mark; all of it if there is none."""
    at = F.locate(BODY_MARK, markdown)
    return F.when(at > 0, F.substring(markdown, at + len(BODY_MARK), F.length(markdown))).otherwise(markdown)


def content_rows(documents: DataFrame, text: str = "markdown") -> DataFrame:
    """Documents with the digest and the size of their content, as the content table holds them; the
    table's own compression is Parquet's."""
    data = F.col(text) if dict(documents.dtypes)[text] == "binary" else F.encode(F.col(text), "UTF-8")
    return documents.withColumn("sha256", F.sha2(data, 256)).withColumn("size_bytes", F.octet_length(data))


# ---- projections and envelopes ---------------------------------------------

# Fields of the short forms.
COMPANY_FIELDS = ("id", "name", "market", "country_code", "ticker", "lei", "local_code", "sources", "status", "source_url")
FILING_FIELDS = (
    "id", "company_id", "source", "title", "category", "filing_type", "filing_date", "published_at", "period_end", "media_type", "language", "has_document", "xbrl_available", "pdf_available", "source_url",
)


def _plain(df: DataFrame, name: str) -> Column:
    """Decimals as strings, days and times as ISO text, all else as it is."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("decimal"):
        return F.col(name).cast("string").alias(name)
    if kind == "date":
        return F.date_format(name, "yyyy-MM-dd").alias(name)
    if kind == "timestamp":
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(name)
    return F.col(name).alias(name)


def summary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields that df has, in their order, ready for JSON."""
    return df.select(*[_plain(df, f) for f in fields if f in df.columns])


def company_summaries(companies: DataFrame) -> DataFrame:
    return summary(companies, COMPANY_FIELDS)


def filing_summaries(filings: DataFrame) -> DataFrame:
    if "document_id" in filings.columns:
        filings = filings.withColumn("has_document", has_document(F.col("document_id")))
    return summary(filings, FILING_FIELDS)


def success(data: dict, next_steps: Sequence[str] = ()) -> dict:
    return {"success": True, "data": data} | ({"next_steps": list(next_steps)} if next_steps else {})


def failure(message: str, error_code: str = "REQUEST_FAILED", suggestions: Sequence[str] = ()) -> dict:
    return {"success": False, "error": message, "error_code": error_code} | ({"suggestions": list(suggestions)} if suggestions else {})
