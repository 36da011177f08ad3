"""From documents to line items: every document is read by its route, and all routes give one table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import reporting_period
from ..functions.lineitems import with_codes
from ..lake import by_keys, scratch
from ..operators.derive import derive_chart_totals, derive_printed_totals, derive_totals
from ..operators.windows import best_concepts, most_precise
from . import statements, structured, xbrl

ITEM = ("filing_id", "statement_type", "code", "name", "concept", "start_date", "end_date", "kind", "value", "unit", "decimals", "dimensions", "provenance", "confidence", "derived_from")


def _shape(df: DataFrame) -> DataFrame:
    """df with the columns of ITEM, null where it has none."""
    kinds = {"value": "decimal(38,10)", "dimensions": "array<struct<axis:string,member:string>>", "derived_from": "array<string>", "confidence": "int", "start_date": "date", "end_date": "date"}
    known = set(df.columns)
    kind = F.when(F.col("start_date").isNull(), "instant").otherwise("duration")
    return df.select(*[(F.col(c) if c in known else kind if c == "kind" else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ITEM])


def _once(rows: DataFrame) -> DataFrame:
    """The rows written and read back: totals are derived from them in several steps, and each would read
    the documents again."""
    path = scratch(rows.sparkSession, "read")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def public_pages(archives: DataFrame) -> DataFrame:
    """filing_id, content: the public pages of each archive, one after another by name."""
    pages = structured.unzip(archives).where(F.lower("member").rlike(r"publicdoc.*\.(x?html?|htm)$"))
    parts = F.array_sort(F.collect_list(F.struct("member", F.decode("content", "UTF-8").alias("text"))))
    return pages.groupBy("filing_id").agg(F.encode(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), "UTF-8").alias("content"))


def line_items(documents: DataFrame) -> DataFrame:
    """The line items of documents (filing_id, content binary, media_type, profile, markdown, period_end).

    Pages and instances are read as tagged reports, an archive of public pages
    as those pages, one of JSON facts as such; a document with no route but with
    Markdown is read as printed statements. Missing totals are derived in the
    way of each kind. A document that cannot be read gives no rows here; its
    error is a row of parse_reports.
    """
    routed = statements.route(documents)
    of = lambda *names: routed.where(F.col("route").isin(*names))
    pages = of("html", "unknown").where("content is not null").select("filing_id", "content")
    pages = pages.unionByName(public_pages(of("edinet"))).unionByName(structured.largest_html(of("zip")).select("filing_id", "content"))
    tagged = derive_totals(_once(_shape(xbrl.statements(pages))))
    archives = structured.unzip(of("bmv-json")).where(F.lower("member").endswith(".json"))
    json = structured.bmv_values(archives.select("filing_id", F.decode("content", "UTF-8").alias("json")))
    coded = with_codes(json.where("numeric and value is not null"))
    facts = _once(_shape(most_precise(best_concepts(coded)).withColumn("provenance", F.lit("tagged_xbrl")).withColumn("confidence", F.lit(100))))
    papers = routed.where("markdown is not null and route in ('pdf', 'unknown')").select("filing_id", "markdown", "period_end")
    start, end = reporting_period(F.coalesce("year", F.year("period_end")), F.col("statement_type") == "balance_sheet", F.col("period_end"), F.lit(None).cast("date"))
    printed = statements.read_statements(papers).join(by_keys(papers.select("filing_id", "period_end").distinct()), "filing_id").withColumn("start_date", start).withColumn("end_date", end)
    printed = derive_printed_totals(_once(_shape(printed.withColumn("dimensions", F.array().cast("array<struct<axis:string,member:string>>")))))
    return _named(tagged).unionByName(_named(derive_totals(facts))).unionByName(_named(printed))


#: Feeds whose own rows stand for the document, and how they are read.
STRUCTURED = {
    "cvm": lambda rows: derive_chart_totals(_shape(structured.cvm_statements(rows))),
    "dart": lambda rows: _shape(structured.dart_statements(rows)),
    "kap": lambda rows: _shape(structured.kap_statements(rows)),
    "smv": lambda rows: _shape(structured.smv_statements(rows)),
}


def financials(documents: DataFrame, feeds: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The line items of filings: from their feed's own rows where it has any, else from the document.

    feeds: by profile (those of STRUCTURED, and sfc), rows as the profile's reader takes them. A feed's row counts
    for filings of any profile: its filing_id decides. sfc has balance sheets only; they replace those of the
    document, the rest of which stays. Documents whose filing a feed has are not read.
    """
    feeds = dict(feeds or {})
    sheets = feeds.pop("sfc", None)
    unknown = set(feeds) - set(STRUCTURED)
    if unknown:
        raise ValueError(f"no reader for the feeds of {', '.join(sorted(unknown))}")
    first = [_named(STRUCTURED[profile](rows)) for profile, rows in feeds.items()]
    own, rest = None, documents
    if first:
        # Written once: every route of the documents asks which filings are left.
        spark, path = documents.sparkSession, scratch(documents.sparkSession, "feeds")
        reduce(DataFrame.unionByName, first).write.parquet(f"{path}/items")
        own = spark.read.parquet(f"{path}/items")
        documents.join(by_keys(own.select("filing_id").distinct()), "filing_id", "left_anti").write.parquet(f"{path}/documents")
        rest = spark.read.parquet(f"{path}/documents")
    read = line_items(rest)
    if sheets is not None:
        read = structured.override_statements(read, _named(_shape(structured.sfc_balance_sheet(sheets))))
    return read if own is None else own.unionByName(read)


def _named(facts: DataFrame) -> DataFrame:
    """Derived totals stand in the balance sheet, under the name of their code."""
    named = F.initcap(F.replace("code", F.lit("_"), F.lit(" ")))
    return _shape(facts).withColumns({"statement_type": F.coalesce("statement_type", F.lit("balance_sheet")), "name": F.coalesce("name", named)})
