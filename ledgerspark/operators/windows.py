"""Pick-one-of-many: every ranking, newest-first and de-duplicating operator.

All are top-k windows, which Spark plans with a group limit on both sides of the
shuffle, so a company with very many rows is cut before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import KINDS


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def filed_at() -> Column:
    """When a filing became known: its publication, else midnight of its date."""
    return F.coalesce(F.col("published_at"), F.col("filing_date").cast("timestamp"))


def newest_filings(filings: DataFrame, n: int) -> DataFrame:
    """The n newest filings of each company, by time and id."""
    return top_per_group(filings, ["company_id"], [filed_at().desc_nulls_last(), F.col("id").desc()], n)


def filter_filings(filings: DataFrame, source: str | None = None, types: Sequence[str] | None = None, category: str | None = None, date_from=None, date_to=None, has_document: bool | None = None) -> DataFrame:
    """Conjunction of the given conditions; types and category ignore case, both dates are inclusive."""
    out = filings
    if source is not None:
        out = out.where(F.col("source") == source)
    if types is not None:
        out = out.where(F.lower("filing_type").isin([t.lower() for t in types]))
    if category is not None:
        out = out.where(F.lower("category") == category.lower())
    if date_from is not None:
        out = out.where(F.col("filing_date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        out = out.where(F.col("filing_date") <= F.lit(date_to).cast("date"))
    if has_document is not None:
        out = out.where(F.col("document_id").isNotNull() == has_document)
    return out


def watchlist(filings: DataFrame, since: str, companies: Sequence | None = None, newest: int = 50) -> DataFrame:
    """Of each watched company's newest filings those since a date."""
    if companies is not None:
        if not 1 <= len(companies) <= 50:
            raise ValueError("a watchlist holds 1 to 50 companies")
        filings = filings.where(F.col("company_id").isin(list(companies)))
    return newest_filings(filings, newest).where(F.col("filing_date") >= F.lit(since).cast("date"))


def greedy_filings(filings: DataFrame, landing_urls: Sequence[str] = ()) -> DataFrame:
    """Within a company, in order of seq, a filing goes if its url or its (date, title) was
    kept before; case of urls, and case and punctuation of titles, do not matter. A known landing
    page is no url of a filing. Sequential by nature: one reducer for each company."""
    landing, plain = {u.casefold() for u in landing_urls}, KINDS["merge"]

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        urls, titles, keep = set(), set(), []
        for url, date, title in pdf.sort_values("seq")[["source_url", "filing_date", "title"]].itertuples(index=False):
            address = url.casefold() if isinstance(url, str) and url.casefold() not in landing else None
            title = plain(title) if isinstance(title, str) else title
            fresh = (address is None or address not in urls) and (date, title) not in titles
            keep.append(fresh)
            if fresh:
                titles.add((date, title))
                if address is not None:
                    urls.add(address)
        return pdf.sort_values("seq")[keep]

    return filings.groupBy("company_id").applyInPandas(reduce, filings.schema)


FACT_KEY = ["company_id", "statement_type", "code", "start_date", "end_date", "kind", "dimensions"]


def fact_history(facts: DataFrame, view: str = "latest_restated", codes: Sequence[str] | None = None, as_of: str | None = None, limit: int | None = None, compat: bool = False, ties: Sequence[str] = ("seq",), keys: Sequence[str] = tuple(FACT_KEY)) -> DataFrame:
    """Values as reported, or of each fact the latest that was known.

    A segment's value is another fact than the total (dimensions, where the facts
    have them; null is none). as_of cuts what is chosen from, so as_reported has
    no use for it; the view as_of needs it. The limit comes last, unless compat
    asks for the old order (limit first, then codes and choice).
    """
    if view not in ("as_reported", "latest_restated", "as_of"):
        raise ValueError(f"unknown view {view}")
    if view == "as_of" and as_of is None:
        raise ValueError("the view as_of needs a date")
    order = [F.col("reported_at").desc(), F.col("filing_id").desc(), *(F.col(t).asc() for t in ties)]
    out = facts
    if as_of is not None and view != "as_reported":
        out = out.where(F.to_date("reported_at") <= F.lit(as_of).cast("date"))
    if compat and limit is not None:
        out = out.orderBy(*order).limit(limit)
    if codes is not None:
        out = out.where(F.col("code").isin(list(codes)))
    if view != "as_reported":
        own = [k for k in keys if k != "dimensions" or k in out.columns]
        if "dimensions" in own:
            own[own.index("dimensions")] = "__dimensions"
            out = out.withColumn("__dimensions", F.when(F.size("dimensions") > 0, F.col("dimensions")))
        out = top_per_group(out, own, order).drop("__dimensions")
    if limit is not None and not compat:
        out = out.orderBy(*order).limit(limit)
    return out


def newest_values(facts: DataFrame, periods: int, ties: Sequence[str] = ("seq",)) -> DataFrame:
    """Of each item of a company the values of its newest periods."""
    return top_per_group(facts, ["company_id", "statement_type", "code"], [F.col("end_date").desc(), F.col("reported_at").desc(), F.col("filing_id").desc(), *(F.col(t) for t in ties)], periods)


def newest_labels(facts: DataFrame, periods: int, keys: Sequence[str] = ("filing_id", "statement_type")) -> DataFrame:
    """Statement view: all values of a statement's newest distinct period ends."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("end_date").desc()))
    return facts.withColumn("__rank", rank).where(F.col("__rank") <= periods).drop("__rank")


def best_concepts(facts: DataFrame) -> DataFrame:
    """Of each filing and code the concept of most dimensionless values, then most periods,
    a standard prefix, most values, best alias rank; the first seen of equals. facts: filing_id,
    code, concept, dimensions, start_date, end_date, seq, alias_rank, standard."""
    item = ["filing_id", "statement_type", "code"]
    # One shuffle and one sort: both windows' keys begin with the item.
    own, all_ = Window.partitionBy(*item, "concept"), Window.partitionBy(*item)
    score = F.struct(
        F.count_if(F.size("dimensions") <= 0).over(own), F.size(F.collect_set(F.struct("start_date", "end_date")).over(own)), F.max("standard").over(own), F.count("*").over(own),
        -F.min("alias_rank").over(own), -F.min("seq").over(own), F.col("concept"),
    )
    rows = facts.repartition(*item).withColumn("__score", score)
    return rows.withColumn("__best", F.max("__score").over(all_)).where("__score = __best").drop("__score", "__best")


def precision_rank(decimals: str = "decimals") -> Column:
    """INF is most precise, anything that is no number least."""
    return F.when(F.upper(decimals) == "INF", 10000).otherwise(F.coalesce(F.expr(f"try_cast({decimals} as int)"), F.lit(-10000)))


def most_precise(facts: DataFrame) -> DataFrame:
    """Of each filing, code and concept the dimensionless values if there are any; then of
    each period, dimensions and unit the most precise one, the first of equals."""
    plain = F.size("dimensions") <= 0
    pool = Window.partitionBy("filing_id", "code", "concept")
    own = facts.withColumn("__any", F.max(plain).over(pool)).where(~F.col("__any") | plain).drop("__any")
    return top_per_group(own, ["filing_id", "code", "concept", "start_date", "end_date", "dimensions", "unit"], [precision_rank().desc(), F.col("seq").asc()])


def scan_limit(periods: int) -> int:
    """How many of a company's filings are looked through for so many that have values."""
    return min(max(periods * 5, 10), 50)


def merge_company_facts(facts: DataFrame, periods: int, ties: Sequence[str] = ("seq",), filings: DataFrame | None = None, category: str | None = "accounts", period: str = "end_date") -> DataFrame:
    """From a company's newest filings that have values, the newest value of each item and period.

    With filings only the newest ones of the category count, as many as
    scan_limit allows. period: the column that names a period.
    """
    if filings is not None:
        scanned = newest_filings(filter_filings(filings, category=category), scan_limit(periods))
        facts = facts.join(scanned.select("company_id", F.col("id").alias("filing_id")), ["company_id", "filing_id"], "left_semi")
    recency = F.dense_rank().over(Window.partitionBy("company_id").orderBy(F.col("reported_at").desc(), F.col("filing_id").desc()))
    return top_per_group(facts.withColumn("__filing", recency).where(F.col("__filing") <= periods), ["company_id", "statement_type", "code", period], [F.col("__filing").asc(), *(F.col(t) for t in ties)]).drop("__filing")


def compare_companies(facts: DataFrame, companies: Sequence, code: str, newest: int = 4, ties: Sequence[str] = ("seq",)) -> DataFrame:
    """One code of 2 to 20 companies side by side; values stay in their own currency."""
    if not 2 <= len(set(companies)) <= 20:
        raise ValueError("2 to 20 companies can be compared")
    return newest_values(facts.where(F.col("company_id").isin(list(companies)) & (F.col("code") == code)), newest, ties)


def diff_filings(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of either side whose values differ, the other side null where it has none."""
    pick = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pick(left, "old").join(pick(right, "new"), list(keys), "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def holders(rows: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Holders whose name contains the text, newest position first."""
    found = rows.where(F.contains(F.lower("holder_name"), F.lit(name.lower()))) if name.strip() else rows.limit(0)
    found = found.orderBy(F.coalesce("position_date", "notified_date", "crossed_date", F.lit("0001-01-01").cast("date")).desc(), F.col("filing_id").desc())
    return found.limit(limit) if limit is not None else found


def flatten_dealings(filings: DataFrame, limit: int | None = None) -> DataFrame:
    """Dealings of insiders one by one, newest filing first."""
    rows = filings.select("*", F.posexplode("dealings").alias("dealing_no", "dealing")).drop("dealings").orderBy(filed_at().desc(), F.col("id").desc(), "dealing_no")
    return rows.limit(limit) if limit is not None else rows
