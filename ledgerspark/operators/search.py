"""Issuer search: ranks, exact finds, and merging one issuer's records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import KINDS, fold

# Legal forms that a name may end in, in the order in which one is looked for.
LEGAL_SUFFIXES = ("public limited company", "limited", "ltd", "plc")


def folded(column: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def three_tiers(companies: DataFrame, query: str, fields: Sequence[str], tie: str, limit: int | None = None) -> DataFrame:
    """0 if any field equals the query, 1 if one begins with it, 2 if one contains it; accents,
    case and punctuation do not matter."""
    q = F.lit(KINDS["match"](query))
    values = F.array(*[fold(F.coalesce(F.col(f).cast("string"), F.lit("")), "match") for f in fields])
    rank = F.when(F.exists(values, lambda x: x == q), 0).when(F.exists(values, lambda x: F.startswith(x, q)), 1).when(F.exists(values, lambda x: F.contains(x, q)), 2)
    found = companies.withColumn("match_rank", rank).where(F.col("match_rank").isNotNull() & F.lit(bool(KINDS["match"](query))))
    return found.orderBy("match_rank", fold(F.col(tie), "match")).limit(max(1, limit)) if limit is not None else found


def id_or_name(companies: DataFrame, query: str, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """R2: 0 if an id equals the query, 1 if a name begins with it, 2 if anything contains it."""
    q = F.lit(query.lower())
    low = lambda cols: F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])
    rank = F.when(F.exists(low(ids), lambda x: x == q), 0).when(F.exists(low(names), lambda x: F.startswith(x, q)), 1).when(F.exists(low([*ids, *names]), lambda x: F.contains(x, q)), 2)
    return companies.withColumn("match_rank", rank).where(F.col("match_rank").isNotNull() & F.lit(bool(query.strip())))


def two_tiers(companies: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """R3, the offline search: 0 if a field equals the query, 1 if one contains it; a blank query finds nothing."""
    q = F.lit(query.lower())
    values = F.array(*[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    found = companies.withColumn("match_rank", F.when(F.exists(values, lambda x: x == q), 0).otherwise(1))
    return found.where(F.exists(values, lambda x: F.contains(x, q)) & F.lit(bool(query.strip())))


def find_first(companies: DataFrame, value: str, fields: Sequence[str], order: str) -> DataFrame:
    """The first company of which a field equals the value; a blank value finds none."""
    q = F.lit(value.lower())
    hit = F.exists(F.array(*[F.lower(F.col(f).cast("string")) for f in fields]), lambda x: x == q)
    return companies.where(hit & F.lit(bool(value.strip()))).orderBy(order).limit(1)


def filter_companies(companies: DataFrame, market: str | None = None, country_code: str | None = None, source: str | None = None) -> DataFrame:
    out = companies
    if market is not None:
        out = out.where(F.lower("market") == market.lower())
    if country_code is not None:
        out = out.where(F.lower("country_code") == country_code.lower())
    if source is not None:
        out = out.where(F.array_contains("sources", source))
    return out


def merge_companies(companies: DataFrame, suffixes: Sequence[str] = LEGAL_SUFFIXES) -> DataFrame:
    """Records of one market and name (without one legal form) become one: the first by seq,
    with the sources of all in order, and the first lei that is known.

    Names of Japan are compared by their letters and digits of any script, others
    by those of ASCII. A record whose name has none of them stays by itself.
    """
    plain = folded(F.col("name"))
    name = F.coalesce(*[F.nullif(F.regexp_extract(plain, f"^(.*) {s}$", 1), F.lit("")) for s in suffixes], plain)
    name = F.when(F.upper("market") == "JP", F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", "")).otherwise(name)
    alone = F.when(F.coalesce(name, F.lit("")) == "", F.col("seq").cast("string"))
    keyed = companies.withColumn("merge_key", F.concat_ws(":", F.lower("market"), name)).withColumn("__alone", alone)
    # One sorted array for each key of what the merged record needs, not a window over whole rows.
    rest = F.struct("seq", *[c for c in companies.columns if c not in ("seq", "sources", "lei")])
    met = keyed.groupBy("merge_key", "__alone").agg(
        F.count("*").alias("records"), F.min_by(rest, "seq").alias("first"), F.min_by("lei", F.when(F.col("lei").isNotNull(), F.col("seq"))).alias("lei"),
        F.array_sort(F.collect_set(F.struct("seq", "sources"))).alias("all"),
    )
    sources = F.array_distinct(F.flatten(F.transform("all", lambda x: x["sources"])))
    columns = [sources.alias(c) if c == "sources" else F.col(c) if c == "lei" else F.col("first")[c].alias(c) for c in companies.columns]
    return met.select(*columns, "merge_key", "records")


# Beginnings of company ids and their sources.
ID_SOURCES = {
    "jp_e": "edinet", "br_cvm_": "cvm", "sg_sgx_": "sgx", "kr_dart_": "dart", "mx_bmv_": "bmv", "in_nse_": "nse", "ca_sedar_": "sedar",
    "pe_smv_": "smv", "co_sfc_": "sfc", "au_asx_": "asx", "tr_kap_": "kap", "uk_lei_": "fca_nsm", "uk_nsm_issuer_": "fca_nsm",
}
ESEF_MARKETS = ("nl", "fr", "es", "it", "dk", "se", "fi", "no", "pl", "be", "at", "lu", "pt")


def source_of_id(company_id: Column) -> Column:
    """The source that an id belongs to; partition pruning needs it as a predicate."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, source in ID_SOURCES.items():
        out = out.when(F.startswith(company_id, F.lit(prefix)), source)
    return out.when(company_id.rlike(rf"^(?:{'|'.join(ESEF_MARKETS)})_lei_"), "esef")
