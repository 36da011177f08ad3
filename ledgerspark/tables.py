"""Tables of the star schema, and the canonical ones that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies: id, name, market, country_code, company_type, sources."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    region = F.broadcast(table(spark, sf_dir, "region"))
    found = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return found.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("market"), F.col("r_name").alias("country_code"),
        F.col("c_mktsegment").alias("company_type"), F.array("r_name", "n_name").alias("sources"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("date").alias("filing_date"), F.lit(None).cast("timestamp").alias("published_at"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("filing_type"), F.col("o_totalprice").alias("amount"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order as reported values; seq and what follows make every row's place definite."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("filing_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("date").alias("reported_at"),
        F.col("l_returnflag").alias("statement_type"), F.concat("l_returnflag", "l_linestatus").alias("code"), F.lit(None).cast("date").alias("start_date"), F.col("l_shipdate").cast("date").alias("end_date"),
        F.lit("duration").alias("kind"), F.col("l_extendedprice").alias("value"), F.col("l_linestatus").alias("provenance"), F.col("l_quantity").alias("confidence"), F.col("l_discount").alias("decimals"),
        F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_tax").alias("tax"),
    )


#: Completes any order of facts: only whole rows are unique.
FACT_TIES = ["seq", "part", "supplier", "value", "confidence", "decimals", "tax", "provenance", "end_date"]
