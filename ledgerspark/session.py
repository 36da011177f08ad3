"""Session settings that results depend on, and those that large inputs want."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "ledgerspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC times (dates of filings are compared across zones) and adaptive execution with skewed joins split."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
