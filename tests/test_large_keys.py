"""Queries against their SQL on tables with larger keys than those of the small test data."""

import duckdb
from pyspark.sql import functions as F

from ledgerspark.plans import mechanisms  # noqa: F401 (registers its queries)
from ledgerspark.plans.queries import QUERIES, SQL

from .test_queries import rows


def _against_sql(spark, folder, name, **tables):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for own, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{own}.parquet")
        db.execute(f"create view {own} as select * from '{folder}/{own}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, found.fetchall())
    assert want and rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_landed_feed_of_long_company_keys(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    _against_sql(spark, tmp_path, "landed_feed_range", orders=orders.withColumn("o_custkey", F.col("o_custkey") * 9973))
