"""Watchlists as streams; every function works on a batch too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import FACT_KEY, fact_history

LATENESS = "1 hour"


def events(df: DataFrame) -> DataFrame:
    """ts with a time zone, as watermarks need."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _late(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withWatermark(column, LATENESS) if df.isStreaming else df


def windowed_counts(df: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Rows of each tumbling (or, with slide, sliding) window and key; late rows are dropped by streams."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _late(df).groupBy(window, *keys).agg(F.count("*").alias("n"))


def bursts(df: DataFrame, gap: str, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Rows of each session: rows of a key with no gap between them."""
    return _late(df).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def watch(df: DataFrame, since: str) -> DataFrame:
    """New filings from a date on; stateless."""
    return df.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each key within the time that late rows are waited for."""
    return _late(df).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = tuple(FACT_KEY)):
    """Keeps the latest restated facts below path: each batch of the stream and the last snapshot
    give the next one; a batch that is run again gives the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The batch's number is the snapshot's: nothing is read from what it overwrites.
        old = [spark.read.parquet(f"{path}/{number - 1}")] if number else []
        rows = batch
        for df in old:
            rows = rows.unionByName(df)
        fact_history(rows, "latest_restated", keys=keys).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
