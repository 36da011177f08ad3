"""Several sources at once: what each gives, and how it went, so that one that fails does not take the others with it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import scratch

STATUS = "source string, source_pos int, status string, n_rows long, error string"


def gather(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], at_once: int = 4) -> tuple[DataFrame | None, DataFrame]:
    """(rows, status). sources: by name, in the order of precedence, what makes their rows.

    A source is read to its end before it counts: its rows go to the shared folder,
    so none of a source that fails half-way is returned, and nothing is
    read twice. rows: all columns of those that succeeded, with source_pos; None if none
    did. status: a row for each source, ok or failed, with the first line of its error.
    Some sources are read at the same time; each is a job of its own.
    """
    path = scratch(spark, "gather")

    def read(place: int, name: str, make: Callable[[], DataFrame]):
        own = f"{path}/{place}"
        try:
            make().withColumn("source_pos", F.lit(place)).write.parquet(own)
            back = spark.read.parquet(own)
            return back, (name, place, "ok", back.count(), None)
        except Exception as e:  # whatever a source raises is its status
            lines = [x for x in str(e).splitlines() if x.strip()]
            return None, (name, place, "failed", 0, f"{type(e).__name__}: {lines[0] if lines else ''}"[:300])

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        done = list(pool.map(lambda x: read(x[0], *x[1]), enumerate(sources.items())))
    found = [df for df, _ in done if df is not None]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None
    return rows, spark.createDataFrame([s for _, s in done], STATUS)
