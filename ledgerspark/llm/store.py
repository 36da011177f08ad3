"""Intermediate tables that outlive executors, and sizes that follow the input."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import NULL_ID

_DIR = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that a worker gets, unless the session names a limit: texts are long, and the
#: usual 10,000 of them would stand in the executor and in the worker at once.
BATCH_BYTES = 4 << 20
_kept: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session of one machine may name none: it gets its own."""
    found = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set {_DIR} to a folder that all executors of {master} share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerspark-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str = "t") -> str:
    path = f"{shared_dir(spark)}/ledgerspark-{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ledgerspark_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove what cut() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_ledgerspark_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    _kept.pop(path, None)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_rest() -> None:
    for path, spark in list(_kept.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before; the cluster clears its folder
            return


#: Planner's estimates beyond this are taken for guesses (of joins, or of rows without statistics).
_GUESS = 1 << 40


def input_bytes(df: DataFrame) -> int:
    """Size of the input with its column text: the planner's estimate, which needs no job, or if
    that is a guess the texts' own length."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < _GUESS else df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards(df: DataFrame, mb: float = 16, least: int = 16, most: int = 1 << 16) -> int:
    """A power of two of work shares, each of about so many MB of input."""
    want = input_bytes(df) / (mb * 1e6)
    return min(most, max(least, 1 << math.ceil(math.log2(max(1.0, want)))))


def texts(docs: DataFrame, *more) -> DataFrame:
    """doc_id long (NULL_ID for null) and text string, all that most text operators read, and what else is named."""
    if docs.sparkSession.conf.get(_BATCH, None) is None:
        docs.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def given_id(name: str = "doc_id"):
    """The id as it was in the input."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)
