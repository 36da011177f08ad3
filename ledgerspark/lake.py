"""Folders of a lake: where a session's own tables go, and what is in a folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only a session of one machine may name none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerspark-lake-"))
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_keys(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: rows meet by their keys, and it is never sent whole to the
    driver and to all tasks. Files of rows that repeat themselves are so small that the planner would else choose that."""
    return df.hint("merge")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it names it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of the folders in a folder that begin with the prefix, in order; none if it does not exist."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]
    return sorted(n for n in found if n.startswith(prefix))
