"""Extraction that is done once for each distinct content and extractor."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import VersionedTable


@dataclass(frozen=True)
class Extractor:
    """run gives rows with sha256 from contents (sha256, content); another version is another extractor.

    A content of which it gives no row is remembered too.
    """

    name: str
    version: str
    run: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Extracted:
    """Results by content, and which contents an extractor's version has seen; both tables have the key sha256."""

    results: VersionedTable
    seen: VersionedTable

    def pending(self, documents: DataFrame, extractor: Extractor) -> DataFrame:
        """sha256 and content of what the extractor has not seen, once each.

        Keys decide, so contents that were seen do not move; of equal contents one does.
        """
        keyed = documents.where("content is not null").withColumn("sha256", F.sha2("content", 256))
        keys = keyed.groupBy("sha256").agg(F.min("filing_id").alias("filing_id"))
        if self.seen.manifest() is not None:
            done = self.seen.read().where((F.col("extractor") == extractor.name) & (F.col("extractor_version") == extractor.version))
            keys = keys.join(done.select("sha256"), "sha256", "left_anti")
        return keyed.join(keys, ["sha256", "filing_id"], "left_semi").dropDuplicates(["sha256"]).select("sha256", "content")

    def extract(self, documents: DataFrame, extractor: Extractor) -> int:
        """Runs the extractor on what is pending and keeps the results; returns how many contents that were.

        Results and the contents that were seen carry the run's id. Contents are marked last, and only
        results of marked runs are read, so an attempt that ended between leaves nothing that counts.
        """
        pending = self.pending(documents, extractor)
        stamp = {"extractor": F.lit(extractor.name), "extractor_version": F.lit(extractor.version), "run": F.lit(uuid.uuid4().hex)}
        n = pending.select("sha256").count()
        if n:
            self.results.append(extractor.run(pending).withColumns(stamp))
            self.seen.append(pending.select("sha256").withColumns(stamp))
        return n

    def of(self, documents: DataFrame, extractor: Extractor) -> DataFrame:
        """Each document with the results of its content: one extraction serves all copies."""
        own = lambda t: t.read().where((F.col("extractor") == extractor.name) & (F.col("extractor_version") == extractor.version)).drop("extractor", "extractor_version")
        keyed = documents.where("content is not null").select("filing_id", F.sha2("content", 256).alias("sha256"))
        return keyed.join(own(self.results).join(own(self.seen), ["sha256", "run"], "left_semi").drop("run"), "sha256")
