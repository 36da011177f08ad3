"""A persisted inverted index of documents or sections, and ranked search over it.

Postings hold a term's count in a document together with the document's length
and corpus, in folders by the term's hash, so a search reads its own terms'
folders and nothing else: no text and no table of documents. What a corpus adds
up to is kept as one row for each addition. New documents are added by an
anti-join on their key; a document that the index has stays as it is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import exists, folders
from .documents import excerpt, tokens


@dataclass(frozen=True)
class InvertedIndex:
    spark: SparkSession
    path: str
    key: tuple[str, ...]
    corpus: tuple[str, ...] = ()
    text: str = "text"
    title: str | None = None
    buckets: int = 64

    def _additions(self, whole: bool = True) -> list[str]:
        """Folders of additions, in order; whole: of those that were written to their end."""
        found = folders(self.spark, self.path, "add-")
        return [n for n in found if not whole or exists(self.spark, f"{self.path}/{n}/corpora/_SUCCESS")]

    def _read(self, name: str) -> DataFrame:
        found = [f"{self.path}/{n}" for n in self._additions()]
        if not found:
            raise ValueError(f"there is no index in {self.path}")
        read = self.spark.read
        if name == "postings":  # an addition without a token has no file that would tell
            shape = read.parquet(f"{found[0]}/documents").schema
            read = read.schema(shape.add("term", "string").add("tf", "integer").add("in_title", "boolean").add("shard", "integer"))
        return reduce(DataFrame.unionByName, [read.parquet(f"{path}/{name}") for path in found])

    def add(self, parts: DataFrame) -> int:
        """Adds the parts whose key the index does not have, and returns their number.

        Of parts of one key any one is taken. A part without a token counts in its
        corpus. The corpora are written last: an addition that failed before is not
        read by anything, and its parts are added the next time.
        """
        keys = list(self.key)
        fresh = parts.dropDuplicates(keys)
        before = self._additions(whole=False)
        path = f"{self.path}/add-{int(before[-1][4:]) + 1 if before else 0:06d}"
        if self._additions():
            fresh = fresh.join(self._read("documents").select(*keys), keys, "left_anti")
        if fresh.isEmpty():
            return 0
        columns = [*keys, *[c for c in self.corpus if c not in keys]]
        rows = fresh.select(*columns, tokens(F.coalesce(F.col(self.text), F.lit(""))).alias("__tokens"), *([tokens(F.coalesce(F.col(self.title), F.lit(""))).alias("__title")] if self.title else []))
        rows = rows.withColumn("length", F.size("__tokens"))
        counted = rows.select(*columns, "length", F.explode("__tokens").alias("term"), *(["__title"] if self.title else []))
        # All tokens of a document are in one task, so they are counted there before they move.
        postings = counted.withColumn("in_title", F.array_contains("__title", F.col("term")) if self.title else F.lit(False)).groupBy(*columns, "length", "term").agg(F.count("*").cast("int").alias("tf"), F.max("in_title").alias("in_title"))
        postings = postings.withColumn("shard", F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int"))
        # Rebalancing cuts what a very frequent term brings to a folder into several files.
        postings.hint("rebalance", "shard").sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{path}/postings")
        rows.select(*columns, "length").write.parquet(f"{path}/documents")
        total = rows.groupBy(*self.corpus).agg(F.count("*").alias("n"), F.sum("length").alias("length"))
        total.write.parquet(f"{path}/corpora")
        return self.spark.read.parquet(f"{path}/documents").count()

    def search(self, query: str, k1: float = 1.5, b: float = 0.75, title_bonus: float = 1.5) -> DataFrame:
        """The key, the corpus, score and matched_terms of every document that holds a term of the query."""
        terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
        shards = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        hits = self._read("postings").where(F.col("shard").isin(shards) & F.col("term").isin(terms))
        corpus = list(self.corpus)
        totals = self._read("corpora").groupBy(*corpus).agg(F.sum("n").alias("__n"), (F.sum("length") / F.sum("n")).alias("__mean"))
        # A corpus has as many rows here as the query has terms; Spark broadcasts them if they are few.
        found = hits.groupBy(*corpus, "term").agg(F.count("*").alias("__df"))
        same = lambda right, names: [F.col(f"h.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names] or [F.lit(True)]
        rows = hits.alias("h").join(found.alias("f"), [*same("f", [*corpus, "term"])]).join(totals.alias("t"), same("t", corpus))
        idf = F.log(1 + (F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
        tf = F.col("tf").cast("double")
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("__mean"))) + F.when(F.col("in_title"), title_bonus).otherwise(0.0)
        columns = [*self.key, *[c for c in corpus if c not in self.key]]
        scored = rows.select(*[F.col(f"h.{c}").alias(c) for c in columns], F.struct(F.col("h.term").alias("term"), part.alias("part")).alias("hit"))
        return scored.groupBy(*columns).agg(F.array_sort(F.collect_list("hit")).alias("hits")).select(
            *columns, F.round(F.aggregate("hits", F.lit(0.0), lambda total, x: total + x["part"]), 6).alias("score"), F.transform("hits", lambda x: x["term"]).alias("matched_terms")
        )

    def search_texts(self, query: str, parts: DataFrame, limit: int | None = None, snippet: int = 1_200) -> DataFrame:
        """The hits with a snippet of their text around the first term; with a limit the best of all."""
        hits = self.search(query)
        if limit is not None:
            hits = hits.orderBy(F.col("score").desc(), *self.key).limit(max(1, limit))
        keys = list(self.key)
        texts = parts.dropDuplicates(keys).select(*keys, excerpt(F.col(self.text), query, snippet).alias("snippet"))
        return hits.join(texts, keys)


def open_index(spark: SparkSession, path: str, key: Sequence[str], corpus: Sequence[str] = (), text: str = "text", title: str | None = None, buckets: int = 64) -> InvertedIndex:
    return InvertedIndex(spark, path, tuple(key), tuple(corpus), text, title, buckets)
