"""Substring search of issuers by an index of fragments.

Fields are folded once, when the index is built. Its postings say which issuer
has which fragment of one to three characters, in folders by the fragment's
hash; issuers lie in folders by the hash of their id. A search reads the folders
of its own fragments, intersects their issuers, opens only the folders of those,
and ranks what contains the query. Nothing scans or folds all issuers.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.folds import KINDS

#: Characters of a fragment at most. Shorter ones are kept as well, for queries as short as they.
LONGEST = 3
#: Candidates up to which their ids are broadcast to find their folders.
FEW = 100_000


def fold_all(column: Column, kind: str) -> Column:
    """Each text of an array folded."""
    own = KINDS[kind]

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda texts: [own(t) for t in texts if t is not None])

    return F.pandas_udf(run, ArrayType(StringType()))(column)


def _texts(fields: Sequence[str], df: DataFrame) -> Column:
    """Values of fields, of which some may be arrays, as one array."""
    own = [F.coalesce(F.col(f), F.array().cast("array<string>")) if df.schema[f].dataType.typeName() == "array" else F.array(F.col(f).cast("string")) for f in fields]
    return F.concat(*own, F.array().cast("array<string>"))


def fragments(texts: Column) -> Column:
    """The distinct fragments of all texts of an array."""

    def of_length(n: int) -> Column:
        own = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
        return F.flatten(F.transform(F.filter(texts, lambda t: F.length(t) >= n), own))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(1, LONGEST + 1)]))


def fragments_of(query: str) -> list[str]:
    """What a text that contains the query must have."""
    n = min(len(query), LONGEST)
    return sorted({query[i : i + n] for i in range(len(query) - n + 1)}) if query else []


@dataclass(frozen=True)
class FragmentIndex:
    """An index that was written below a path."""

    spark: SparkSession
    path: str
    kind: str
    folders: int

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def candidates(self, query: str) -> DataFrame:
        """key and folder of the issuers that have all fragments of the folded query."""
        own = fragments_of(query)
        shards = sorted({zlib.crc32(g.encode()) % self.folders for g in own})
        postings = self._read("postings").where(F.col("shard").isin(shards) & F.col("fragment").isin(own))
        return postings.groupBy("__key", "folder").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).drop("n")

    def search(self, query: str, identities_first: bool = True, limit: int | None = None) -> DataFrame:
        """Issuers that contain the query, with match_rank.

        0: an identity (with identities_first; else any field) equals it; 1: a name
        (else any field) begins with it; 2: any field contains it. With a limit in the
        order of rank and name. A query without a letter or digit finds nothing.
        """
        q = KINDS[self.kind](query)
        if not q:
            found = self._read("issuers").limit(0)
        else:
            keys = self.candidates(q)
            few = keys.limit(FEW + 1).count() <= FEW
            found = self._read("issuers").join(F.broadcast(keys) if few else keys, ["folder", "__key"], "left_semi")
        anything = F.concat("__identities", "__names")
        exact, begins = ("__identities", "__names") if identities_first else (anything, anything)
        rank = F.when(F.array_contains(exact, F.lit(q)), 0).when(F.exists(begins, lambda x: F.startswith(x, F.lit(q))), 1).when(F.exists(anything, lambda x: F.contains(x, F.lit(q))), 2)
        found = found.withColumn("match_rank", rank).where("match_rank is not null")
        if limit is not None:
            found = found.orderBy("match_rank", F.element_at("__names", 1), "__key").limit(max(1, limit))
        return found.drop("folder", "__key", "__identities", "__names")


def build_fragments(companies: DataFrame, path: str, identities: Sequence[str], names: Sequence[str], id: str = "id", kind: str = "match", folders: int = 64) -> FragmentIndex:
    """Writes the index of companies below a path. Fields may be arrays (aliases); the first name orders ties."""
    rows = companies.withColumn("__key", F.col(id).cast("string"))
    rows = rows.withColumns({"__identities": fold_all(_texts(identities, companies), kind), "__names": fold_all(_texts(names, companies), kind), "folder": F.pmod(F.crc32("__key"), F.lit(folders)).cast("int")})
    rows.repartition(folders, "folder").write.partitionBy("folder").parquet(f"{path}/issuers")
    spark = companies.sparkSession
    kept = spark.read.parquet(f"{path}/issuers")
    postings = kept.select("__key", "folder", F.explode(fragments(F.concat("__identities", "__names"))).alias("fragment")).distinct()
    postings = postings.withColumn("shard", F.pmod(F.crc32("fragment"), F.lit(folders)).cast("int"))
    # Rebalancing cuts what very frequent fragments bring to a folder into several files.
    postings.hint("rebalance", "shard").sortWithinPartitions("shard", "fragment").write.partitionBy("shard").parquet(f"{path}/postings")
    return FragmentIndex(spark, path, kind, folders)
