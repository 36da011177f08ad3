"""A cleaning pipeline over the documents table, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame on all that the one
before kept, and returns the columns of its input; the last one returns the
encoded documents. Null and repeated doc_ids, null texts, empty tables and
further columns of any name pass through. Stages decide on rows, not on ids:
only rows of one doc_id and one text share a decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.byte_bpe import encode_documents
from ledgerspark.llm.decontaminate import decontaminate
from ledgerspark.llm.jaccard import jaccard_classes
from ledgerspark.llm.language import UNKNOWN, identify, learn
from ledgerspark.llm.store import cut
from ledgerspark.llm.suffix import remove_repeats

#: Share of a document that may be in no learned language.
MOST_BACKGROUND = 0.9


#: Keys up to which a list of them is broadcast; a longer one meets the documents in a shuffle.
BROADCAST_KEYS = 1_000_000


def _key():
    """A row's own key: a 64-bit hash of its doc_id and its text, either of which may be null."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts with their rows' keys in place of doc_id."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows whose key is in found's doc_id."""
    keys = cut(found.select(F.col("doc_id").alias("__key")).distinct(), "keys")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(side, _key() == F.col("__key"), "left_anti")


def _rows_once(docs: DataFrame) -> DataFrame:
    """docs with one row of each doc_id and text; only repeated rows are moved."""
    again = docs.groupBy(_key().alias("__key")).agg(F.count("*").alias("n")).where("n > 1").select("__key")
    again = cut(again, "again")
    if again.isEmpty():
        return docs
    on = _key() == F.col("__key")
    return docs.join(again, on, "left_anti").unionAll(docs.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no language explains."""
    found = identify(_keyed(docs), learn(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))))
    return _without(docs, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("background") > MOST_BACKGROUND)))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows the one of least doc_id (null first) stays, of several such rows
    the one of least key; of repeated rows one."""
    classes = cut(jaccard_classes(_keyed(docs)).where("doc_id <> component_id").distinct(), "classes")
    member = classes.select(F.col("doc_id").alias("key"), "component_id").unionAll(classes.select(F.col("component_id").alias("key"), "component_id").distinct())
    ids = docs.select(_key().alias("key"), "doc_id").distinct()
    stays = member.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select(F.col("least.key").alias("key"))
    return _rows_once(_without(docs, member.join(stays, "key", "left_anti").select(F.col("key").alias("doc_id"))))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that stand anywhere else; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, 200, carry=["doc_id", *others])
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[(changed[c] if c in changed else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return _without(docs, found.where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True).drop("piece_offsets")


STAGES = [
    ("language", keep_known_languages),
    ("similar", keep_one_of_similar),
    ("passages", remove_repeated_passages),
    ("benchmark", drop_contaminated),
    ("encode", encode),
]

#: SQL cannot express the language model, nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
