"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, so equal texts
have equal chunks whatever stands beside them. Its recipe is the ordered list of
its chunks' identifiers. An identifier is a digest that has been verified: the
bytes of each chunk meet once, and a digest that stands for several byte strings
is no identifier; such chunks are spelled out in the recipe instead. Documents
are then compared by their recipes alone; texts themselves do not move.

Texts whose recipe no other text has cannot equal any, so only the chunks of the
others are verified, and of those one copy from each task is sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .copies import BROADCAST_BYTES, small
from .kernels import BLOCK_BYTES, byte_gram_hashes, released, text_blocks
from .store import cut, drop, given_id, texts

#: Bytes that decide whether a chunk ends after them, and the share of places where one may: about 1 KB.
WINDOW = 32
MASK = np.uint64((1 << 10) - 1)
#: Bytes of a chunk at least (but for the last of a text) and at most.
LEAST_CHUNK, MOST_CHUNK = 256, 8192
DIGEST_BYTES = 16
#: Digests that tasks are told to spell out at most; with more, every chunk is spelled out.
MOST_SPELLED = 1 << 16


def _marks(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end, found a piece of the block at a time."""
    step = BLOCK_BYTES - WINDOW
    found = [np.flatnonzero((byte_gram_hashes(data[p : p + step + WINDOW - 1], WINDOW) & MASK) == 0) + p + WINDOW for p in range(0, len(data), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(data: np.ndarray, offsets: np.ndarray):
    """For each row of a block its start and the ends of its chunks, counted from the block's first byte."""
    marks = _marks(data)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at = [], start
        # A mark's window must lie in the row, or a cut would depend on the text before.
        own = marks[np.searchsorted(marks, start + LEAST_CHUNK) : np.searchsorted(marks, stop)].tolist()
        for mark in [*own, stop]:
            while mark - at > MOST_CHUNK:
                at += MOST_CHUNK
                ends.append(at)
            if mark - at >= LEAST_CHUNK:
                at = mark
                ends.append(at)
        if stop > at:
            ends.append(stop)
        yield start, ends


def _digests(view: memoryview, start: int, ends: list[int], size: int):
    for end in ends:
        yield hashlib.blake2b(view[start:end], digest_size=size).digest(), view[start:end]
        start = end


def _recipes(source: DataFrame, size: int, spelled: frozenset[bytes] | None = frozenset()) -> DataFrame:
    """The rows of source with n_chunks and their recipe in place of the text. Chunks of the digests in
    spelled (None: all) are written out behind their digest and length."""
    kept = [c for c in source.columns if c != "text"]
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("n_chunks", T.LongType()), T.StructField("recipe", T.BinaryType())])

    def identifier(digest, view):
        if spelled is None or digest in spelled:
            return digest + len(view).to_bytes(4, "big") + bytes(view)
        return digest

    @released
    def run(batches):
        for batch in batches:
            others = batch.select(kept)
            for low, high, data, offsets in text_blocks(batch.column("text")):
                view = memoryview(np.ascontiguousarray(data))
                n, made = [], []
                for start, ends in chunk_ends(data, offsets):
                    n.append(len(ends))
                    made.append(b"".join(identifier(d, v) for d, v in _digests(view, start, ends, size)))
                own = others.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n, pa.int64()), pa.array(made, pa.binary())], names=[*kept, "n_chunks", "recipe"])

    return source.mapInArrow(run, schema)


def _chunks(source: DataFrame, size: int) -> DataFrame:
    """digest and bytes of every chunk of source's texts."""
    schema = pa.schema([("digest", pa.binary()), ("bytes", pa.binary())])

    @released
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                view = memoryview(np.ascontiguousarray(data))
                found, held = [], 0
                for start, ends in chunk_ends(data, offsets):
                    for d, v in _digests(view, start, ends, size):
                        found.append((d, bytes(v)))
                        held += len(v)
                        if held >= BLOCK_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], schema=schema)
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], schema=schema)

    return source.select("text").mapInArrow(run, "digest binary, bytes binary")


def _side(recipes: DataFrame) -> DataFrame:
    """A written table of recipes, broadcast if its measured bytes are within BROADCAST_BYTES."""
    size = recipes.agg(F.sum(F.length("recipe") + 64)).first()[0] or 0
    return F.broadcast(recipes) if size <= BROADCAST_BYTES else recipes


def exact_duplicates(docs: DataFrame, carry: list[str] | None = None, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, n_chunks and, if columns are carried, these in a struct rest; of every row.

    Rows with identical texts (a null is empty) are a group; of these the row of
    largest doc_id stays (null before all others), of several such rows any one,
    so every group keeps exactly one row. keep_id is the doc_id of that row.
    Texts compare byte by byte: no case, white space or form is folded. An empty
    table gives no rows; columns that are not carried are not read, and carried
    ones may have any name. Results do not depend on digest_bytes.

    What moves: every row's recipe (a digest a chunk, some 2 % of the text), and
    the chunks of texts whose recipe is repeated, once from each task. Keys are
    counted before they are shuffled, so a group of a third of all rows is one
    row from each task, and its join with the rows can be split or broadcast.
    """
    source = texts(docs, *([F.struct(*carry).alias("rest")] if carry else []))
    # Says only which texts to read again: one too many is one more chunk that is found to be unique.
    source = source.withColumn("tk", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length("text")))
    rows = cut(_recipes(source, digest_bytes).withColumn("row", F.monotonically_increasing_id()), "recipes")
    again = cut(rows.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1 and length(recipe) > 0").select("recipe"), "again")
    keys = cut(rows.join(_side(again), "recipe", "left_semi").select("tk").distinct(), "keys")
    chunks = _chunks(source.join(small(keys), "tk", "left_semi"), digest_bytes).groupBy("digest", "bytes").agg(F.count("*").alias("n"))
    several = chunks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest").limit(MOST_SPELLED + 1).collect()
    drop(again, keys)
    if several:
        drop(rows)
        spelled = frozenset(bytes(r["digest"]) for r in several) if len(several) <= MOST_SPELLED else None
        rows = cut(_recipes(source, digest_bytes, spelled).withColumn("row", F.monotonically_increasing_id()), "recipes")
    # A row number is of a written table, so it stays when a task runs again.
    groups = cut(rows.groupBy("recipe").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"), F.max_by("row", "doc_id").alias("stays")).where("n > 1"), "groups")
    found = rows.join(_side(groups), "recipe", "left").withColumn("keep", F.coalesce("keep", "doc_id"))
    return found.select(
        given_id(),
        given_id("keep").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays") == F.col("row"), F.lit(True)).alias("kept"),
        "n_chunks",
        *(["rest"] if carry else []),
    )
