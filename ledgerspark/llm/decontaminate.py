"""Benchmark decontamination by winnowed fingerprints.

Documents and benchmark items keep the least k-gram hash of every sliding run
of n - k + 1 k-grams. Equal spans of n words contain the same run, so they keep
the same fingerprint at the same place: no shared span of n words is missed.
Equal fingerprints are extended word by word to both sides; extensions of n
words or more are hits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, covered, gram_hashes, merge_spans, ranges, released, span_hashes, text_blocks, window_rows, winnow, word_spans
from .store import given_id, texts

#: Bytes of benchmark text up to which its index is broadcast; beyond, fingerprints are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
GRAM = 5


@dataclass
class Index:
    """Fingerprints of benchmark items, sorted, and the items' words."""

    n: int
    ids: list = field(default_factory=list)
    fingerprints: np.ndarray = None
    places: np.ndarray = None  # of fingerprints, in words
    words: np.ndarray = None  # word hashes of all items, a guard before and after each
    inside: np.ndarray = None  # which of words are no guards
    item: np.ndarray = None
    short: dict = field(default_factory=dict)  # words of an item below n -> (sorted hashes, items)


def hash_words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return span_hashes(LOWER[data], starts, ends), first


def selected(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places (in words) of a block's winnowed fingerprints."""
    grams = gram_hashes(words, GRAM)
    least = winnow(grams, n - GRAM + 1)
    windows, _ = window_rows(first, n)
    places = np.unique(least[windows])
    return grams[places], places


def build_index(items: list[tuple[object, str]], n: int) -> Index:
    out = Index(n)
    column = pa.array([t for _, t in items], pa.string())
    out.ids = [i for i, _ in items]
    words, item, marks, places, short = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [], [], {}
    at = 1
    for low, high, data, offsets in text_blocks(column):
        own, first = hash_words(data, offsets)
        hashes, found = selected(own, first, n)
        counts = np.diff(first)
        for row in range(high - low):
            part = own[first[row] : first[row + 1]]
            if 0 < counts[row] < n:
                short.setdefault(len(part), []).append((gram_hashes(part, len(part))[0], low + row))
            lo, hi = np.searchsorted(found, [first[row], first[row + 1]])
            marks.append(hashes[lo:hi])
            places.append(found[lo:hi] - first[row] + at)
            words.append(np.append(part, np.uint64(0)))
            item.append(np.full(len(part) + 1, low + row))
            at += len(part) + 1
    out.words, out.item = np.concatenate(words), np.concatenate(item)
    out.inside = out.words != 0
    if marks:
        prints, places = np.concatenate(marks), np.concatenate(places)
        order = np.argsort(prints, kind="stable")
        out.fingerprints, out.places = prints[order], places[order]
    else:
        out.fingerprints, out.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for size, pairs in short.items():
        pairs.sort()
        out.short[size] = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])
    return out


def _matches(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index of value, index of key) with equal contents."""
    lo = np.searchsorted(sorted_keys, values, "left")
    some = np.flatnonzero((lo < len(sorted_keys)) & (sorted_keys[np.minimum(lo, len(sorted_keys) - 1)] == values)) if len(sorted_keys) else np.zeros(0, np.int64)
    count = np.searchsorted(sorted_keys, values[some], "right") - lo[some]
    return np.repeat(some, count), ranges(lo[some], count)


def find_hits(words: np.ndarray, first: np.ndarray, index: Index):
    """(row, from word, past word, item) of every extended hit; words count within the block."""
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    prints, places = selected(words, first, index.n)
    v, k = _matches(index.fingerprints, prints)
    if len(v):
        lo, at = places[v].copy(), index.places[k].copy()
        row, item = row_of[lo], index.item[at]
        begin, end = first[row], first[row + 1]
        left, on = np.zeros(len(lo), np.int64), np.arange(len(lo))
        while len(on):
            i, j = lo[on] - left[on] - 1, at[on] - left[on] - 1
            on = on[(i >= begin[on]) & index.inside[j] & (words[np.maximum(i, 0)] == index.words[j])]
            left[on] += 1
        right, on = np.zeros(len(lo), np.int64), np.arange(len(lo))
        while len(on):
            i, j = lo[on] + right[on], at[on] + right[on]
            on = on[(i < end[on]) & index.inside[np.minimum(j, len(index.words) - 1)] & (words[np.minimum(i, len(words) - 1)] == index.words[np.minimum(j, len(index.words) - 1)])]
            right[on] += 1
        good = left + right >= index.n
        found.append((row[good], (lo - left)[good], (lo + right)[good], item[good]))
    for size, (keys, items) in index.short.items():
        starts, _ = window_rows(first, size)
        v, k = _matches(keys, gram_hashes(words, size)[starts])
        if len(v):
            at = starts[v]
            found.append((row_of[at], at, at + size, items[k]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in ids})).encode()).hexdigest()


def _summary(rows: int, first: np.ndarray, hits, ids: list):
    row, lo, hi, item = hits
    hit = covered(lo, hi, int(first[-1]))
    at = np.repeat(np.arange(rows), np.diff(first))
    n_hit = np.bincount(at[hit], minlength=rows)
    items: dict[int, set] = {}
    for r, i in zip(row.tolist(), item.tolist()):
        items.setdefault(r, set()).add(ids[i])
    none = _digest(())
    return n_hit, np.array([len(items.get(r, ())) for r in range(rows)]), [_digest(items[r]) if r in items else none for r in range(rows)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    Words are [0-9a-z and non-ASCII]+ after lower-casing A-Z. A window is n
    consecutive words of an item, or a whole item of fewer words. n_hit counts
    the document's words inside any occurrence of a window. Null texts have no
    words; items without words or without an id match nothing; several items
    with one id count once. Repeated documents give repeated rows, a null doc_id
    stays null. An empty benchmark leaves all clean; an empty table gives no
    rows. Further columns are not read.
    """
    if n < GRAM:
        raise ValueError(f"n must be {GRAM} at least")
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        return _decontaminate_large(docs, items, n)
    index = docs.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in items.collect()], n))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    @released
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, data, offsets in text_blocks(batch.column("text")):
                words, first = hash_words(data, offsets)
                n_hit, n_items, digests = _summary(high - low, first, find_hits(words, first, index.value), index.value.ids)
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(np.diff(first)), pa.array(n_hit), pa.array(n_items), pa.array(digests, pa.string()), pa.array(n_hit > 0)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumn("doc_id", given_id())


def _decontaminate_large(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same for a benchmark of any size: fingerprints meet in a shuffle join,
    each candidate pair of document and item is then extended in its own row."""
    own = texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("rk", F.xxhash64("text"))
    short = [r[0] for r in items.mapInArrow(_word_count, "n long").where(f"n > 0 and n < {n}").distinct().collect()]

    def prints(keys: list[str], whole: bool):
        @released
        def run(batches):
            for batch in batches:
                for low, high, data, offsets in text_blocks(batch.column("text")):
                    words, first = hash_words(data, offsets)
                    hashes, places = selected(words, first, n)
                    row = np.searchsorted(first, places, "right") - 1
                    parts = [(hashes, row)]
                    for size in short:
                        starts, rows = window_rows(first, size)
                        if whole:
                            keep = np.diff(first)[rows] == size
                            starts, rows = starts[keep], rows[keep]
                        parts.append((gram_hashes(words, size)[starts] ^ np.uint64(size), rows))
                    for h, r in parts:
                        pairs = np.unique(np.stack((h.view(np.int64), r)), axis=1) if len(h) else np.zeros((2, 0), np.int64)
                        at = pairs[1] + low
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), *(batch.column(c).take(pa.array(at)) for c in keys)], names=["fp", *keys])

        return run

    of_docs = own.mapInArrow(prints(["doc_id", "rk"], False), "fp long, doc_id long, rk long")
    id_type = items.schema["item_id"].dataType.simpleString()

    of_items = items.mapInArrow(prints(["item_id"], True), f"fp long, item_id {id_type}")
    pairs = of_docs.join(of_items, "fp").select("doc_id", "rk", "item_id").distinct()
    joined = pairs.join(own.dropDuplicates(["doc_id", "rk"]), ["doc_id", "rk"]).join(items.withColumnRenamed("text", "item"), "item_id")
    span_type = "array<struct<lo:long,hi:long>>"

    @released
    def extend(batches):
        for batch in batches:
            rows = []
            for doc, rk, item_id, text, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rk", "item_id", "text", "item"))):
                raw = np.frombuffer(text.encode(), np.uint8)
                words, first = hash_words(raw, np.array([0, len(raw)]))
                _, lo, hi, _ = find_hits(words, first, build_index([(item_id, item)], n))
                if len(lo):
                    rows.append({"doc_id": doc, "rk": rk, "item": str(item_id), "spans": [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist())]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("item", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]))

    hits = joined.mapInArrow(extend, f"doc_id long, rk long, item string, spans {span_type}")
    found = hits.groupBy("doc_id", "rk").agg(F.array_sort(F.collect_set("item")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    @released
    def total(batches):
        for batch in batches:
            counts = []
            for spans in batch.column("spans").to_pylist():
                lo, hi = np.array([s["lo"] for s in spans or ()], np.int64), np.array([s["hi"] for s in spans or ()], np.int64)
                _, lo, hi = merge_spans(np.zeros(len(lo), np.int64), lo, hi)
                counts.append(int((hi - lo).sum()))
            n_words = np.concatenate([np.zeros(0, np.int64), *(np.diff(hash_words(data, offsets)[1]) for _, _, data, offsets in text_blocks(batch.column("text")))])
            items_of = [x or [] for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(counts, pa.int64()), pa.array([len(x) for x in items_of], pa.int64()), pa.array([_digest(x) for x in items_of]), pa.array([c > 0 for c in counts])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return own.join(found, ["doc_id", "rk"], "left").mapInArrow(total, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumn("doc_id", given_id())


def _word_count(batches):
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(hash_words(data, offsets)[1]))], names=["n"])
