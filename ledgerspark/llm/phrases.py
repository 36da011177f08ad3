"""Substring removal by automata of recurring phrases.

Every window of n words has one anchor: the least of its GRAM-word hashes
(winnowing), so equal windows have equal anchors. A first pass finds which
anchors occur in several documents. A second sends the words around those
anchors to the shard of the anchor. There phrases that several documents hold
are confirmed and compiled into an Aho-Corasick automaton over word numbers,
and all that came to the shard streams through it: it locates every occurrence,
and of each phrase the least document. Words of occurrences elsewhere go.

Anchors that very many documents hold are not sent. Their phrases are confirmed
by counts that every task sums up before it sends them, automata of the
confirmed ones go to all tasks, and the documents stream through them in place.
"""

from __future__ import annotations

import hashlib
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import BROADCAST_BYTES, KEY, collapse, keyed, small
from .kernels import NON_SPACE, binary_array, covered, gram_hashes, merge_spans, mix, ranges, released, span_hashes, text_blocks, window_rows, winnow, word_spans
from .repeats import find_repeats
from .store import cut, given_id, shards

GRAM = 5
#: Documents from which on an anchor's phrases are not sent to a shard.
ROWS_PER_ANCHOR = 4096
#: Rows that one automaton is compiled for and then sees.
CHUNK_ROWS = 8192
#: Phrases of frequent anchors in one automaton.
PHRASES = 1 << 16
#: End of a span that covers all words, if these are a window at least.
WHOLE = -1


def anchors(data: np.ndarray, offsets: np.ndarray, n: int):
    """Starts and ends of words and rows' first words; anchor hash, first window, number of windows and
    row of each run of windows that share an anchor."""
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    words = span_hashes(data, starts, ends)
    windows, rows = window_rows(first, n)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return starts, ends, first, np.zeros(0, np.uint64), none, none, none
    grams = gram_hashes(words, GRAM)
    least = grams[winnow(grams, n - GRAM + 1)[windows]]
    # Runs go by the hash, not by its place: text that repeats itself stays one run.
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])])
    return starts, ends, first, least[new], windows[new], np.diff(np.append(new, len(windows))), rows[new]


def _distinct(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each hash once for each row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    return h[np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]] if len(h) else h


def _occurrences(automaton: ahocorasick.Automaton, pieces: list[list[int]], n: int):
    """(piece, first word, value) of every occurrence that the automaton locates."""
    found = [(i, end - n + 1, value) for i, ids in enumerate(pieces) for end, value in automaton.iter(tuple(ids))]
    return np.array(found, np.int64).reshape(-1, 3).T


def _compile(phrases) -> ahocorasick.Automaton:
    """phrases: (word numbers, value)."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for words, value in phrases:
        automaton.add_word(tuple(words), value)
    automaton.make_automaton()
    return automaton


def _locate(pieces: list[list[bytes]], doc: np.ndarray, n: int, earlier: dict[bytes, int]):
    """(piece, first word) of phrases of the pieces that also stand in a lesser document.

    earlier: least documents of phrases that came before. Equal hashes of numbers
    only choose what is worth a place in the automaton.
    """
    numbers: dict[bytes, int] = {}
    ids = [[numbers.setdefault(w, len(numbers)) for w in p] for p in pieces]
    flat = np.array([i for p in ids for i in p], np.uint64)
    begin = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    start, row = window_rows(begin, n)
    _, one, inverse = np.unique(gram_hashes(mix(flat), n)[start], return_index=True, return_inverse=True)
    least, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, doc[row])
    np.maximum.at(most, inverse, doc[row])
    wanted = most > least
    before = {}
    for words, first in earlier.items():
        known = [numbers.get(w) for w in words.split()]
        if None not in known:
            before[tuple(known)] = first
    confirmed = [flat[start[i] : start[i] + n].astype(np.int64).tolist() for i in one[wanted]]
    confirmed = list(dict.fromkeys([*map(tuple, confirmed), *before]))
    if not confirmed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    piece, at, phrase = _occurrences(_compile((w, i) for i, w in enumerate(confirmed)), ids, n)
    first = np.array([before.get(w, np.iinfo(np.int64).max) for w in confirmed])
    np.minimum.at(first, phrase, doc[piece])
    late = doc[piece] > first[phrase]
    return piece[late], at[late]


def _phrases_of(pieces: list[list[bytes]], doc, n: int, into: dict) -> dict:
    """{phrase: [least, greatest document]} of the pieces' windows, added to into."""
    for words, own in zip(pieces, doc):
        for i in range(len(words) - n + 1):
            seen = into.setdefault(b" ".join(words[i : i + n]), [own, own])
            seen[0], seen[1] = min(seen[0], own), max(seen[1], own)
    return into


def _runs(batches, found, n: int, hot: bool):
    """For each block of texts: document, key, first word, anchor, and start and end in the bytes of the
    words around each repeated anchor, either of the frequent ones or of the others; and the bytes."""
    for batch in batches:
        docs, keys = batch.column("doc_id").to_numpy(), batch.column("rk").to_numpy()
        for low, high, data, offsets in text_blocks(batch.column("text")):
            starts, ends, first, h, at, count, row = anchors(data, offsets, n)
            keep = found.has(h) & ((found.hot_count(h) > 0) == hot)
            h, at, count, row = h[keep], at[keep], count[keep], row[keep]
            if len(h):
                yield docs[low:high][row], keys[low:high][row], at - first[:-1][row], h, starts[at], ends[at + count + n - 2], data


def find_spans(source: DataFrame, n: int) -> DataFrame:
    """doc_id, rk, lo, hi: word ranges to remove, as found; they can overlap. source: as of keyed()."""
    own, several = collapse(source)
    own = own.where(F.octet_length("text") >= 2 * n - 1)

    def fingerprints(data, offsets):
        *_, h, _, _, row = anchors(data, offsets, n)
        return _distinct(h, row)

    spark = source.sparkSession
    repeats = find_repeats(own, fingerprints, 2 / (n - GRAM + 2) / 6, ROWS_PER_ANCHOR)
    frequent = len(repeats.hot) > 0
    repeats = spark.sparkContext.broadcast(repeats)

    @released
    def send(batches):
        for doc, key, at, h, lo, hi, data in _runs(batches, repeats.value, n, False):
            around = binary_array(data[ranges(lo, hi - lo)], np.concatenate(([0], np.cumsum(hi - lo))))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(key), pa.array(at.astype(np.int32)), around], names=["anchor", "doc_id", "rk", "at", "around"])

    sent = own.mapInArrow(send, "anchor long, doc_id long, rk long, at int, around binary")
    sent = sent.repartition(shards(source, 8, 16), "anchor").sortWithinPartitions("anchor", "doc_id")

    def chunks(batches):
        for batch in batches:
            yield from (batch.slice(low, CHUNK_ROWS) for low in range(0, batch.num_rows, CHUNK_ROWS))

    @released
    def locate(batches):
        parts = chunks(batches)
        now, anchor, earlier = next(parts, None), None, {}
        while now is not None:
            after = next(parts, None)
            h, doc, key, at = (now.column(c).to_numpy() for c in ("anchor", "doc_id", "rk", "at"))
            pieces = [p.split() for p in now.column("around").to_pylist()]
            piece, first = _locate(pieces, doc, n, earlier if anchor == h[0] else {})
            lo = at[piece] + first
            row, lo, hi = merge_spans(piece, lo, lo + n)
            yield _span_batch(doc[row], key[row], lo, hi)
            if after is not None and after.column("anchor")[0].as_py() == h[-1]:
                # The anchor goes on: its phrases are handed to the next automaton with their least documents.
                last = np.flatnonzero(h == h[-1])
                new = _phrases_of([pieces[i] for i in last], doc[last].tolist(), n, {})
                known = earlier if anchor == h[-1] else {}
                earlier = known | {w: min(d[0], known.get(w, d[0])) for w, d in new.items()}
            else:
                earlier = {}
            anchor, now = h[-1], after

    found = sent.mapInArrow(locate, _SPAN)
    if frequent:
        found = found.unionAll(_frequent(own, repeats, n))
    # All rows of a text but those of the least document go whole.
    copies = source.select("doc_id", *KEY).join(small(several), KEY).where("doc_id > least")
    return cut(found, "phrases").unionAll(copies.select("doc_id", "rk", F.lit(0).cast("long").alias("lo"), F.lit(WHOLE).cast("long").alias("hi")))


def _frequent(own: DataFrame, repeats, n: int) -> DataFrame:
    """Spans of phrases with frequent anchors."""

    @released
    def gather(batches):
        for doc, _, _, _, lo, hi, data in _runs(batches, repeats.value, n, True):
            raw = data.tobytes()
            found = _phrases_of([raw[a:b].split() for a, b in zip(lo.tolist(), hi.tolist())], doc.tolist(), n, {})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *(pa.array([d[k] for d in found.values()], pa.int64()) for k in (0, 1))], names=["phrase", "least", "most"])

    met = own.mapInArrow(gather, "phrase binary, least long, most long").groupBy("phrase").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    met = cut(met.where("least < most").drop("most"), "frequent")
    parts = max(1, math.ceil(met.count() / PHRASES))
    out = None
    for part in range(parts):
        # About PHRASES of them at most: one automaton.
        rows = met.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()
        phrases = own.sparkSession.sparkContext.broadcast([(bytes(r["phrase"]), r["least"]) for r in rows])

        @released
        def stream(batches, phrases=phrases):
            numbers: dict[bytes, int] = {}
            automaton = _compile([[numbers.setdefault(w, len(numbers) + 1) for w in words.split()], i] for i, (words, _) in enumerate(phrases.value))
            first = np.array([d for _, d in phrases.value], np.int64)
            for doc, key, at, _, lo, hi, data in _runs(batches, repeats.value, n, True):
                raw = data.tobytes()
                ids = [[numbers.get(w, 0) for w in raw[a:b].split()] for a, b in zip(lo.tolist(), hi.tolist())]
                piece, word, phrase = _occurrences(automaton, ids, n)
                late = doc[piece] > first[phrase]
                row, a, b = merge_spans(piece[late], at[piece[late]] + word[late], at[piece[late]] + word[late] + n)
                yield _span_batch(doc[row], key[row], a, b)

        if rows:
            some = own.mapInArrow(stream, _SPAN)
            out = some if out is None else out.unionAll(some)
    return out if out is not None else own.sparkSession.createDataFrame([], _SPAN)


_SPAN = "doc_id long, rk long, lo long, hi long"


def _span_batch(doc, rk, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, rk, lo, hi)], names=["doc_id", "rk", "lo", "hi"])


#: Bytes of spans up to which they are broadcast to the texts; more of them meet the texts in a shuffle.
BROADCAST_SPANS = BROADCAST_BYTES


def with_spans(source: DataFrame, spans: DataFrame) -> DataFrame:
    """source with spans array<struct<lo,hi>>, null where there are none."""
    grouped = cut(spans.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    rows, total = grouped.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if 160 * rows + 40 * total <= BROADCAST_SPANS:
        grouped = F.broadcast(grouped)
    return source.join(grouped, ["doc_id", "rk"], "left")


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of a column of lists of structs."""
    rows = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    flat = column.flatten()
    return rows, np.asarray(flat.field("lo"), np.int64), np.asarray(flat.field("hi"), np.int64)


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray, offsets: np.ndarray):
    """The kept words of each row, joined by one space: bytes, and each row's bounds."""
    out = np.append(data, np.uint8(0x20))
    gap = np.ones(len(ends), bool)
    last = first[1:][np.diff(first) > 0] - 1
    gap[last] = False  # the byte after a row's last word can be another row's
    out[ends[gap]] = 0x20
    size = (ends - starts + 1)[keep]
    flat = out[ranges(starts[keep], size)]
    edge = np.concatenate(([0], np.cumsum(size)))
    n_kept = np.concatenate(([0], np.cumsum(keep)))[first]
    lo, hi = edge[n_kept[:-1]], edge[n_kept[1:]]
    return flat, lo, np.maximum(lo, hi - 1)


def remove_phrases(docs: DataFrame, n: int = 13, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document.

    Words are what ASCII white space separates. A word goes if it is in a window
    of n words whose sequence also starts in a document with a smaller doc_id,
    judged on the input. Null texts have no words. Rows of one doc_id do not
    remove each other's words; a null doc_id counts as smaller than all others
    and stays null. An empty table gives no rows; further columns are not read.
    """
    if n < GRAM:
        raise ValueError(f"n must be {GRAM} at least")
    source = keyed(docs)
    joined = with_spans(source, find_spans(source, n))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    if keep_text:
        fields.append(("kept_text", pa.string()))
    schema = pa.schema(fields)

    @released
    def finish(batches):
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans")
            for low, high, data, offsets in text_blocks(batch.column("text")):
                starts, ends, first = word_spans(data, offsets, NON_SPACE)
                row, lo, hi = span_arrays(spans.slice(low, high - low))
                count = np.diff(first)[row]
                hi = np.where(hi == WHOLE, np.where(count >= n, count, 0), hi)
                gone = covered(lo + first[row], hi + first[row], len(starts))
                flat, a, b = kept_words(data, starts, ends, first, ~gone, offsets)
                view = memoryview(flat)
                total = np.concatenate(([0], np.cumsum(gone)))
                pieces = [view[x:y] for x, y in zip(a.tolist(), b.tolist())]
                columns = [ids.slice(low, high - low), pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
                if keep_text:
                    columns.append(pa.array([p.tobytes().decode("utf-8", "replace") for p in pieces], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return joined.mapInArrow(finish, ddl).withColumn("doc_id", given_id())
