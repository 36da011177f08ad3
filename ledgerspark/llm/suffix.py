"""Substring removal by suffix arrays of shards.

Every window of L bytes has one anchor, the least of its GRAM-byte hashes
(winnowing), so equal windows have equal anchors. Equal texts are one from the
start. A first pass finds which anchors are repeated at all. A second sends the
surroundings of those to the shard of the anchor, equal surroundings of a block
of texts only once. A shard sorts its suffixes by Larsson-Sadakane refinement
(groups are split by the rank of what follows, to double the depth each round),
takes the common prefixes of neighbours in Kasai's order, and so finds every
window that stands at two places or more. An anchor too frequent for one shard
is dealt to several; the sorted windows that are left open there are merged,
byte by byte, by binary search.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import KEY, collapse, keyed, small
from .kernels import NULL_ID, binary_array, byte_gram_hashes, covered, merge_spans, ranges, released, text_blocks, window_rows, winnow
from .phrases import _SPAN, span_arrays, with_spans
from .repeats import find_repeats
from .store import cut, given_id, shards

GRAM = 64
#: Surroundings of an anchor that one shard takes; a more frequent anchor is dealt to several.
ROWS_PER_ANCHOR = 4096
#: Bytes of surroundings whose suffixes are sorted together.
SHARD_BYTES = 1 << 19
#: Positions that are gone through one after another; more lanes of them go in step.
LANE = 128
#: Windows of a dealt-out anchor in one batch.
ASKED = 4096
_BYTES = np.array([1 << (8 * i) for i in range(8)], np.uint64)


# ---- suffix arrays ---------------------------------------------------------


def head_keys(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, zeros beyond the end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)].copy().view(">u8").ravel().astype(np.uint64)


def suffix_order(text: np.ndarray, rest: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least depth bytes in order of their first depth bytes, and the numbers of
    their groups (equal where those bytes are equal). rest: bytes left at each position."""
    key = head_keys(text)
    order = np.flatnonzero(rest >= 8)
    order = order[np.argsort(key[order])]
    rank = np.zeros(len(text), np.int64)

    def regroup(order, new):
        head = np.flatnonzero(new)
        number = np.repeat(head, np.diff(np.append(head, len(order))))
        rank[order] = number
        return number

    number = regroup(order, np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else order
    h = 8
    done: list[tuple[np.ndarray, np.ndarray]] = []  # numbers and suffixes that stand alone
    while h < depth and len(order):
        step = min(h, depth - h)
        # Only groups of several go on, and of them what is long enough; alone is in place already.
        size = np.bincount(number, minlength=len(rank) + 1)[number]
        alone = (size == 1) & (rest[order] >= depth)
        done.append((number[alone], order[alone]))
        live = (size > 1) & (rest[order] >= h + step)
        order, number = order[live], number[live]
        if not len(order):
            break
        second = rank[order + step]
        sort = np.argsort(number * (len(text) + 1) + second)
        order, number, second = order[sort], number[sort], second[sort]
        new = np.r_[True, (number[1:] != number[:-1]) | (second[1:] != second[:-1])]
        at = np.flatnonzero(new)
        group_at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        start = np.repeat(group_at, np.diff(np.append(group_at, len(number))))
        # A group's numbers stay below the next group's: its head plus the offset within it.
        fresh = number + np.repeat(at, np.diff(np.append(at, len(number)))) - start
        rank[order] = fresh
        number = fresh
        h += step
    keep = rest[order] >= depth
    numbers = np.concatenate([n for n, _ in done] + [number[keep]])
    orders = np.concatenate([o for _, o in done] + [order[keep]])
    sort = np.argsort(numbers * (len(text) + 1) + orders)
    return orders[sort], numbers[sort]


def common_prefixes(text: np.ndarray, begin: np.ndarray, rest: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the prefix, up to limit, that each suffix of order shares with the one before it.

    Kasai's rule: if the suffix at p shares n bytes with its neighbour at q, then
    the one at p + 1 shares n - 1 at least with its own, provided that the suffix
    at q + 1 is sorted too and stands before it. Positions go in text order,
    those of all rows (which begin at begin) in step.
    """
    key = head_keys(text)
    before = np.full(len(text) + 1, -1)
    before[order[1:]] = order[:-1]
    member = np.zeros(len(text) + 1, bool)
    member[order] = True
    shared = np.zeros(len(text), np.int64)
    # Lanes of LANE windows at most, the longest first: those that go on stand at the front.
    count = np.maximum(np.append(begin[1:], len(text)) - begin - limit + 1, 0)
    parts = -(-count // LANE)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, size = np.repeat(begin, parts) + nth * LANE, np.minimum(np.repeat(count, parts) - nth * LANE, LANE)
    lanes = np.argsort(-size, kind="stable")
    start, size = start[lanes], size[lanes]
    last_q, last_n = np.full(len(start), -2), np.zeros(len(start), np.int64)
    for j in range(int(size.max(initial=0))):
        active = np.searchsorted(-size, -j, "left")  # lanes of more than j windows
        p = start[:active] + j
        q = before[p]
        most = np.where(q >= 0, limit, 0)  # all windows have limit bytes at least
        after = last_q[:active] + 1
        # A neighbour that is equal up to the limit may stand on either side one byte on.
        holds = (after == q) | ((last_n[:active] < limit) & (after > 0) & member[np.maximum(after, 0)] & (rest[np.maximum(after, 1) - 1] > 1))
        n = np.minimum(np.where(holds, np.maximum(last_n[:active] - 1, 0), 0), most)
        on = np.flatnonzero(n < most)
        while len(on):
            differ = key[p[on] + n[on]] ^ key[q[on] + n[on]]
            same = 8 - np.searchsorted(_BYTES, differ, "right")  # leading bytes of eight that are equal
            n[on] = np.minimum(n[on] + same, most[on])
            on = on[(same == 8) & (n[on] < most[on])]
        last_q[:active], last_n[:active] = q, n
        shared[p] = n
    return shared[order]


def repeated_windows(text: np.ndarray, begin: np.ndarray, copies: np.ndarray, length: int):
    """Starts of the windows of length bytes within rows, in suffix order; the number of each
    one's class of equal windows; and how many copies the class has."""
    ends = np.append(begin[1:], len(text))
    row = np.repeat(np.arange(len(begin)), ends - begin)
    rest = ends[row] - np.arange(len(text))
    order, _ = suffix_order(text, rest, length)
    if not len(order):
        return order, order, order
    shared = common_prefixes(text, begin, rest, order, length)
    new = shared < length
    new[0] = True
    number = np.cumsum(new) - 1
    total = np.bincount(number, weights=copies[row[order]]).astype(np.int64)
    return order, number, total[number]


# ---- Spark -----------------------------------------------------------------


def _inner(length: int) -> int:
    """Hashes in the inner windows: half of what a window of length bytes has."""
    return (length - GRAM) // 2 + 1


def inner_anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Starts and rows of the inner windows (shorter ones, of which a window of length bytes holds
    many), the place of each one's anchor, and the hashes of all places."""
    grams = byte_gram_hashes(data, GRAM)
    starts, rows = window_rows(offsets, GRAM + _inner(length) - 1)
    return starts, rows, winnow(grams, _inner(length))[starts], grams


def fingerprints(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """The anchor hash of each run of inner windows with one hash, twice if it stands at several places."""
    starts, rows, at, grams = inner_anchors(data, offsets, length)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = grams[at]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
    last = np.append(new[1:], len(h)) - 1
    return np.concatenate((h[new], h[new][at[new] != at[last]]))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, repeats):
    """Anchor hash, first window, number of windows and row of each run of windows with one anchor.

    Only windows in which all inner windows have repeated anchors: equal windows
    have equal inner ones, so no repeated window is left out.
    """
    starts, _, at, grams = inner_anchors(data, offsets, length)
    windows, rows = window_rows(offsets, length)
    none = np.zeros(0, np.int64)
    if not len(windows):
        return np.zeros(0, np.uint64), none, none, none
    bad = np.zeros(len(data) + 1, np.int64)
    bad[starts[~repeats.has(grams[at])] + 1] = 1
    bad = np.cumsum(bad)
    inside = length - (GRAM + _inner(length) - 1) + 1
    good = bad[windows + inside] == bad[windows]
    windows, rows = windows[good], rows[good]
    if not len(windows):
        return np.zeros(0, np.uint64), none, none, none
    least = grams[winnow(grams, length - GRAM + 1)[windows]]
    # Runs go by the hash, not by its place: text that repeats itself stays one run.
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1] + 1)])
    return least[new], windows[new], np.diff(np.append(new, len(windows))), rows[new]


_TRIPLE = 3


def find_spans(source: DataFrame, length: int) -> DataFrame:
    """doc_id, rk, lo, hi: byte ranges to remove; they can overlap. source: as of keyed()."""
    spark = source.sparkSession
    source = source.where(F.octet_length("text") >= length)
    # Equal texts: one of them goes on, all of them go whole.
    own, several = collapse(source)
    repeats = spark.sparkContext.broadcast(find_repeats(own, lambda d, o: fingerprints(d, o, length), 2 / (_inner(length) + 1), ROWS_PER_ANCHOR))
    wholly = source.join(small(several), KEY).select("doc_id", "rk", F.lit(0).cast("long").alias("lo"), F.octet_length("text").cast("long").alias("hi"))

    @released
    def send(batches):
        found = repeats.value
        for batch in batches:
            docs, keys = batch.column("doc_id").to_numpy(), batch.column("rk").to_numpy()
            for low, high, data, offsets in text_blocks(batch.column("text")):
                h, at, count, row = anchors(data, offsets, length, found)
                if not len(h):
                    continue
                deal = found.hot_count(h) // ROWS_PER_ANCHOR + 1
                doc = docs[low:high][row]
                own_key = (doc ^ keys[low:high][row]).astype(np.uint64)
                salt = np.where(deal > 1, ((own_key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % deal, -1)
                raw, groups = data.tobytes(), {}
                place = at - offsets[:-1][row]
                for i, (a, n, x, s) in enumerate(zip(at.tolist(), (count + length - 1).tolist(), h.tolist(), salt.tolist())):
                    groups.setdefault((x, s, raw[a : a + n]), []).append(i)
                members = np.array([i for g in groups.values() for i in g])
                triples = np.stack((doc[members], keys[low:high][row[members]], place[members]), axis=1).astype(np.int64)
                size = np.array([len(g) for g in groups.values()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([g[0] for g in groups], np.uint64).view(np.int64)), pa.array([g[1] for g in groups], pa.int32()), pa.array([g[2] for g in groups], pa.binary()), binary_array(triples.view(np.uint8).ravel(), np.concatenate(([0], np.cumsum(size * 24))))],
                    names=["anchor", "salt", "around", "places"],
                )

    ddl = "anchor long, salt int, around binary, places binary"
    dealt = own.mapInArrow(send, ddl).repartition(shards(source, 8, 16), "anchor", "salt").sortWithinPartitions("anchor", "salt")

    @released
    def search(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "around", "places"))):
                if key[:2] != last:
                    if size >= SHARD_BYTES:
                        yield from _search_shard(rows, length)
                        rows, size = [], 0
                    last = key[:2]
                rows.append(key)
                size += len(key[2])
        if rows:
            yield from _search_shard(rows, length)

    found = cut(dealt.mapInArrow(search, f"{_SPAN}, window binary"), "suffix")
    sure = found.where("window is null").drop("window")
    # Windows in byte order: a range of that order for each task, which Spark sorts and can spill.
    asked = found.where("window is not null").repartition(shards(source, 8, 16), "window").sortWithinPartitions("window")
    return wholly.unionAll(sure).unionAll(asked.mapInArrow(_merge_shards, _SPAN))


def _spans(doc, rk, lo, hi, window=None) -> pa.RecordBatch:
    arrays = [pa.array(x.astype(np.int64)) for x in (doc, rk, lo, hi)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(doc), pa.binary()) if window is None else window], names=["doc_id", "rk", "lo", "hi", "window"])


def _search_shard(rows: list, length: int):
    """Removed ranges of a shard's rows, and of dealt-out anchors the windows that the other shards
    must be asked about: those that stand alone here, and one of each repeated class."""
    distinct: dict[tuple, list[bytes]] = {}
    for anchor, salt, around, places in rows:
        distinct.setdefault((anchor, salt, around), []).append(places)
    places = [b"".join(p) for p in distinct.values()]
    copies = np.array([len(p) // (8 * _TRIPLE) for p in places])
    size = np.array([len(k[2]) for k in distinct])
    text = np.frombuffer(b"".join(k[2] for k in distinct), np.uint8)
    begin = np.cumsum(size) - size
    order, number, total = repeated_windows(text, begin, copies, length)
    row = np.searchsorted(begin, order, "right") - 1
    triples = np.frombuffer(b"".join(places), np.int64).reshape(-1, _TRIPLE)
    first = np.cumsum(copies) - copies
    # Runs of removed windows within a row, then once for each place of the row.
    many = total > 1
    at = np.sort(order[many])
    r = np.searchsorted(begin, at, "right") - 1
    r, a, b = merge_spans(r, at - begin[r], at - begin[r] + length)
    each = ranges(first[r], copies[r])
    run = np.repeat(np.arange(len(r)), copies[r])
    if len(run):
        doc, rk, place = triples[each].T
        yield _spans(doc, rk, place + a[run], place + b[run])
    salt = np.array([k[1] for k in distinct])
    ask = (salt[row] >= 0) & (~many | np.r_[True, number[1:] != number[:-1]])
    w = np.flatnonzero(ask)
    for w in np.array_split(w, -(-len(w) // ASKED) or 1):
        window = binary_array(text[ranges(order[w], np.full(len(w), length))], np.arange(len(w) + 1) * length)
        doc, rk, place = triples[first[row[w]]].T
        lo = place + order[w] - begin[row[w]]
        # A class that is repeated already only tells the others: it is marked by an empty range.
        yield _spans(doc, rk, lo, np.where(many[w], lo, lo + length), window)


def _merge_shards(batches):
    """Windows that stood alone in their shard and that another shard has too.

    The windows of a share come in byte order; binary search gives each one the
    range of its equals. A range that a batch does not end is kept for the next.
    """
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        keys = table.column("window").to_pylist()
        # The last range is open: two rows of it are enough for the rows that are still to come.
        open_from = bisect_left(keys, keys[-1])
        yield from _repeated(table, keys, open_from)
        tail = table.slice(open_from)
        if tail.num_rows > 1:
            yield from _repeated(tail, keys[open_from:], tail.num_rows)
            # All its rows are told of already; an empty range of it says so to the next batch.
            tail = tail.slice(0, 2).set_column(tail.column_names.index("hi"), "hi", tail.column("lo").slice(0, 2))
        kept = tail


def _repeated(table: pa.Table, keys: list[bytes], end: int):
    equal = [bisect_right(keys, k) - bisect_left(keys, k) > 1 for k in keys[:end]]
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    at = np.flatnonzero(np.array(equal, bool) & (hi[:end] > lo[:end]))
    if len(at):
        yield from table.select(["doc_id", "rk", "lo", "hi"]).take(pa.array(at)).combine_chunks().to_batches()


def remove_repeats(docs: DataFrame, length: int = 200, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with carry also
    kept_text, and a struct `rest` of the columns that it names.

    A byte goes if a string of length bytes that covers it also starts anywhere
    else, in the same document too; strings do not cross documents and are
    judged on the input. Null texts are empty. Equal rows are each other's
    copies, whatever their doc_id; a null doc_id stays null. An empty table
    gives no rows; other columns are not read. kept_text drops what removal leaves
    of a cut character; it is null where the text was.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    source = keyed(docs)
    spans = find_spans(source, length)
    if carry:
        source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", F.xxhash64("text"))
    joined = with_spans(source, spans)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields)

    @released
    def finish(batches):
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans")
            for low, high, data, offsets in text_blocks(batch.column("text")):
                row, lo, hi = span_arrays(spans.slice(low, high - low))
                row, lo, hi = merge_spans(row, lo, hi)
                gone = covered(lo + offsets[row], hi + offsets[row], len(data))
                removed = np.bincount(row, weights=hi - lo, minlength=high - low).astype(np.int64)
                flat = data[~gone]
                edge = np.concatenate(([0], np.cumsum(~gone)))[offsets].tolist()
                view = memoryview(flat)
                pieces = [view[a:b] for a, b in zip(edge, edge[1:])]
                columns = [ids.slice(low, high - low), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.bincount(row, minlength=high - low)), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
                if carry:
                    was = batch.column("text").slice(low, high - low).is_valid().to_pylist()
                    columns.append(pa.array([p.tobytes().decode("utf-8", "ignore") if v else None for p, v in zip(pieces, was)], pa.string()))
                    columns.append(batch.column("rest").slice(low, high - low))
                    yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, "kept_text", "rest"])
                else:
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if carry:
        ddl += f", kept_text string, rest {source.schema['rest'].dataType.simpleString()}"
    return joined.mapInArrow(finish, ddl).withColumn("doc_id", given_id())
