"""Array kernels over Arrow text columns, shared by the text operators.

Everything works on the UTF-8 bytes of whole columns: words, hashes and
windows of thousands of documents are found by a few numpy passes, and no
Python object is made per word. Work is cut into blocks of bounded bytes (one
longer document is a block of its own), which bounds a worker's memory.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Stands for a null document id inside operators; it sorts before all others.
NULL_ID = -(1 << 63)

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_COMBINE = np.uint64(0xD6E8FEB86659FD93)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INDEX_BITS = np.uint64(28)
_INDEX_MASK = np.uint64((1 << 28) - 1)

#: Bytes of words of ASCII letters, digits and every non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of words that end at ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z and leaves all else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_worker_caches: list = []


def kept_by_worker(make):
    """make() with its results kept from task to task, until the worker runs another module's tasks."""
    cached = functools.lru_cache(maxsize=2)(make)
    _worker_caches.append((make.__module__, cached))
    return cached


def released(run):
    """A function of Arrow batches that gives the worker's free memory back when its task ends: workers
    are kept, and what one holds for nothing its executor lacks."""

    @functools.wraps(run)
    def inner(batches):
        for module, cached in _worker_caches:
            if module != run.__module__:
                cached.cache_clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return inner


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges whose bytes stay within the limit, one row at least each."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(rows, max(low + 1, high))
        yield low, high
        low = high


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, past row, bytes, offsets) for each block of the column."""
    data, offsets = text_buffer(column)
    for low, high in blocks(offsets, limit):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of words, and for each row its first word's index (one more entry closes)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[offsets < len(data)]
    starts[edge] = inside[edge]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; kept up to block size only."""
    for size, tables in _powers.items():
        if size >= n:
            return tables
    size = max(n, BLOCK_BYTES + 1)
    up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    tables = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size == BLOCK_BYTES + 1:
        _powers[size] = tables
    return tables


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _MIX_A
    h ^= h >> np.uint64(27)
    h *= _MIX_B
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, down = _power_tables(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on; shorter by k - 1 than data."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, down = _power_tables(len(data) + 1)
    return mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _COMBINE
        h += words[j : j + n]
    return mix(h)


def window_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-item windows that lie within one row, and the rows; first as of word_spans."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][rows] + within, rows


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    step, cur, n = 1, a, len(a) - w + 1
    while 2 * step <= w:
        cur = np.minimum(cur[:-step], cur[step:])
        step *= 2
    return np.minimum(cur[:n], cur[w - step : w - step + n])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the index of its least one, the last of equals."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    index = np.arange(len(h), dtype=np.uint64)
    key = (h & ~_INDEX_MASK) | (_INDEX_MASK - index)
    return (_INDEX_MASK - (sliding_min(key, w) & _INDEX_MASK)).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of size positions lie in any of the spans."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def merge_spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Unions of touching or overlapping spans [lo, hi) within each row."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    # A running maximum per row: rows are kept apart by an offset beyond any end.
    step = int(hi.max()) + 1
    rank = np.cumsum(np.r_[0, row[1:] != row[:-1]])
    top = np.maximum.accumulate(hi + rank * step)
    new = np.r_[True, (lo[1:] + rank[1:] * step) > top[:-1]]
    new[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(new)
    end = top[np.r_[at[1:], len(row)] - 1] - rank[at] * step
    return row[at], lo[at], end


def binary_array(chunks: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binary rows from one uint8 buffer; bounds has one entry more than rows."""
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(chunks))]
    )
