"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

Code points become classes by one table lookup. A small automaton says before
which code points a piece begins. Its per-code-point transition functions form
a finite monoid, so their composition is associative: all states are found by a
blocked scan over function numbers, without a regular expression. The byte
slices between boundaries feed a cached pair merge; their offsets are kept, and
decoding checks that ids give back the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import kept_by_worker, ranges, released, span_hashes, text_blocks
from .merging import PairTable, merge_all
from .store import given_id, texts

#: Pieces held in a worker's cache before it starts anew.
CACHE_PIECES = 100_000
#: Bytes from which on a piece is merged by a heap instead of in step with others.
LONG_PIECE = 256
#: Bytes of text scanned at a time.
SCAN_BYTES = 1 << 20

# Symbols of the automaton. A white-space character that is the last of its run
# before something else stands alone (or, a plain space, joins what follows).
LETTER, NUMBER, OTHER, TWO, THREE, RUN, SPACE, BLANK = range(8)
_START = 8  # added to a symbol at the first character of a text
# States: what the characters so far leave open.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_RUN, NEED_ONE, NEED_TWO = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins before this character."""
    if symbol >= _START:
        return _step(FRESH, symbol - _START)
    if state == NEED_TWO:
        return NEED_ONE, False
    if state == NEED_ONE:
        return FRESH, False
    if symbol == RUN:
        return IN_RUN, state != IN_RUN
    if symbol == SPACE:
        return AFTER_SPACE, True
    if symbol == BLANK:
        return FRESH, True
    if symbol in (TWO, THREE) and state not in (AFTER_SPACE, IN_OTHERS):
        return (NEED_ONE if symbol == TWO else NEED_TWO), True
    target = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    return target, state not in (target, AFTER_SPACE)


@lru_cache(maxsize=1)
def _tables():
    """Code-point classes; begins[state, symbol]; the monoid's products and functions."""
    classes = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            classes[code] = LETTER
        elif major == "N":
            classes[code] = NUMBER
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    classes[spaces] = RUN
    begins = np.array([[_step(s, y)[1] for y in range(16)] for s in range(8)])
    functions = [tuple(range(8))] + [tuple(_step(s, y)[0] for s in range(8)) for y in range(16)]
    distinct = list(dict.fromkeys(functions))
    numbers = {f: i for i, f in enumerate(distinct)}
    at = 0
    while at < len(distinct):
        for g in list(distinct):
            for product in (tuple(g[x] for x in distinct[at]), tuple(distinct[at][x] for x in g)):
                if product not in numbers:
                    numbers[product] = len(distinct)
                    distinct.append(product)
        at += 1
    size = len(distinct)
    products = np.array([[numbers[tuple(g[x] for x in f)] for g in distinct] for f in distinct], np.uint16)
    of_symbol = np.array([numbers[tuple(_step(s, y)[0] for s in range(8))] for y in range(16)], np.uint16)
    return classes, begins, products.ravel(), size, of_symbol, np.array(distinct, np.uint8)


def _symbols(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    classes = _tables()[0]
    out = classes[codes]
    n = len(codes)
    is_start = np.zeros(n + 1, bool)
    is_start[starts] = True
    is_start[n] = True
    space = out == RUN
    # The last white space before something else of the same text.
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:]
    before &= ~is_start[1:]
    out[before] = BLANK
    out[before & (codes == 0x20)] = SPACE
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        one, two = np.zeros(len(quote), codes.dtype), np.zeros(len(quote), codes.dtype)
        has = (quote + 1 < n) & ~is_start[np.minimum(quote + 1, n)]
        one[has] = codes[quote[has] + 1]
        more = has & (quote + 2 < n) & ~is_start[np.minimum(quote + 2, n)]
        two[more] = codes[quote[more] + 2]
        out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = TWO
        pairs = one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64)
        out[quote[np.isin(pairs, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))]] = THREE
    out[starts] += _START
    return out


def _scan(symbols: np.ndarray, width: int = 256) -> np.ndarray:
    """The state before each character, by a blocked scan of function products."""
    _, _, products, size, of_symbol, functions = _tables()
    n = len(symbols)
    rows = -(-n // width)
    f = np.zeros(rows * width, np.uint16)  # number 0 is the identity
    f[:n] = of_symbol[symbols]
    # One column is one step for all rows: columns lie together in memory.
    f = np.ascontiguousarray(f.reshape(rows, width).T)
    for j in range(1, width):
        f[j] = products[f[j - 1].astype(np.int32) * size + f[j]]
    entry = np.empty(rows, np.uint8)
    state = FRESH
    for i, last in enumerate(f[-1].tolist()):
        entry[i] = state
        state = functions[last, state]
    after = functions[f, entry[None, :]]
    before = np.empty_like(after)
    before[0], before[1:] = entry, after[:-1]
    return before.T.ravel()[:n]


def piece_bounds(text: str, starts: np.ndarray) -> np.ndarray:
    """Indices of the characters before which a piece begins; starts: of non-empty texts within."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbols(codes, starts)
    _, begins, *_ = _tables()
    return np.flatnonzero(begins[_scan(symbols), symbols]), codes


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Ragged:
    """Rows of different lengths in one array that grows at its end."""

    def __init__(self, dtype):
        self.flat, self.start, self.size = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.rows = self.used = 0

    def extend(self, flat: np.ndarray, size: np.ndarray) -> int:
        """Adds rows; gives the number of the first."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.rows + len(size) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        new = slice(self.rows, self.rows + len(size))
        self.start[new], self.size[new] = self.used + np.cumsum(size) - size, size
        self.used, self.rows = self.used + len(flat), self.rows + len(size)
        return new.start

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after another, and where each begins (one more entry closes)."""
        size = self.size[rows]
        return self.flat[ranges(self.start[rows], size)], np.concatenate(([0], np.cumsum(size)))


def _ragged(rows: list[bytes]) -> Ragged:
    out = Ragged(np.uint8)
    out.extend(np.frombuffer(b"".join(rows), np.uint8), np.array([len(x) for x in rows], np.int64))
    return out


class ByteBPE:
    """Encodes and decodes whole texts by a table of merge ranks."""

    def __init__(self, path: str):
        self.ranks = ranks = load_ranks(path)
        size = max(ranks.values()) + 1
        names = [b""] * size
        for token, rank in ranks.items():
            names[rank] = token
        self.vocabulary = _ragged(names)
        self.decimals = _ragged([b"%d " % i for i in range(size)])
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(splits, np.int64).T
        self.pairs = PairTable(left, right, rank, np.arange(size))
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.cache = Ragged(np.int32)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has.

        The pair of least rank goes first, the leftmost of equals.
        """
        whole = [self.ranks.get(p, -1) for p in pieces]
        plain = [i for i, (p, r) in enumerate(zip(pieces, whole)) if r < 0 and len(p) <= LONG_PIECE]
        data = np.frombuffer(b"".join(pieces[i] for i in plain), np.uint8)
        row = np.repeat(np.array(plain, np.int64), [len(pieces[i]) for i in plain])
        ids, row = merge_all(self.single[data], row, self.pairs, every=False)
        rest = [([r] if r >= 0 else self._merge_long(pieces[i]), i) for i, r in enumerate(whole) if r >= 0 or len(pieces[i]) > LONG_PIECE]
        ids = np.concatenate((ids, np.array(list(chain.from_iterable(x for x, _ in rest)), np.int64)))
        row = np.concatenate((row, np.repeat(np.array([i for _, i in rest], np.int64), [len(x) for x, _ in rest])))
        order = np.argsort(row, kind="stable")
        return ids[order], np.bincount(row, minlength=len(pieces))

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over linked parts, for very long pieces."""
        ranks, n = self.ranks, len(piece)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_block(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of the block, where each text's begin (one more entry closes),
        the byte offsets at which pieces begin, and each text's first piece likewise."""
        text = data.decode("utf-8", "surrogatepass")
        filled = offsets[:-1][np.diff(offsets) > 0]
        raw = np.frombuffer(data, np.uint8)
        ascii_only = len(text) == len(data)
        if ascii_only:
            starts = filled
        else:
            starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[filled]
        bounds = np.zeros(0, np.int64)
        if text:
            bounds, codes = piece_bounds(text, starts)
            if not ascii_only:
                width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
                bounds = (np.cumsum(width) - width)[bounds]
        first = np.searchsorted(bounds, offsets)
        ends = np.append(bounds[1:], len(data))[: len(bounds)]
        if len(self.slots) > CACHE_PIECES:
            self.clear()
        # Equal pieces of the block are looked up once. Long ones take a stronger hash.
        h = span_hashes(raw, bounds, ends)
        for i in np.flatnonzero(ends - bounds > 64).tolist():
            h[i] = hash(data[bounds[i] : ends[i]]) & 0xFFFFFFFFFFFFFFFF
        _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        pieces = [data[a:b] for a, b in zip(bounds[one].tolist(), ends[one].tolist())]
        fresh = list(set(pieces).difference(self.slots))
        if fresh:
            ids, size = self.merge(fresh)
            base = self.cache.extend(ids, size)
            self.slots.update(zip(fresh, range(base, base + len(fresh))))
        slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        ids, begin = self.cache.take(slots[inverse])
        return ids, begin[first], bounds, first

    def encode(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        return self.encode_block(data, np.array([0, len(data)], np.int64))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.vocabulary.take(np.asarray(ids, np.int64))[0].tobytes()


@kept_by_worker
def byte_bpe(path: str) -> ByteBPE:
    """One for each Python worker, which keeps its cache from task to task."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with keep_ids
    also ids array<int> and piece_offsets array<int> (bytes at which pieces begin).

    A null text is empty: no tokens, the digests of nothing. Rows are
    independent, so repeated rows give repeated results, a null doc_id stays
    null, an empty table gives no rows, and further columns are not read.
    One pass without a shuffle; a lost task is simply run again.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int32())), ("piece_offsets", pa.list_(pa.int32()))]
        ddl += ", ids array<int>, piece_offsets array<int>"
    schema = pa.schema(fields)

    @released
    def run(batches):
        coder = byte_bpe(path)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for low, high, data, offsets in text_blocks(batch.column("text"), SCAN_BYTES):
                ids, begin, bounds, first = coder.encode_block(data.tobytes(), offsets)
                decimal, decimal_at = coder.decimals.take(ids)
                decoded, decoded_at = coder.vocabulary.take(ids)
                text_of, bytes_of = memoryview(decimal), memoryview(decoded)
                names, backs = [], []
                for lo, hi, a, b in zip(decimal_at[begin[:-1]].tolist(), decimal_at[begin[1:]].tolist(), decoded_at[begin[:-1]].tolist(), decoded_at[begin[1:]].tolist()):
                    names.append(hashlib.sha256(text_of[lo : max(lo, hi - 1)]).hexdigest())
                    backs.append(hashlib.sha256(bytes_of[a:b]).hexdigest())
                columns = [ids_of.slice(low, high - low), pa.array(np.diff(begin)), pa.array(names, pa.string()), pa.array(backs, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    own = bounds - np.repeat(offsets[:-1], np.diff(first))
                    columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts(docs).mapInArrow(run, ddl).withColumn("doc_id", given_id())
