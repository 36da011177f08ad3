"""Which 64-bit fingerprints occur more than once in the corpus.

Fingerprints of a batch are sorted, combined, cut to their high bits and sent
as difference-coded blocks to the share of the hash range that they belong to.
Each share counts its own exactly. What comes back has a fixed size whatever
the input: one bit for each slot of a bitmap (set where a fingerprint of the
slot is repeated), a level of frequency for each coarser slot, and the few most
frequent fingerprints. A set bit may be
wrong, a clear one never is; users go on with exact comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import released, text_blocks
from .store import input_bytes, shards

#: Bits of the bitmap at most: 32 MB.
BITMAP_BITS = 28
#: Bits of the table of frequency levels at most: 16 MB.
LEVEL_BITS = 24
#: Frequent fingerprints kept at most: no more can occur more than total / MOST_HOT times.
MOST_HOT = 1 << 20
_FLUSH = 1 << 20


@dataclass
class Repeats:
    bits: np.ndarray
    slot_shift: np.uint64
    value_shift: np.uint64
    levels: np.ndarray  # of frequency, for coarser slots: 0 for fingerprints of less than three occurrences
    level_shift: np.uint64
    hot: np.ndarray  # sorted high bits of frequent fingerprints
    counts: np.ndarray
    hot_above: int

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.slot_shift
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0

    def level(self, h: np.ndarray) -> np.ndarray:
        """How frequent a fingerprint is: 0 if it is not repeated, then rising with the logarithm of its
        count. A function of the fingerprint; now and then too high."""
        return np.where(self.has(h), 1 + self.levels[(h >> self.level_shift).astype(np.int64)].astype(np.int64), 0)

    def hot_count(self, h: np.ndarray) -> np.ndarray:
        """Occurrences of frequent fingerprints, 0 of others."""
        if not len(self.hot):
            return np.zeros(len(h), np.int64)
        value = h >> self.value_shift
        at = np.minimum(np.searchsorted(self.hot, value), len(self.hot) - 1)
        return np.where(self.hot[at] == value, self.counts[at], 0)


def find_repeats(source: DataFrame, fingerprints: Callable, density: float, hot_least: int = 64) -> Repeats:
    """fingerprints(bytes, offsets) gives the uint64 fingerprints of a block of texts, equal
    ones as often as they count; density: about how many come from a byte of text."""
    expected = max(1.0, 2 * input_bytes(source) * density)
    wide = expected > 1 << 29  # 32 bits would be too dense
    dtype, value_bits = (np.uint64, 64) if wide else (np.uint32, 32)
    part_bits = int(math.log2(shards(source, 8, 32)))
    slot_bits = max(part_bits + 3, min(BITMAP_BITS, max(16, math.ceil(math.log2(expected)) + 3)))
    hot_above = max(hot_least, math.ceil(expected / MOST_HOT))
    value_shift, part_shift = np.uint64(64 - value_bits), np.uint64(value_bits - part_bits)

    def flush(parts):
        h = np.sort((np.concatenate(parts) >> value_shift).astype(dtype))
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        values, counts = h[new], np.diff(np.append(new, len(h)))
        part = (values.astype(np.uint64) >> part_shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = zip(first.tolist(), np.append(first[1:], len(values)).tolist())
        cut = [(int(part[a]), np.diff(values[a:b], prepend=dtype(0)).tobytes(), np.minimum(counts[a:b], 65535).astype(np.uint16).tobytes()) for a, b in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "vals", "counts"])

    @released
    def send(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                h = fingerprints(data, offsets)
                if len(h):
                    parts.append(h)
                    size += len(h)
                if size >= _FLUSH:
                    yield flush(parts)
                    parts, size = [], 0
        if size:
            yield flush(parts)

    slice_bits = slot_bits - part_bits
    rank_bits = max(0, min(LEVEL_BITS, slot_bits) - part_bits)

    def count(table: pa.Table) -> pa.Table:
        vals = [np.cumsum(np.frombuffer(v, dtype), dtype=dtype) for v in table.column("vals").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint16) for c in table.column("counts").to_pylist()]).astype(np.int64)
        vals = np.concatenate(vals)
        order = np.argsort(vals, kind="stable")
        vals, counts = vals[order], counts[order]
        new = np.flatnonzero(np.r_[True, vals[1:] != vals[:-1]])
        total, vals = np.add.reduceat(counts, new), vals[new].astype(np.uint64)
        flags = np.zeros(1 << slice_bits, np.uint8)
        many = vals[total > 1]
        flags[((many >> np.uint64(value_bits - slot_bits)) & np.uint64((1 << slice_bits) - 1)).astype(np.int64)] = 1
        ranks = np.zeros(1 << rank_bits, np.uint8)
        often = total > 2
        np.maximum.at(ranks, ((vals[often] >> np.uint64(value_bits - part_bits - rank_bits)) & np.uint64((1 << rank_bits) - 1)).astype(np.int64), np.log2(total[often]).astype(np.uint8))
        hot = total > hot_above
        return pa.table({"levels": pa.array([ranks.tobytes()], pa.binary()), "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()), "hot": pa.array([vals[hot].tobytes()], pa.binary()), "n": pa.array([total[hot].tobytes()], pa.binary())})

    sent = source.select("text").mapInArrow(send, "part int, vals binary, counts binary")
    rows = sent.groupBy("part").applyInArrow(count, "levels binary, part int, bits binary, hot binary, n binary").toArrow()
    bits = np.zeros(1 << (slot_bits - 3), np.uint8)
    levels = np.zeros(1 << (part_bits + rank_bits), np.uint8)
    hot, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part, own, h, n, rank in zip(*(rows.column(c).to_pylist() for c in ("part", "bits", "hot", "n", "levels"))):
        levels[part << rank_bits : (part + 1) << rank_bits] = np.frombuffer(rank, np.uint8)
        bits[part << (slice_bits - 3) : (part + 1) << (slice_bits - 3)] = np.frombuffer(own, np.uint8)
        hot.append(np.frombuffer(h, np.uint64))
        counts.append(np.frombuffer(n, np.int64))
    hot, counts = np.concatenate(hot), np.concatenate(counts)
    order = np.argsort(hot, kind="stable")
    return Repeats(bits, np.uint64(64 - slot_bits), value_shift, levels, np.uint64(64 - part_bits - rank_bits), hot[order], counts[order], hot_above)
