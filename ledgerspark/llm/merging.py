"""Pair merging of many symbol sequences at once, in ragged numpy arrays."""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1) << 40


class PairTable:
    """Rank of each mergeable pair of symbols, and the symbol that each rank makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        bits = max(10, int(8 * len(keys)).bit_length())
        self.shift, self.mask, self.made = np.uint64(64 - bits), (1 << bits) - 1, made
        self.keys, self.rank = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slot, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):  # open addressing: what finds its slot taken tries the next one
            free = np.flatnonzero(self.keys[slot[rest]] == -1)
            at, one = np.unique(slot[rest[free]], return_index=True)
            put = rest[free[one]]
            self.keys[at], self.rank[at] = keys[put], rank[put]
            rest = np.setdiff1d(rest, put, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
        key = symbols[:-1] << 32 | symbols[1:]
        out = np.full(len(symbols), _NONE, np.int64)
        at = np.flatnonzero(row[:-1] == row[1:])
        key = key[at]
        slot = self._slots(key)
        while len(at):
            there = self.keys[slot]
            hit = there == key
            out[at[hit]] = self.rank[slot[hit]]
            on = np.flatnonzero(~hit & (there != -1))
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
        return out


def merge_all(symbols: np.ndarray, row: np.ndarray, pairs: PairTable, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that survive and their rows, in order.

    In each round every sequence applies its own lowest-rank pair: at every
    place (from the left, if places overlap), or only at the leftmost one.
    Sequences without a pair leave the arrays.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank = pairs.ranks(symbols, row)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(rank, first)
        active = np.repeat(least, np.diff(np.append(first, len(row))))
        open_ = active < _NONE
        if not open_.all():
            done.append((symbols[~open_], row[~open_]))
            symbols, row, rank, active = symbols[open_], row[open_], rank[open_], active[open_]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == active)
        if every:
            run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[within % 2 == 0]
        else:
            at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
        symbols[at] = pairs.made[rank[at]]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, row = symbols[stay], row[stay]
    if not done:
        return symbols, row
    symbols, row = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(row, kind="stable")
    return symbols[order], row[order]
