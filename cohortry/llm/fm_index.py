"""An FM-index over word numbers in numpy: suffix order, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits with constant-time counts of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Symbols by bit planes from the highest bit, zeros moved before ones at every plane."""

    def __init__(self, symbols: np.ndarray):
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(symbols.max(initial=0)).bit_length()) - 1, -1, -1):
            plane = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitRank(plane)))
            self.zeros.append(int(len(plane) - plane.sum()))
            symbols = np.concatenate([symbols[~plane], symbols[plane]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before at."""
        lo, hi = np.zeros_like(at), at
        for (bit, plane), zeros in zip(self.levels, self.zeros, strict=True):
            one = symbol >> bit & 1 == 1
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its occurrences before that place."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for (bit, plane), zeros in zip(self.levels, self.zeros, strict=True):
            one = plane.get(hi)
            symbol |= one.astype(at.dtype) << bit
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return symbol, hi - lo


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; every 0 ends a run and is a symbol of its own, lower than all words."""
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    n, step, open_ = len(symbols), 1, np.arange(len(symbols))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
    # rank: place of the first suffix of equal prefix; only suffixes that share theirs are sorted further.
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while True:
        alone = head & np.r_[head[1:], True]
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        open_ = order[places]
        after = open_ + step
        key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[places], key = open_[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        head[places] = new
        rank[order[places]] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class FMIndex:
    """Index of runs of word numbers, each run ended by a 0. Finds whole patterns that hold no 0."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        order = suffix_order(symbols)
        self.size = len(symbols)
        previous = np.where(order > 0, symbols[order - 1], 0)
        self.ranks = WaveletMatrix(previous.astype(np.int64))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 1))])
        starts = np.r_[True, symbols[:-1] == 0]
        marked = starts[order] | (order % sample == 0)  # run starts too, so that no walk crosses a 0
        self.marked, self.sampled = BitRank(marked), order[marked]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each pattern: a row of word numbers, of which the first lengths count."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((back <= lengths) & (lo < hi))
            symbol = patterns[live, lengths[live] - back].astype(np.int64)
            known = symbol < len(self.below) - 1
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            lo[live] = self.below[symbol] + self.ranks.rank(symbol, lo[live])
            hi[live] = self.below[symbol] + self.ranks.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their places: walks back to a sampled one."""
        out, walked, left, at = np.empty_like(at), 0, np.arange(len(at)), at.copy()
        while len(left):
            hit = self.marked.get(at)
            out[left[hit]] = self.sampled[self.marked.ones(at[hit])] + walked
            left, at = left[~hit], at[~hit]
            symbol, rank = self.ranks.access(at)
            at, walked = self.below[symbol] + rank, walked + 1
        return out
