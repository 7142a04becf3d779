"""An FM-index over a sequence of numbers, in numpy: suffix order, wavelet-matrix ranks, backward
search of many patterns at once, and locating by sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order.

    0 separates; each separator counts as a symbol of its own, in order of place, below all
    others, and the last symbol must be one. Groups of suffixes that agree in ``h`` symbols are
    sorted by the groups of the suffixes ``h`` further on, with ``h`` doubling; those that stand
    alone are left out from then on.
    """
    n = len(symbols)
    separator = symbols == 0
    first = np.where(separator, np.cumsum(separator) - 1, symbols.astype(np.int64) + int(separator.sum()))
    order = np.argsort(first, kind="stable")
    rank, active = _regroup(first[order], np.arange(n))
    place = np.empty(n, np.int64)
    place[order] = rank
    h = 1
    while len(active):
        at = order[active]
        key = place[at] * (n + 1) + place[at + h]
        by = np.argsort(key)
        at = at[by]
        order[active] = at
        rank, still = _regroup(key[by], active)
        place[at] = rank
        active = still
        h *= 2
    return order


def _regroup(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the slot of each one's first equal, and the slots that aren't alone."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    alone = new & np.append(new[1:], True)
    return slots[np.flatnonzero(new)[np.cumsum(new) - 1]], slots[~alone]


class Bits:
    """Bits with the number of ones before each place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: a level of bits for each binary digit of the values, highest first."""

    def __init__(self, values: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        for k in range(self.depth - 1, -1, -1):
            bit = (values >> k) & 1 == 1
            self.levels.append(Bits(bit))
            values = np.concatenate((values[~bit], values[bit]))
            self.zeros.append(int(len(bit) - bit.sum()))
        self.starts = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        return self._walk(symbol, at) - self.starts[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``at``, and how often each stands before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(at) == 1, bits.ones(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.starts[symbol]


class FMIndex:
    """Index of runs of symbols 1 to ``size`` - 1, each followed by a 0.

    Every ``step``-th position of a run, its first one included, is sampled, so walking to a
    sample never crosses a separator.
    """

    def __init__(self, symbols: np.ndarray, size: int, step: int = 8):
        n = len(symbols)
        self.n, self.size = n, size
        if not n:
            return
        order = suffix_order(symbols)
        counts = np.bincount(symbols, minlength=size)
        self.first = np.cumsum(counts) - counts
        self.bwt = Wavelet(np.where(order > 0, symbols[order - 1], 0).astype(np.int64), size)
        start = np.flatnonzero(np.concatenate(([True], symbols[:-1] == 0)))
        run = np.repeat(start, np.diff(np.append(start, n)))
        sampled = (np.arange(n) - run) % step == 0
        self.sampled = Bits(sampled[order])
        self.samples = order[sampled[order]]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows from and to of each pattern (a line of the matrix, all of one length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        left = np.arange(len(patterns)) if self.n else np.zeros(0, np.int64)
        if not self.n:
            high[:] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[left, k]
            low[left] = self.first[symbol] + self.bwt.rank(symbol, low[left])
            high[left] = self.first[symbol] + self.bwt.rank(symbol, high[left])
            left = left[low[left] < high[left]]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern number and position of every occurrence."""
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        ends = np.cumsum(sizes)
        row = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - sizes), sizes)
        position, walked = np.zeros(len(row), np.int64), 0
        left = np.arange(len(row))
        while len(left):
            here = self.sampled.get(row) == 1
            position[left[here]] = self.samples[self.sampled.ones(row[here])] + walked
            left, row = left[~here], row[~here]
            symbol, rank = self.bwt.access(row) if len(row) else (row, row)
            row = self.first[symbol] + rank
            walked += 1
        return which, position
