"""A compressed FM-index over integer words in numpy, searched for many patterns at once.

The Burrows-Wheeler transform is kept as a wavelet matrix: one packed bit vector per bit of the
alphabet with a running count for every 64 bits, so rank is one lookup and one popcount a level.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class WaveletMatrix:
    """Rank of any symbol in a sequence over 0 .. size-1."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[BitRank] = []
        self.zeros: list[int] = []
        for shift in range(self.depth - 1, -1, -1):
            bits = (sequence >> shift & 1).astype(np.uint8)
            level = BitRank(bits)
            self.levels.append(level)
            self.zeros.append(len(sequence) - level.ones)
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before low and before high."""
        base = np.zeros_like(low)
        for level, zeros, shift in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1), strict=True):
            one = (symbol >> shift & 1).astype(bool)
            a, b, c = level.rank(base), level.rank(low), level.rank(high)
            base = np.where(one, zeros + a, base - a)
            low = np.where(one, zeros + b, low - b)
            high = np.where(one, zeros + c, high - c)
        return low - base, high - base


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``depth`` symbols or more (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    span = 1
    while True:
        key = rank * (n + 1)
        key[:max(0, n - span)] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, span = new, span * 2
        if span >= depth or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Index of pieces of words.  Symbol 0 separates pieces, so no match crosses a border.

    Patterns longer than ``depth`` must not be searched: the suffixes are sorted that deep only.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int):
        self.alphabet, dense = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths)
        self.text = np.insert(dense.astype(np.int64) + 1, ends, 0)
        self.place = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        size = len(self.alphabet) + 1
        self.depth = depth
        self.order = suffix_order(self.text, depth)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=size))])
        self.tree = WaveletMatrix(self.text[self.order - 1], size)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for a word the index lacks."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def search(self, symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of ``length`` symbols before each end, all ends in step.

        Returns the matched length (the matching statistic, capped at ``length``) and the suffix range
        of that match.  Patterns must not reach before the start of ``symbols``.
        """
        if length > self.depth:
            raise ValueError("pattern longer than the sorted depth")
        matched = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        live = np.arange(len(ends))
        for step in range(1, length + 1):
            symbol = symbols[ends[live] - step]
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            a, b = self.tree.rank(symbol, low[live], high[live])
            a, b = self.counts[symbol] + a, self.counts[symbol] + b
            found = a < b
            live = live[found]
            low[live], high[live], matched[live] = a[found], b[found], step
        return matched, low, high
