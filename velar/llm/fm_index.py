"""An FM-index over a sequence of small integers: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class RankBits:
    """A bit vector with ones counted before every 64th position."""

    def __init__(self, bits: np.ndarray) -> None:
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Levels of one bit each, the highest first; below a level, zeros come before ones (the levelwise layout)."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((values >> shift) & 1).astype(bool)
            self.levels.append((shift, len(bits) - int(bits.sum()), RankBits(bits)))
            values = np.concatenate((values[~bits], values[bits]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        first = np.zeros_like(i)
        for shift, zeros, bits in self.levels:
            one = (symbol >> shift) & 1 == 1
            ri, rf = bits.rank(i), bits.rank(first)
            i, first = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rf, first - rf)
        return i - first

    def get(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for _, zeros, bits in self.levels:
            b, r = bits.get(i), bits.rank(i)
            symbol, i = 2 * symbol + b, np.where(b == 1, zeros + r, i - r)
        return symbol


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling; a shorter suffix comes before its extensions."""
    n = len(values)
    _, rank = np.unique(values, return_inverse=True)
    rank, k = rank.astype(np.int64) + 1, 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] if k < n else 0
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))
        rank[order] = new
        if new[-1] == n or k >= n:
            return order
        k *= 2


class FMIndex:
    """Of values from 1 to symbols - 1. Zero is the end mark, which the index adds."""

    def __init__(self, values: np.ndarray, symbols: int, sample: int = 16) -> None:
        text = np.append(values.astype(np.int64), 0)
        suffixes = suffix_array(text)
        last = text[suffixes - 1]
        self.n = len(text)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.tree = WaveletTree(last, symbols)
        sampled = suffixes % sample == 0
        self.sampled, self.positions = RankBits(sampled), suffixes[sampled]

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns at once: the range of suffixes that begin with each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        lengths = np.array([len(p) for p in patterns], np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            at = np.flatnonzero((lengths >= back) & (low < high))
            if not len(at):
                break
            symbol = np.array([patterns[i][-back] for i in at], np.int64)
            both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low[at], high[at])))
            low[at], high[at] = self.starts[symbol] + both[: len(at)], self.starts[symbol] + both[len(at) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: steps back to a sampled suffix, whose position is stored."""
        rows, out, open_, steps = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            now = rows[open_]
            done = self.sampled.get(now) == 1
            out[open_[done]] = self.positions[self.sampled.rank(now[done])] + steps
            open_, now = open_[~done], now[~done]
            symbol = self.tree.get(now)
            rows[open_] = self.starts[symbol] + self.tree.rank(symbol, now)
            steps += 1
        return out
