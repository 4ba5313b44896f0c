"""A compressed FM-index over integer sequences: bit-packed wavelet levels with rank directories."""

from __future__ import annotations

import numpy as np


def order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` (rounded up to a power of two) symbols
    by prefix doubling.  That is enough to search patterns shorter than that."""
    n = len(text)
    rank = text.astype(np.int64)
    done = 1
    while done < depth:
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        at = np.argsort(key, kind="stable")
        ordered = key[at]
        rank = np.empty(n, np.int64)
        rank[at] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]) if n else 0
        done *= 2
    return np.argsort(rank, kind="stable")


class Bits:
    """A bit vector in 64-bit words with counts before each word; ``rank`` counts ones before i."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))[:-1]].astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low).astype(np.int64)


class Wavelet:
    """Wavelet matrix: one bit vector for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray):
        self.height = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.height - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i places; ``start`` is where its run begins in
        the last level."""
        for level, bits, zeros in zip(range(self.height - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i - start

    def starts(self, count: int) -> np.ndarray:
        symbol, i = np.arange(count), np.zeros(count, np.int64)
        return self.rank(symbol, i, np.zeros(count, np.int64))


class FMIndex:
    """Backward search over a text of symbols 1 and above, with 0 between its parts."""

    def __init__(self, text: np.ndarray, depth: int):
        self.suffixes = order(text, depth + 1)
        self.length = len(text)
        self.wavelet = Wavelet(text[self.suffixes - 1])
        count = int(text.max(initial=0)) + 1
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=count))]
        self.starts = self.wavelet.starts(count)

    def matches(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, capped at ``depth``, of what ends before each of ``ends``: the
        length, and the interval of suffixes that begin with it.  A search stops as soon as one
        suffix is left: in a text that is indexed itself, that one is its own."""
        symbol = text[ends - 1]
        low, high = self.smaller[symbol], self.smaller[symbol + 1]
        length = np.ones(len(ends), np.int64)
        live = np.flatnonzero(high - low > 1)
        for step in range(2, depth + 1):
            symbol = text[ends[live] - step]
            both = self.wavelet.rank(np.r_[symbol, symbol], np.r_[low[live], high[live]], np.r_[self.starts[symbol], self.starts[symbol]])
            a, b = self.smaller[symbol] + both[: len(live)], self.smaller[symbol] + both[len(live) :]
            found = (b > a) & (symbol > 0)
            at = live[found]
            low[at], high[at], length[at] = a[found], b[found], step
            live = live[found & (b - a > 1)]
        return length, low, high


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value in each interval; intervals are the same or disjoint."""
    if not len(low):
        return np.zeros(0, values.dtype)
    start, place = np.unique(low, return_inverse=True)
    end = np.zeros(len(start), np.int64)
    end[place] = high
    cuts = np.stack([start, end], 1).ravel()
    padded = np.r_[values, values[-1:]]
    return np.minimum.reduceat(padded, cuts)[::2][place]
