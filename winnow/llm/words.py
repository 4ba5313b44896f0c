"""Vectorised splitting and hashing of words, straight on Arrow string buffers.

A word is a maximal run of bytes other than space and the controls 0x09 to 0x0D, which for UTF-8 is
the same as ``[^\\x20\\x09-\\x0D]+`` on code points.  A word's identity is a 64-bit polynomial hash of
its bytes, finished by a bijective mixer; two different words share one with probability 2**-64.
Everything works on slices of about ``SLICE_BYTES`` of text, so that memory stays bounded by the
slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_exact = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_folded = _exact.copy()
_folded[65:91] = _exact[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose outputs look independent."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((BASE, INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a slice of texts: ``start`` and ``end`` index ``data``; ``first[d]:first[d + 1]``
    are the words of text d."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base = int(bounds[0])
        self.data = np.frombuffer(data, np.uint8)[base : int(bounds[-1])] if data and bounds[-1] > base else np.zeros(0, np.uint8)
        self.bounds = bounds - base
        solid = ~_space[self.data]
        opens, closes = np.empty(len(solid), bool), np.empty(len(solid), bool)
        if len(solid):
            opens[0], opens[1:] = True, ~solid[:-1]
            closes[-1], closes[:-1] = True, ~solid[1:]
            inner = self.bounds[(self.bounds > 0) & (self.bounds < len(solid))]
            opens[inner] = True
            closes[inner - 1] = True
        self.start = np.flatnonzero(solid & opens)
        self.end = np.flatnonzero(solid & closes) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.counts = np.diff(self.first)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """One 64-bit hash a word; ``fold`` takes A-Z as a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _power(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((_folded if fold else _exact)[self.data] * up[:-1], out=sums[1:])
            value = (sums[self.end] - sums[self.start]) * down[self.start]
            return mix(value + (self.end - self.start).astype(np.uint64))

    def texts(self) -> list[bytes]:
        """Each word's bytes."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words; none if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = words[:m].copy()
        for i in range(1, n):
            x *= BASE
            x += words[i : i + m]
        return mix(x)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most SLICE_BYTES of text, or of one row."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto
    pa.default_memory_pool().release_unused()
