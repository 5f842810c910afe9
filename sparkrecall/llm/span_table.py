"""A bounded table of byte spans (words of a text), keyed by 128 bits of hash and
worked on in NumPy: spans of a slice are hashed from running sums, and looked up or
inserted all at once by linear probing."""

from __future__ import annotations

import numpy as np

from sparkrecall.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(512, dtype=np.uint64)).reshape(2, 256)


class SpanTable:
    def __init__(self, most: int):
        self.most = most
        self.power = self.inverse = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.bits = max(10, int(2 * self.most).bit_length())
        self.keys, self.check = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            ones = np.full(n + (n >> 2), _BASE, np.uint64)
            ones[0] = 1
            self.power = np.cumprod(ones, dtype=np.uint64)
            ones[1:] = pow(_BASE, -1, 1 << 64)
            self.inverse = np.cumprod(ones, dtype=np.uint64)

    def hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each (non-empty) span of ``raw``."""
        self._powers(len(raw))
        out = []
        for table in _BYTES:
            sums = table[raw]
            sums *= self.power[:len(raw)]
            np.cumsum(sums, out=sums)
            before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
            out.append(mix64((sums[end - 1] - before) * self.inverse[begin]))
        return out[0], out[1]

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The spans' numbers, -1 where unknown."""
        out = np.full(len(h), -1, np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            w = self.number[at]
            hit = (self.keys[at] == h[todo]) & (self.check[at] == c[todo])
            hit &= w >= 0
            out[todo[hit]] = w[hit]
            go = np.flatnonzero(~hit & (w >= 0))
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def insert(self, h: np.ndarray, c: np.ndarray) -> None:
        """Numbers new, distinct spans from ``n`` on."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.number[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.check[at[first]], self.number[at[first]] = h[first], c[first], number[first]
            left = np.ones(len(h), bool)
            left[first] = False
            h, c, number, at = h[left], c[left], number[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def unknown(self, h: np.ndarray, at: np.ndarray, more: int = 0) -> np.ndarray | None:
        """Which spans to learn (one of each), given what ``find`` gave; None if all
        are known. The table is cleared first when they don't fit, or with ``more``."""
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return None
        new = missing[np.unique(h[missing], return_index=True)[1]]
        if self.n and (more or self.n + len(new) > self.most):
            self.clear()
            at[:] = -1
            new = np.unique(h, return_index=True)[1]
        if len(new) > self.most:
            self.most = 2 * len(new)
            self.clear()
        return new


def grown(array: np.ndarray, used: int, need: int) -> np.ndarray:
    """The array, or a copy of its first ``used`` places with room for ``need``."""
    if need <= len(array):
        return array
    out = np.zeros(need + (need >> 1), array.dtype)
    out[:used] = array[:used]
    return out
