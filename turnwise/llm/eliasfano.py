"""Elias-Fano coding of monotone integer sequences, searched by numpy in bulk.

A value is split into ``low_bits`` low bits, packed, and a high part whose
counts are written in unary. Searches work on the packed words; only a rank
directory (ones before each 64-bit word of the unary part) is made on opening.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_HEAD = 4  # 64-bit words: number of values, low bits, words of the low part, words of the unary part


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing sequence of unsigned 64-bit integers."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    universe = int(v[-1]) + 1 if n else 1
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    low = _pack(v, low_bits)
    high = (v >> U64(low_bits)).astype(np.int64) + np.arange(n)
    words = (int(high[-1]) + 64 if n else 1) // 64 + 1
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[high] = 1
    unary = np.packbits(bits, bitorder="little").view("<u8")
    return np.array([n, low_bits, len(low), words], dtype="<u8").tobytes() + low.tobytes() + unary.tobytes()


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bits of every value, side by side, with a spare word."""
    out = np.zeros(len(v) * width // 64 + 2, dtype=np.uint64)
    if width and len(v):
        low = v & U64((1 << width) - 1)
        at = np.arange(len(v), dtype=np.uint64) * U64(width)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] |= np.bitwise_or.reduceat(low << shift, first)
        over = np.flatnonzero(shift + U64(width) > U64(64))
        out[word[over] + 1] |= low[over] >> (U64(64) - shift[over])
    return out


class EliasFano:
    """A sequence read from ``data`` (64-bit words, possibly memory-mapped)."""

    def __init__(self, data: np.ndarray):
        n, low_bits, low_words, words = (int(x) for x in data[:_HEAD])
        self.n, self.low_bits = n, low_bits
        self.low = data[_HEAD : _HEAD + low_words]
        self.unary = data[_HEAD + low_words : _HEAD + low_words + words]
        self.ones = np.zeros(words + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.unary), out=self.ones[1:])
        self.zeros = 64 * np.arange(words + 1) - self.ones
        self.size = _HEAD + low_words + words

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * U64(self.low_bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        got = self.low[word] >> shift
        up = (self.low[word + 1] << U64(1)) << (U64(63) - shift)
        return (got | up) & U64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of the unary part."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        word = np.minimum(word, len(self.unary) - 1)
        rest = (k - before[word]).astype(np.uint64)
        bits = self.unary[word] if one else ~self.unary[word]
        at = np.zeros(len(k), dtype=np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((bits >> at) & U64((1 << step) - 1)).astype(np.uint64)
            go = part <= rest
            rest -= np.where(go, part, U64(0))
            at += np.where(go, U64(step), U64(0))
        return word * 64 + at.astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        i = np.asarray(i, dtype=np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << U64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x; n if there is none."""
        x = np.asarray(x, dtype=np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), dtype=np.int64) + self.n
        high, low = (x >> U64(self.low_bits)), x & U64((1 << self.low_bits) - 1)
        past = high >= U64(int(self.zeros[-1]))  # beyond the unary part
        high = np.where(past, U64(0), high).astype(np.int64)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        end = self._select(high, False) - high
        lo, hi = begin, end
        active = np.flatnonzero(lo < hi)
        lo, hi = lo.copy(), hi.copy()
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            less = self._low(mid) < low[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        return np.where(past, self.n, np.minimum(lo, self.n))
