"""Elias-Fano coded monotone lists over NumPy buffers, read in place (also memory-mapped)."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word, halving six times."""
    place = np.zeros(len(word), np.int64)
    k = k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = word & _U((1 << half) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        right = k >= ones
        k = np.where(right, k - ones, k)
        word = np.where(right, word >> _U(half), low)
        place += np.where(right, half, 0)
    return place


class EliasFano:
    """A sorted list of integers: low bits packed, high bits in unary with a count per word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        """``values``: sorted, unsigned below ``universe`` (at most 2**64)."""
        v = np.ascontiguousarray(values, np.uint64)
        n = len(v)
        low_bits = max(0, min(57, (universe // max(n, 1)).bit_length() - 1))
        high = (v >> _U(low_bits)).astype(np.int64) + np.arange(n) if n else np.empty(0, np.int64)
        length = (universe - 1 >> low_bits) + 1 + n + 1
        words = np.zeros(-(-length // 64), np.uint64)
        np.bitwise_or.at(words, high >> 6, _U(1) << (high & 63).astype(np.uint64))
        packed = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            low = v & _U((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * low_bits
            at, off = bit >> 6, (bit & 63).astype(np.uint64)
            np.bitwise_or.at(packed, at, low << off)
            over = np.flatnonzero(off + _U(low_bits) > _U(64))
            np.bitwise_or.at(packed, at[over] + 1, low[over] >> (_U(64) - off[over]))
        counts = np.bitwise_count(words).astype(np.int64)
        return EliasFano(n, low_bits, packed, words, np.cumsum(counts) - counts)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, ones = arrays
        return EliasFano(int(head[0]), int(head[1]), low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        at, off = bit >> 6, (bit & 63).astype(np.uint64)
        v = self.low[at] >> off
        over = off + _U(self.low_bits) > _U(64)
        v = np.where(over, v | self.low[at + 1] << np.where(over, _U(64) - off, _U(0)), v)
        return v & _U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values (unsigned)."""
        i = np.asarray(i, np.int64)
        w = np.searchsorted(self.ones, i, side="right") - 1
        place = w * 64 + _select_in_word(self.high[w], i - self.ones[w])
        return (place - i).astype(np.uint64) << _U(self.low_bits) | self._low(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below h: the place of the (h-1)-th zero tells."""
        k = h - 1
        w = np.searchsorted(self.zeros, np.maximum(k, 0), side="right") - 1
        place = w * 64 + _select_in_word(~self.high[w], np.maximum(k, 0) - self.zeros[w])
        return np.where(h > 0, place - k, 0)

    def search(self, x: np.ndarray) -> np.ndarray:
        """Where each x stands, or -1: a binary search among the values of its high part."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        h = (x >> _U(self.low_bits)).astype(np.int64)
        low = x & _U((1 << self.low_bits) - 1)
        lo = self._below(h)
        end = hi = self._below(h + 1)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self._low(np.minimum(mid, self.n - 1)) < low)
            lo, hi = np.where(less, mid + 1, lo), np.where((lo < hi) & ~less, mid, hi)
        found = (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == low)
        return np.where(found, lo, -1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one buffer of 8-byte units, with their types and lengths in front."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        data = raw.tobytes()
        head += ["ui".index(raw.dtype.kind) * 100 + raw.dtype.itemsize, len(raw)]
        body.append(data + b"\0" * (-len(data) % 8))
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unpack(buffer) -> list[np.ndarray]:
    count = int(np.frombuffer(buffer, np.int64, 1)[0])
    head = np.frombuffer(buffer, np.int64, 2 * count, 8).reshape(-1, 2)
    at, out = 8 + 16 * count, []
    for kind, n in head.tolist():
        out.append(np.frombuffer(buffer, f"{'ui'[kind // 100]}{kind % 100}", n, at))
        at += -(-n * (kind % 100) // 8) * 8
    return out
