"""Vectorised rolling hashes over byte buffers (numpy, per task).

A buffer's prefix sums of ``table[byte] * BASE**i`` (modulo 2**64) give the
hash of any substring from two look-ups: subtract and multiply by the inverse
power. ``BASE`` is odd, so the inverse exists.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240415).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown by doubling and kept per process."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, b in ((0, BASE), (1, _BASE_INV)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(b, m, 1 << 64))])
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x


class PrefixHash:
    """Hashes of substrings of one byte buffer."""

    def __init__(self, data: np.ndarray):
        pw, self._inv = _power_tables(len(data) + 1)
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * pw[:len(data)], out=s[1:])
        self._s = s

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of every k-byte substring, by start."""
        n = len(self._s) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = self._s[k:] - self._s[:n]
        x *= self._inv[:n]
        return mix(x)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of [start, end) for each pair; the length takes part."""
        x = (self._s[end] - self._s[start]) * self._inv[start]
        return mix(x ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


#: Longest buffer that ``sliding_argmin`` takes: an index fits the low bits.
INDEX_BITS = 21
MAX_BUFFER = 1 << INDEX_BITS


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the minimum of every ``width`` consecutive hashes (compared by
    their high bits; the leftmost of equals). Which place of a window wins
    depends on the window's own values only."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(MAX_BUFFER - 1)
    m, w = (x & ~low) | np.arange(len(x), dtype=np.uint64), 1
    while w < width:
        step = min(w, width - w)
        m = np.minimum(m[:len(m) - step], m[step:])
        w += step
    return (m & low).astype(np.int64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .. and so on, concatenated."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)
