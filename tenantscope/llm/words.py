"""Words of many texts at once (numpy, per task): spans and hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from .rolling import PrefixHash


def _table(chars: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(chars)] = False
    return t


#: Bytes of words. ``SPACED``: all but blank, tab, line and page breaks.
#: ``ALNUM``: ASCII letters, digits and every non-ASCII byte.
SPACED = _table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

#: Longer words are known by a digest: modulo 2**64 the rolling hash is the same
#: for some pairs of different strings of 1,024 bytes and more.
LONG = 64

#: Bytes of documents that are read at a time: a task holds some thirty bytes for
#: each, and its worker keeps the powers of the rolling hash for as many.
SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_table(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray,
               limit: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents in ``data`` (UTF-8, bounds in ``offsets``), A-Z
    lower-cased: hash of each word, its document, and words per document.
    Words never cross documents. Longer data is read in pieces of about
    ``limit`` bytes, cut between words."""
    hashes, firsts, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + limit)
        while hi < len(data) and is_word[data[hi]]:  # to the end of the word
            gap = np.flatnonzero(~is_word[data[hi:hi + limit]])
            hi = hi + int(gap[0]) if len(gap) else min(len(data), hi + limit)
        h, first = _words(data[lo:hi], offsets[(offsets >= lo) & (offsets <= hi)] - lo, is_word)
        hashes.append(h)
        firsts.append(first + lo)
        lo = hi
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, first, "right") - 1
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), doc,
            np.bincount(doc, minlength=len(offsets) - 1))


def _words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; ``bounds`` are places no word crosses."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[low]
    start = np.empty(len(data) + 1, bool)
    start[0] = True
    start[1:] = ~inside[:-1]
    start[bounds] = True
    first = np.flatnonzero(start & inside)
    # A word ends before the first byte that is not its own, or at a bound.
    stop = ~inside
    stop[bounds] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, first, "right")]
    h = PrefixHash(low).spans(first, end)
    for i in np.flatnonzero(end - first > LONG).tolist():
        h[i] = int.from_bytes(blake2b(low[first[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h, first


def doc_slices(offsets: np.ndarray, limit: int = SLICE):
    """Cut a batch into (from, to) document ranges of about ``limit`` bytes; a
    longer document makes a range of its own."""
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + limit, "right")) - 1)
        yield d, e
        d = e
