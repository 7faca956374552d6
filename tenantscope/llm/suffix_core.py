"""Phrases of a document batch for the suffix-order dedup (numpy, per task)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .rolling import MAX_BUFFER, PrefixHash, ranges, sliding_argmin


class Phrases(NamedTuple):
    """One entry per phrase occurrence, in text order. ``first``/``count``:
    place in the batch buffer of the phrase's first repeat-length string and
    how many start in it; ``trigger``: hash of the gram that the strings
    share; ``mark``: hash of the whole phrase."""
    first: np.ndarray
    count: np.ndarray
    trigger: np.ndarray
    mark: np.ndarray


def buffer_slices(offsets: np.ndarray, length: int, limit: int = MAX_BUFFER // 2):
    """Cut a batch of documents (byte ``offsets``) into (lo, hi) ranges of at
    most ``limit`` bytes, overlapping by ``length - 1`` within a long document,
    so that each string of ``length`` bytes starts in exactly one range."""
    lo, d, n = 0, 0, len(offsets) - 1
    while d < n:
        end = int(np.searchsorted(offsets, lo + limit, "right")) - 1
        if end > d and offsets[end] > lo:
            yield lo, int(offsets[end])
            lo, d = int(offsets[end]), end
        elif offsets[d + 1] - lo <= limit:
            d += 1
        else:
            yield lo, lo + limit
            lo += limit - length + 1


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Phrases:
    """Parse the documents in ``data`` (bounds in ``offsets``). Each string of
    ``length`` bytes belongs to the trigger gram with the smallest hash in it;
    a phrase covers a maximal run of starts with one trigger."""
    out = []
    for lo, hi in buffer_slices(offsets, length):
        part = data[lo:hi]
        if len(part) < length:
            continue
        ph = PrefixHash(part)
        grams = ph.grams(gram)
        arg = sliding_argmin(grams, length - gram + 1)
        # Strings that cross the end of a document belong to none.
        cuts = offsets[(offsets > lo) & (offsets < hi)] - lo
        ok = np.zeros(len(arg) + 1, np.int32)
        if len(cuts):
            np.add.at(ok, np.clip(cuts - length + 1, 0, len(arg)), 1)
            np.add.at(ok, np.clip(cuts, 0, len(arg)), -1)
        starts = np.flatnonzero(np.cumsum(ok[:-1]) == 0)
        if not len(starts):
            continue
        trig = arg[starts]
        new = np.empty(len(starts), bool)
        new[0] = True
        new[1:] = (trig[1:] != trig[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(starts)))
        first = starts[at]
        out.append(Phrases(first + lo, count, grams[trig[at]],
                           ph.spans(first, first + count + (length - 1))))
    if not out:
        z = np.zeros(0, np.int64)
        return Phrases(z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return Phrases(*(np.concatenate(x) for x in zip(*out, strict=True)))


def string_hashes(data: np.ndarray, first: np.ndarray, count: np.ndarray, length: int,
                  limit: int = MAX_BUFFER // 2) -> np.ndarray:
    """Hash of every ``length``-byte string of the given phrases (ascending
    ``first``), phrase by phrase."""
    out, i = [], 0
    while i < len(first):
        lo = int(first[i])
        j = max(i + 1, int(np.searchsorted(first, lo + limit - 4 * length, "right")))
        hi = int(max(first[i:j] + count[i:j])) + length - 1
        g = PrefixHash(data[lo:hi]).grams(length)
        out.append(g[ranges(first[i:j] - lo, count[i:j])])
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
