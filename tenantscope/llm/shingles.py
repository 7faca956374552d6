"""Word-shingle sets of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

from .rolling import mix
from .words import SPACED, doc_slices, word_table

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHORT = 0xC2B2AE3D27D4EB4F


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of ``words`` consecutive words; of
    its whole sequence where it has fewer; none without words."""
    out: list[np.ndarray] = []
    for a, b in doc_slices(offsets):
        w, _, n = word_table(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], SPACED)
        h = w.copy()
        for j in range(1, words):
            h = mix(h[:max(len(w) - j, 0)] * _MUL + w[j:])
        at = 0
        for size in n.tolist():
            if size >= words:
                out.append(np.unique(h[at:at + size - words + 1]))
            elif size:
                x = w[at:at + 1].copy()
                for j in range(1, size):
                    x = mix(x * _MUL + w[at + j:at + j + 1])
                out.append(mix(x ^ np.uint64((_SHORT * size) & ((1 << 64) - 1))))
            else:
                out.append(w[:0])
            at += size
    return out


def set_mark(s: np.ndarray) -> int:
    """A 64-bit mark of a set; odd, so never 0."""
    return int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]) | 1
