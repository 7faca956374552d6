"""Operator 9: language identification by rank-order n-gram profiles.

A language's profile lists its most frequent character n-grams (1 to 3
characters; a word's ends count as a character) in order of frequency, over
the whole texts of all learning documents. A document's own list is compared
with each profile: the out-of-place distance adds, for every n-gram of the
document's list, how far its rank is from its rank in the profile, or the
profile's length where the profile lacks it. The nearest language wins.

Counting is a partial aggregate per Arrow batch in numpy and a Spark sum per
(language, n-gram). The profiles, ``size`` rows a language, go to every task.
An n-gram is known by 40 bits of a hash of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blobs import text_buffer, tidied, with_text_columns
from .rolling import mix
from .words import doc_slices

#: N-grams in a profile and in a document's list.
SIZE = 400
UNKNOWN = "und"
#: Beyond this distance a text is unlike every learned language.
REJECT_DISTANCE = 0.9
_BITS = np.uint64(40)
#: Documents and n-grams of one slice that fit beside a count in 64 bits.
_MAX_DOCS, _COUNT_BITS, _PLACE_BITS = 1 << 12, 24, 27
#: Bytes that are counted at a time (about two hundred are held for each), and
#: beyond twice how many a text is cut between words.
_SLICE, _PIECE = 1 << 16, 1 << 19
#: Counts that wait to be merged.
_PENDING = 1 << 18

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: its lower case (where that is one character) if it
    is a letter, else 0."""
    if not _tables:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables.append(t)
    return _tables[0]


def _ngrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of the documents: their hash, their document, and how many
    letters each document has."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    # A code point starts at every byte that is no continuation byte.
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    cuts = lead[offsets]
    if cuts[-1] != len(points):
        raise ValueError("texts are not UTF-8")
    low = _letters()[points]
    doc = np.repeat(np.arange(n), np.diff(cuts))
    n_letters = np.bincount(doc[low > 0], minlength=n)
    # One bound (0) between words, and one at each end of a document.
    keep = low > 0
    first = np.ones(len(low), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep[1:] |= (low[:-1] > 0) & ~first[1:]
    seq, of = low[keep], doc[keep]
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1])[:len(of)])
    pad = np.insert(seq, head, 0)
    of = np.insert(of, head, of[head])
    tail = np.flatnonzero(np.append(of[1:] != of[:-1], True)[-len(of):] & (pad > 0))
    pad, of = np.insert(pad, tail + 1, 0).astype(np.uint64), np.insert(of, tail + 1, of[tail])
    s = np.uint64(21)
    two = (pad[:-1] << s) | pad[1:]
    same2 = of[:-1] == of[1:]
    three = (two[:-1] << s) | pad[2:]
    ok1, ok2 = pad > 0, same2 & ((pad[:-1] > 0) | (pad[1:] > 0))
    ok3 = same2[:-1] & same2[1:] & (pad[1:-1] > 0)
    key = np.concatenate([pad[ok1], two[ok2] | np.uint64(1 << 63), three[ok3]])
    return mix(key) >> (np.uint64(64) - _BITS), np.concatenate([of[ok1], of[:-1][ok2], of[:-2][ok3]]), n_letters


def _pieces(offsets: np.ndarray, data: np.ndarray):
    """The documents in pieces of about ``_SLICE`` bytes: (offsets, bytes,
    document of each offset). A text of more than twice ``_PIECE`` is cut after a byte that is
    no letter, which changes no n-gram; only a word of more than an eighth of
    a piece can be cut itself."""
    for lo, hi in _slices(offsets):
        if offsets[hi] - offsets[lo] <= 2 * _PIECE:
            yield offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]], np.arange(lo, hi)
            continue
        at, end = int(offsets[lo]), int(offsets[hi])  # one document
        while at < end:
            cut = min(end, at + _PIECE)
            if cut < end:
                tail = data[cut - _PIECE // 8:cut]
                gap = np.flatnonzero(tail <= 0x40)
                lead = np.flatnonzero((tail & 0xC0) != 0x80)
                cut = cut - _PIECE // 8 + (int(gap[-1]) + 1 if len(gap) else int(lead[-1]))
            yield np.array([0, cut - at]), data[at:cut], np.array([lo])
            at = cut


def _counts(group: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, gram) in order, with their counts."""
    x = np.sort((group.astype(np.uint64) << _BITS) | gram)
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[:len(x)])
    return (x[at] >> _BITS).astype(np.int64), x[at] & np.uint64((1 << 40) - 1), np.diff(np.append(at, len(x)))


def _slices(offsets: np.ndarray):
    for lo, hi in doc_slices(offsets, min(_SLICE, _PIECE)):
        for a in range(lo, hi, _MAX_DOCS):
            yield a, min(hi, a + _MAX_DOCS)


def _merge(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of several pieces as one, in order of (group, gram)."""
    if len(found) == 1:
        return found[0]
    group, gram, n = (np.concatenate(x) for x in zip(*found, strict=True))
    x = (group.astype(np.uint64) << _BITS) | gram
    order = np.argsort(x, kind="stable")
    at = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1])[:len(x)])
    return group[order][at], gram[order][at], np.add.reduceat(n[order], at) if len(at) else n


def _batch_counts(offsets: np.ndarray, data: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Counts of each (code, n-gram) over all documents, merged now and then."""
    found, pending = [], 0
    for cuts, part, doc in _pieces(offsets, data):
        gram, piece, _ = _ngrams(cuts, part)
        found.append(_counts(code[doc][piece], gram))
        pending += len(found[-1][2])
        if pending > _PENDING:
            found, pending = [_merge(found)], 0
    return _merge(found) if found else None


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n``: n-gram counts of each language over all of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(0))
            codes = b.column(1).dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            counts = _batch_counts(offsets, data, code)
            if counts:
                lang, gram, n = counts
                yield pa.record_batch([codes.dictionary.take(pa.array(lang)), pa.array(gram.astype(np.int64)),
                                       pa.array(n)], names=["lang", "gram", "n"])

    counted = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string")) \
        .mapInArrow(tidied(run), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = SIZE) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams in order (ties: by hash)."""
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = gram_counts(docs).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["rank"])):  # size rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, learned: dict[str, list[int]], size: int = SIZE, *, text: str = "text",
            keep_text: bool = True) -> DataFrame:
    """Adds ``lang_pred string, score double, distance double`` to ``docs``
    (replacing columns of these names). ``distance`` is the out-of-place
    distance to the nearest profile as a share of the largest possible;
    ``score`` how much nearer that profile is than the next one (1: the next
    is infinitely further, 0: as near). Equal distances go to the first
    language by name. Null texts, texts without a letter, and any text when
    nothing was learned, are ``und`` with score 0 and distance 1.
    """
    names = sorted(learned)
    vocabulary = np.unique(np.array([g for p in learned.values() for g in p], np.uint64))
    # Rank of each known n-gram in each profile; the last column is "unknown".
    rank = np.full((len(names), len(vocabulary) + 1), -1, np.int64)
    for i, name in enumerate(names):
        rank[i, np.searchsorted(vocabulary, np.array(learned[name], np.uint64))] = np.arange(len(learned[name]))

    def distances(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        found, n_letters = [], np.zeros(n, np.int64)
        for cuts, part, of in _pieces(offsets, data):
            gram, piece, letters = _ngrams(cuts, part)
            np.add.at(n_letters, of, letters)
            found.append(_counts(of[piece], gram))
        doc, gram, count = _merge(found)
        cap = (1 << _COUNT_BITS) - 1
        x = (doc << (_COUNT_BITS + _PLACE_BITS)) | ((cap - np.minimum(count, cap)) << _PLACE_BITS) | np.arange(len(doc))
        order = np.sort(x) & ((1 << _PLACE_BITS) - 1)
        begin = np.searchsorted(doc, np.arange(n + 1))
        place = np.arange(len(doc)) - begin[doc]
        top = place < size
        gram, doc, place = gram[order][top], doc[top], place[top]
        at = np.searchsorted(vocabulary, gram)
        at[(at == len(vocabulary)) | (vocabulary[np.minimum(at, len(vocabulary) - 1)] != gram)] = len(vocabulary)
        out = np.ones((len(names), n))
        used = np.bincount(doc, minlength=n)
        for i in range(len(names)):
            r = rank[i][at]
            d = np.where(r < 0, size, np.minimum(np.abs(r - place), size))
            out[i] = np.bincount(doc, d, n) / np.maximum(used * size, 1)
        return out, n_letters

    def make(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        lang, ok = np.zeros(n, np.int64), np.zeros(n, bool)
        score, near = np.zeros(n), np.ones(n)
        if names:
            d, letters = distances(offsets, data)
            lang, near = d.argmin(0), d.min(0)
            nxt = np.partition(d, 1, axis=0)[1] if len(names) > 1 else np.ones(n)
            ok = letters > 0
            score = np.where(nxt > 0, 1 - near / np.where(nxt > 0, nxt, 1), 0.0)
        return [pa.array([names[i] if o else UNKNOWN for i, o in zip(lang.tolist(), ok.tolist(), strict=True)], pa.string()),
                pa.array(np.where(ok, np.clip(score, 0, 1), 0.0)), pa.array(np.where(ok, near, 1.0))]

    return with_text_columns(docs, text, "lang_pred string, score double, distance double", make, _slices, keep_text)


def held_out() -> Column:
    """Documents kept from learning: crc32 of the id's text leaves 1 modulo 3.
    A null id is not held out, and not learned from either."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op9_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and distance) of every document,
    learned from the documents that are not held out."""
    learned = profiles(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return predict(rows, learned, keep_text=False) \
        .select("doc_id", "held_out", "lang_pred", "score", "distance")
