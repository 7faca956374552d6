"""Operator 10: benchmark decontamination over a positional inverted index.

The index is split by document, as search engines split theirs: every task
stores, for the documents it reads, the postings (places) of each term that
the benchmark uses. A query phrase is answered from its rarest terms: the
rarest term's places, moved back by its offset in the phrase, are the first
candidates, and the list of the next rarer term, moved likewise, cuts them
down, until every term of the phrase has agreed or no candidate is left. Most
phrases end at the second list. No text is shuffled: one row per document
leaves the task.

Proximity matches rank a phrase's terms by their number in the whole corpus,
which a pass over the texts counts before (one row per benchmark term), so that
a document's matches do not depend on the documents that share its task.

The benchmark, the stated query set, travels with the job up to
``MAX_BENCHMARK_BYTES`` of text. A larger one is written to the shared folder
in blocks of that size, and every index is asked one block after the other.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope.session import shared_path

from .blobs import filesystem, text_buffer, tidied, with_text_columns
from .words import ALNUM, doc_slices, word_table

WINDOW = 10
#: Words that a term may be off its place in a proximity match.
SLOP = 2
#: Terms of a phrase that a proximity match asks for, out of its rarest ones,
#: which are one more.
NEAR_TERMS = 4
#: Benchmark text that one pass over the corpus takes along.
MAX_BENCHMARK_BYTES = 8 << 20
#: Document text that one index covers.
INDEX_BYTES = 8 << 20
_OUT = "n_words long, hits array<struct<start: long, end: long>>, items array<string>, near_items array<string>"


class Phrases(NamedTuple):
    """Distinct query phrases over a sorted vocabulary of word hashes."""
    vocabulary: np.ndarray
    terms: list[np.ndarray]       # term numbers of each phrase
    items: list[list[str]]        # ids of the items that hold it
    #: The first ``near_terms + 1`` offsets of each phrase by how rare the term
    #: is in the corpus (ties: by place), -1 beyond its end; null: not counted.
    rarest: np.ndarray | None = None


def phrases(items: list[tuple[str, str | None]], window: int) -> Phrases:
    """All windows of ``window`` words of each item; an item with fewer words,
    but not none, is one window."""
    offsets, data = text_buffer(pa.array([t for _, t in items], pa.large_string()))
    word, doc, _ = word_table(data, offsets, ALNUM)
    vocabulary, term = np.unique(word, return_inverse=True)
    found: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    cuts = np.searchsorted(doc, np.arange(len(items) + 1))
    for k, (item, _) in enumerate(items):
        t = term[cuts[k]:cuts[k + 1]].astype(np.int64)
        for i in range(max(len(t) - window, 0) + 1 if len(t) else 0):
            w = t[i:i + window]
            found.setdefault(w.tobytes(), (w, set()))[1].add(item)
    return Phrases(vocabulary, [w for w, _ in found.values()], [sorted(s) for _, s in found.values()])


class PositionalIndex:
    """Postings of the query vocabulary in one batch of documents. Documents
    are set ``gap`` places apart, so no phrase runs over a bound."""

    def __init__(self, word: np.ndarray, doc: np.ndarray, n_docs: int, vocabulary: np.ndarray, gap: int):
        self.place_of_word = np.arange(len(word)) + (doc + 1) * gap
        self.n_places = len(word) + (n_docs + 2) * gap
        at = np.searchsorted(vocabulary, word)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == word[known]
        term = np.where(known, at, -1)
        #: The term at each place (-1: none of the vocabulary): the lists of all
        #: terms laid over one another, so that asking whether a list holds a
        #: place is one look-up.
        self.at = np.full(self.n_places, -1, np.int64)
        self.at[self.place_of_word] = term
        order = np.flatnonzero(known)
        order = order[np.argsort(term[order], kind="stable")]
        self.postings = self.place_of_word[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.length = np.diff(self.bounds)

    def list(self, term: int) -> np.ndarray:
        return self.postings[self.bounds[term]:self.bounds[term + 1]]

    def exact(self, terms: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Places where the phrase starts (``start``: candidates to choose from)."""
        order = np.argsort(self.length[terms], kind="stable")
        if start is None:
            start = self.list(terms[order[0]]) - order[0]
        for k in order:
            if not len(start):
                break
            start = start[self.at[start + k] == terms[k]]
        return start

    def near(self, terms: np.ndarray, slop: int, rarest: np.ndarray, need: int) -> np.ndarray:
        """Places where the phrase would start if ``need`` of its terms at the
        offsets ``rarest`` lie within ``slop`` words of their place in it; the
        first of them that is there sets the place."""
        found = []
        for first in range(len(rarest) - need + 1):
            k = rarest[first]
            start = self.list(terms[k]) - k
            have, left = np.ones(len(start), np.int64), len(rarest) - first - 1
            for k in rarest[first + 1:]:
                if not len(start):
                    break
                ok = np.zeros(len(start), bool)
                for d in range(-slop, slop + 1):
                    ok |= self.at[start + (k + d)] == terms[k]
                have, left = have + ok, left - 1
                stay = have + left >= need
                start, have = start[stay], have[stay]
            found.append(start)
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _rarest(q: Phrases, number: np.ndarray, near_terms: int) -> np.ndarray:
    out = np.full((len(q.terms), near_terms + 1), -1, np.int64)
    for row, terms in zip(out, q.terms, strict=True):
        order = np.argsort(number[terms], kind="stable")[:near_terms + 1]
        row[:len(order)] = order
    return out


def _counted(docs: DataFrame, text: str, blocks: list, near_terms: int) -> list:
    """The blocks with the rarest terms of each phrase, by the number of each
    term in all of ``docs`` (one aggregate, a row per benchmark term)."""
    def count(batches):
        held: dict[int, int] = {}
        vocabularies = [q.vocabulary for q in blocks if isinstance(q, Phrases)]
        for batch in batches:
            offsets, data = text_buffer(batch.column(0))
            for lo, hi in doc_slices(offsets):
                off = offsets[lo:hi + 1] - offsets[lo]
                word, n = np.unique(word_table(data[offsets[lo]:offsets[hi]], off, ALNUM)[0], return_counts=True)
                known = np.zeros(len(word), bool)
                for v in vocabularies or (_load(b).vocabulary for b in blocks):
                    known |= np.isin(word, v)
                for w, c in zip(word[known].view(np.int64).tolist(), n[known].tolist(), strict=True):
                    held[w] = held.get(w, 0) + c
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text).mapInArrow(tidied(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word = rows.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    word, n = np.append(word[order], np.uint64(0)), np.append(rows.column("n").to_numpy()[order], 0)

    def ranked(q: Phrases) -> Phrases:
        at = np.searchsorted(word[:-1], q.vocabulary)
        return q._replace(rarest=_rarest(q, np.where(word[at] == q.vocabulary, n[at], 0), near_terms))

    out = []
    for b in blocks:
        if isinstance(b, Phrases):
            out.append(ranked(b))
        else:
            out.append(f"{b}-ranked")
            _store(out[-1], ranked(_load(b)))
    return out


def _search(blocks: list, slop: int, near_terms: int):
    """A function from a batch of documents to its rows. ``blocks``: Phrases, or
    the paths of files that hold them, read one at a time."""

    def hits(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        parts = [word_table(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], ALNUM)
                 for a, b in doc_slices(offsets)]
        n = len(offsets) - 1
        n_words = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        word = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(n), n_words)
        hit = np.zeros(len(word), bool)
        items: list[set[str]] = [set() for _ in range(n)]
        near_items: list[set[str]] = [set() for _ in range(n)]
        for block in blocks:
            q = block if isinstance(block, Phrases) else _load(block)
            if not q.terms:
                continue
            ix = PositionalIndex(word, doc, n, q.vocabulary, 2 * (max(map(len, q.terms)) + slop))
            doc_at = np.full(ix.n_places, -1, np.int64)
            doc_at[ix.place_of_word] = doc
            cover = np.zeros(ix.n_places + 1, np.int32)
            bounds = np.cumsum([0, *map(len, q.terms[:-1])])
            there = ix.length[np.concatenate(q.terms)] > 0
            ask = np.logical_and.reduceat(there, bounds)
            if near_terms:  # as many of the chosen terms as a match needs
                size = (q.rarest >= 0).sum(1)
                need = np.minimum(size, near_terms)
                ask = (there[bounds[:, None] + np.maximum(q.rarest, 0)] & (q.rarest >= 0)).sum(1) >= need
            for k in np.flatnonzero(ask).tolist():
                terms, start = q.terms[k], None
                if near_terms:
                    start = ix.near(terms, slop, q.rarest[k, :size[k]], int(need[k]))
                    for p in start.tolist():
                        d = doc_at[p:p + len(terms)].max(initial=-1)
                        if d >= 0:
                            near_items[d].update(q.items[k])
                start = ix.exact(terms, start)
                if len(start):
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + len(terms), -1)
                    for d in np.unique(doc_at[start]).tolist():
                        items[d].update(q.items[k])
            hit |= (np.cumsum(cover[:-1]) > 0)[ix.place_of_word]
        return _columns(n_words, doc, hit, items, near_items)

    return hits


def _store(path: str, q: Phrases) -> None:
    store, name = filesystem(path)
    with store.open_output_stream(name) as f:
        f.write(pickle.dumps(q))


def _load(path: str) -> Phrases:
    store, name = filesystem(path)
    with store.open_input_stream(name) as f:
        return pickle.loads(f.read())


def _blocks(benchmark: DataFrame, window: int, max_bytes: int) -> list:
    """The benchmark's phrases; beyond ``max_bytes`` of text, in files of that
    much each under the shared folder, so that no task holds more at a time."""
    made, held, size, root = [], [], 0, None

    def close(inline: bool) -> None:
        nonlocal root
        q = phrases(held, window)
        if not inline:
            root = root or shared_path(benchmark.sparkSession, "benchmark")
            store, name = filesystem(root)
            store.create_dir(name, recursive=True)
            _store(f"{root}/{len(made):06d}", q)
            q = f"{root}/{len(made):06d}"
        made.append(q)

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").distinct()
    for r in rows.toLocalIterator():
        held.append((r["i"], r["text"]))
        size += len((r["text"] or "").encode())
        if size >= max_bytes:
            close(False)
            held, size = [], 0
    if held:
        close(not made)
    return made


def _columns(n_words, doc, hit, items, near_items) -> list[pa.Array]:
    n = len(n_words)
    base = np.cumsum(n_words) - n_words
    first = np.zeros(len(hit), bool)
    first[base[n_words > 0]] = True
    before = np.append(False, hit[:-1])[:len(hit)]
    start = np.flatnonzero(hit & (~before | first))
    follows = np.append(hit[1:] & ~first[1:], False)[:len(hit)]
    end = np.flatnonzero(hit & ~follows) + 1
    d = doc[start]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(start - base[d]), pa.array(end - base[d])], ["start", "end"]))
    text = pa.list_(pa.string())
    return [pa.array(n_words.astype(np.int64)), spans,
            pa.array([sorted(x) for x in items], text), pa.array([sorted(x) for x in near_items], text)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, *, slop: int = SLOP, text: str = "text",
                   keep_text: bool = True, near_terms: int = NEAR_TERMS, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """Find every window of the benchmark's items in the documents.

    Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
    non-ASCII characters. Adds ``n_words, hits
    array<struct<start, end>>`` (maximal runs of words inside an occurrence of a
    window), ``items array<string>`` (items with occurring windows, sorted) and
    ``near_items`` (items with a proximity match: ``near_terms`` of the
    ``near_terms + 1`` terms of a window that are rarest in ``docs``, or all of
    a shorter one, each within ``slop`` words of its place; ``near_terms=0``
    leaves it empty), which replace columns of these names. One row per input
    row. Null and empty texts have no words
    and no hits; a null item_id is the item ``null``; repeated items are
    searched once; an empty benchmark hits nothing.
    """
    blocks = _blocks(benchmark, window, max_bytes)
    if near_terms and blocks:
        blocks = _counted(docs, text, blocks, near_terms)
    search = _search(blocks, slop, near_terms)
    return with_text_columns(docs, text, _OUT, search, lambda offsets: doc_slices(offsets, INDEX_BYTES), keep_text)


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and n_near_items, the items with a proximity match."""
    h = benchmark_hits(docs.select("doc_id", "text"), benchmark, keep_text=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return h.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.size("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS MATERIALIZED (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM words),
item AS MATERIALIZED (
  SELECT DISTINCT id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM w WHERE kind = 1 AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item),
hit AS MATERIALIZED (
  SELECT DISTINCT p.doc_id, i, item.n, item.id AS item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT d.id AS doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w d, sizes WHERE kind = 0)) p
  JOIN item ON item.n = p.n AND item.g = p.g),
place AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(i, i + n)) t(p)),
n_hit AS (SELECT doc_id, count(*) AS n FROM place GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
-- Proximity: of the five terms of a window that are rarest in the documents (ties: the first), four (all of fewer)
-- within two words of their places; the rarest one that is there sets the place.
piece AS MATERIALIZED (
  SELECT DISTINCT id, w[i:i + 9] AS l FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM w WHERE kind = 1 AND len(w) > 0)),
phrase AS MATERIALIZED (SELECT l, row_number() OVER () AS pid FROM (SELECT DISTINCT l FROM piece)),
held AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM w WHERE kind = 0) GROUP BY x),
chosen AS MATERIALIZED (
  SELECT pid, k, x, r, least(least(m, 5), 4) AS need, least(m, 5) AS size
  FROM (SELECT pid, k, x, m, row_number() OVER (PARTITION BY pid ORDER BY coalesce(n, 0), k) - 1 AS r
        FROM (SELECT pid, len(l) AS m, k, l[k] AS x FROM (SELECT pid, l, unnest(range(1, len(l) + 1)) AS k FROM phrase)) LEFT JOIN held USING (x))
  WHERE r < 5),
posting AS MATERIALIZED (
  SELECT doc_id, p, x FROM (SELECT doc_id, p, w[p] AS x FROM (SELECT id AS doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w WHERE kind = 0))
  WHERE x IN (SELECT x FROM chosen)),
anchor AS MATERIALIZED (SELECT pid, doc_id, p - k AS st, r, need FROM chosen JOIN posting USING (x) WHERE r <= size - need),
other AS (
  SELECT DISTINCT a.pid, a.doc_id, a.st, a.r, c.r AS s FROM anchor a JOIN chosen c ON c.pid = a.pid AND c.r > a.r
  JOIN posting q ON q.doc_id = a.doc_id AND q.x = c.x AND q.p BETWEEN a.st + c.k - 2 AND a.st + c.k + 2),
near AS (
  SELECT DISTINCT a.pid, a.doc_id FROM anchor a LEFT JOIN (SELECT pid, doc_id, st, r, count(*) AS n FROM other GROUP BY ALL) o
    ON o.pid = a.pid AND o.doc_id = a.doc_id AND o.st = a.st AND o.r = a.r WHERE coalesce(o.n, 0) + 1 >= a.need),
near_items AS (SELECT doc_id, count(DISTINCT v.id) AS n FROM near JOIN phrase USING (pid) JOIN piece v USING (l) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated,
  CAST(coalesce(e.n, 0) AS BIGINT) AS n_near_items
FROM w LEFT JOIN n_hit h ON h.doc_id = w.id LEFT JOIN items t ON t.doc_id = w.id LEFT JOIN near_items e ON e.doc_id = w.id WHERE w.kind = 0"""
