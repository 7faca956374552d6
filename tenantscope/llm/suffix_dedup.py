"""Operator 1: suffix-order dedup of repeated byte strings by prefix-free parsing.

Every document (UTF-8 bytes) is parsed into phrases at rolling-hash triggers:
a string of ``length`` bytes belongs to the gram in it with the smallest hash,
and a phrase covers the run of starts that share a trigger. Equal strings
hold equal triggers at equal places, so the corpus reduces to a *parse* (the
phrase occurrences of each document) over a *dictionary* (the distinct
phrases), each much smaller than the text where the text repeats.

The order of the parse settles whole phrases: of equal phrases under one
trigger, all but the first in corpus order repeat in every string. Only the
triggers that head several different phrases need the dictionary's suffixes:
their strings are ordered by (suffix prefix, corpus position), and all but the
first of each class repeat. Suffixes are put in the order of a 96-bit
fingerprint of their first ``length`` bytes, not alphabetically: the classes
of equal prefixes, all that the result needs, are the same, and no hot
trigger's suffixes have to meet in one task.

Text is shuffled once (the exchange is reused) and read three times. Parts,
buckets and groups grow in number with the data, not in size. What a frequent
string sends is one record per part, because each part settles its own
repeats first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import PACKED, n_parts, pack, part_of, replies_to, statuses, text_buffer, unpack
from .rolling import ranges
from .suffix_core import phrases, string_hashes

#: Length of the trigger gram. Longer grams head fewer different phrases but
#: give shorter phrases; 50 sent the least in total on the test corpora.
GRAM = 50
_PHRASE = ("<u8", "<u8", "<i8")  # trigger, mark (0: several in this part), doc
_STRING = ("<u8", "<u4", "<i8")  # string, trigger (low half), doc
REPEAT, COMPARE = 1, 2


def _order(table: pa.Table) -> pa.Table:
    """Documents of a part in corpus order: by id, then by text."""
    keys = [("__doc", "ascending"), ("__text", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))


class _Part:
    """The phrases of one part, and what of them is still open."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.offsets, self.data = text_buffer(table.column("__text"))
        self.docs = table.column("__doc").combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
        self.length = length
        self.p = p = phrases(self.data, self.offsets, length, gram)
        self.repeat = np.zeros(len(p.first), bool)
        order = np.lexsort((p.first, p.mark, p.trigger))
        trig, mark = p.trigger[order], p.mark[order]
        new_trig = np.append(True, trig[1:] != trig[:-1])[:len(trig)]
        new_mark = new_trig | np.append(True, mark[1:] != mark[:-1])[:len(trig)]
        self.repeat[order[~new_mark]] = True  # a later copy of a phrase of this part
        at = np.flatnonzero(new_trig)
        self.trigger_of = np.empty(len(order), np.int64)
        self.trigger_of[order] = np.cumsum(new_trig) - 1
        self.triggers = trig[at]
        kinds = np.add.reduceat(new_mark.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        self.several = kinds > 1
        self.marks = np.where(self.several, np.uint64(0), mark[at] | np.uint64(1))
        first = np.minimum.reduceat(p.first[order], at) if len(at) else np.zeros(0, np.int64)
        self.trigger_doc = self.doc_at(first)

    def doc_at(self, place: np.ndarray) -> np.ndarray:
        return self.docs[np.searchsorted(self.offsets, place, "right") - 1] if len(place) else np.zeros(0, np.int64)

    def settle(self, replies: pa.Table | None, buckets: int) -> None:
        """Apply the replies about this part's triggers."""
        status = statuses(replies, self.triggers % np.uint64(buckets), len(self.triggers))
        self.sent = status == COMPARE
        self.repeat |= status[self.trigger_of] == REPEAT
        self.open = np.flatnonzero((self.several | self.sent)[self.trigger_of] & ~self.repeat)
        self.open = self.open[np.argsort(self.p.first[self.open])]
        first, count = self.p.first[self.open], self.p.count[self.open]
        self.string = string_hashes(self.data, first, count, self.length)
        self.string_at = ranges(first, count)
        owner = np.repeat(self.trigger_of[self.open], count)
        self.string_trigger = (self.triggers[owner] >> np.uint64(16)).astype(np.uint32)
        order = np.lexsort((self.string_at, self.string_trigger, self.string))
        s, t = self.string[order], self.string_trigger[order]
        new = np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))[:len(s)]
        self.string_repeat = np.zeros(len(order), bool)
        self.string_repeat[order[~new]] = True
        self.ask = np.flatnonzero(self.sent[owner] & ~self.string_repeat)

    def spans(self, replies: pa.Table | None, buckets: int) -> np.ndarray:
        """Which bytes of the part are covered by a repeated string."""
        status = statuses(replies, self.string[self.ask] % np.uint64(buckets), len(self.ask))
        self.string_repeat[self.ask[status == REPEAT]] = True
        rep = np.flatnonzero(self.repeat)
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, self.p.first[rep], 1)
        np.add.at(step, self.p.first[rep] + self.p.count[rep] + self.length - 1, -1)
        s = self.string_at[self.string_repeat]
        np.add.at(step, s, 1)
        np.add.at(step, s + self.length, -1)
        return np.cumsum(step[:-1]) > 0


def _resolve_phrases(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    row, (trig, mark, doc) = unpack(table, _PHRASE)
    part = table.column("part").to_numpy()[row]
    order = np.lexsort((part, doc, trig))
    t = trig[order]
    new = np.append(True, t[1:] != t[:-1])[:len(t)]
    at = np.flatnonzero(new)
    m = mark[order]
    size = np.diff(np.append(at, len(t)))
    one = np.minimum.reduceat(m, at) == np.maximum.reduceat(m, at) if len(at) else np.zeros(0, bool)
    one &= m[at] != 0
    status = np.zeros(len(t), np.uint8)
    status[order] = np.where(np.repeat(size == 1, size), 0,
                             np.where(np.repeat(one, size), np.where(new, 0, REPEAT), COMPARE))
    return replies_to(table, row, status)


def _resolve_strings(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    row, (string, trig, doc) = unpack(table, _STRING)
    part = table.column("part").to_numpy()[row]
    order = np.lexsort((part, doc, trig, string))
    s, t = string[order], trig[order]
    new = np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))[:len(s)]
    status = np.zeros(len(s), np.uint8)
    status[order[~new]] = REPEAT
    return replies_to(table, row, status)


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = GRAM, *,
                   doc_id: str = "doc_id", text: str = "text", part_bytes: int | None = None) -> DataFrame:
    """Byte spans of each document that are covered by a string of ``length``
    bytes which also starts earlier in the corpus, and the bytes that remain.

    Returns ``doc_id long, n_bytes long, spans array<struct<start: long, end:
    long>>, kept binary``, one row per input row. Strings never cross
    documents and are judged on the input. Null or empty texts, and texts
    shorter than ``length``, have no span. The corpus order is (doc_id,
    start); a null doc_id comes first; rows that share a doc_id come in the
    order of their texts, so of equal rows one stays whole. An empty table
    gives an empty result. Other columns are ignored.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be in 1..length")
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__doc"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    parts = n_parts(src, "__text", *([part_bytes] if part_bytes else []))
    src = src.withColumn("__part", part_of(F.col("__doc"), parts))

    def phrase_records(key, table):
        s = _Part(_order(table), length, gram)
        return pack((s.triggers % np.uint64(parts)).astype(np.int64), key[0].as_py(),
                    (s.triggers.astype("<u8"), s.marks.astype("<u8"), s.trigger_doc.astype("<i8")))

    def string_records(key, table, replies):
        if not table.num_rows:
            return pack(np.zeros(0, np.int64), 0, ())
        s = _Part(_order(table), length, gram)
        s.settle(replies, parts)
        string = s.string[s.ask]
        return pack((string % np.uint64(parts)).astype(np.int64), key[0].as_py(),
                    (string.astype("<u8"), s.string_trigger[s.ask].astype("<u4"),
                     s.doc_at(s.string_at[s.ask]).astype("<i8")))

    def finish(key, table, replies):
        table = _order(table)
        if not table.num_rows:
            return _SPANS.empty_table()
        kinds = replies.column("kind").to_numpy()
        s = _Part(table, length, gram)
        s.settle(replies.filter(pa.array(kinds == 0)), parts)
        gone = s.spans(replies.filter(pa.array(kinds == 1)), parts)
        return _kept(table, s, gone)

    by_part = src.groupBy("__part")
    first = (by_part.applyInArrow(phrase_records, PACKED)
             .groupBy("bucket").applyInArrow(_resolve_phrases, PACKED))
    second = (by_part.cogroup(first.groupBy("part")).applyInArrow(string_records, PACKED)
              .groupBy("bucket").applyInArrow(_resolve_strings, PACKED))
    replies = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)))
    return by_part.cogroup(replies.groupBy("part")).applyInArrow(
        finish, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


_SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ("kept", pa.binary())])


def _kept(table: pa.Table, s: _Part, gone: np.ndarray) -> pa.Table:
    off = s.offsets
    n = len(off) - 1
    size = np.diff(off)
    # Rises and falls of ``gone``, cut at the documents' bounds.
    edge = np.zeros(len(gone) + 1, bool)
    edge[off] = True
    inner = np.zeros(len(gone), bool)
    inner[1:] = ~edge[1:-1] & gone[:-1]
    start = np.flatnonzero(gone & ~inner)
    last = np.zeros(len(gone), bool)
    last[:-1] = gone[1:] & ~edge[1:-1]
    end = np.flatnonzero(gone & ~last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    base = off[doc]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"]))
    keep = ~gone
    kept_off = np.append(0, np.cumsum(keep))[off].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept_off.tobytes()),
                                                  pa.py_buffer(s.data[keep].tobytes())])
    return pa.table([table.column("__doc"), pa.array(size), spans, kept], schema=_SPANS)


def op1_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    """Digest of :func:`repeated_spans` at 100 bytes, one row per document."""
    s = repeated_spans(docs)
    return s.select("doc_id", "n_bytes",
                    F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
                    F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS MATERIALIZED (SELECT doc_id, b, substring(h, 2 * b + 1, 2 * (256 + 99)) AS h
      FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 256)) AS b FROM d)),
w AS (SELECT doc_id, b + k AS s, md5(substring(h, 2 * k + 1, 200)) AS g
      FROM (SELECT doc_id, b, h, unnest(range(0, length(h) // 2 - 99)) AS k FROM block)),
rep AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
cut AS (SELECT *, s > lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS new FROM rep),
run AS (SELECT doc_id, s, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM cut),
span AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM run GROUP BY doc_id, k),
part AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
gone AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
                string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
         FROM part p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""
