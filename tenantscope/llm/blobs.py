"""Packed exchanges: many small fixed-width records travel as one binary row.

A task sorts its records by bucket and emits one row per bucket that it has
records for: ``(bucket, part, body)``, where ``body`` holds the columns one
after the other. This spares the row overhead of a shuffle of 8-byte hashes.
Rows of a bucket meet in one group; the number of buckets follows the data.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import forget

PACKED = "bucket long, part long, body binary"
#: Bytes of text that one part of a partitioned corpus holds on average.
PART_BYTES = 4 << 20


def binary_array(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def pack(bucket: np.ndarray, part: int, columns: Sequence[np.ndarray]) -> pa.Table:
    """Rows of PACKED; records keep their order within a bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(b))
    cols = [c[order] for c in columns]
    bodies = [b"".join(c[i:j].tobytes() for c in cols) for i, j in zip(cuts, ends[:len(cuts)], strict=True)]
    return pa.table({"bucket": pa.array(b[cuts].astype(np.int64)),
                     "part": pa.array(np.full(len(cuts), part, np.int64)),
                     "body": binary_array(bodies)})


def unpack(table: pa.Table, dtypes: Sequence[np.dtype | str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The records of all rows: the index of each record's row, its columns."""
    width = sum(np.dtype(d).itemsize for d in dtypes)
    sizes, cols = [], [[] for _ in dtypes]
    for body in table.column("body").to_pylist():
        n, at = len(body) // width, 0
        sizes.append(n)
        for k, d in enumerate(dtypes):
            cols[k].append(np.frombuffer(body, d, n, at))
            at += n * np.dtype(d).itemsize
    return (np.repeat(np.arange(len(sizes)), sizes),
            [np.concatenate(c) if c else np.zeros(0, d) for c, d in zip(cols, dtypes, strict=True)])


def split_by_bucket(bucket: np.ndarray) -> dict[int, np.ndarray]:
    """The records of each bucket in the order ``pack`` gives them."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    return dict(zip(b[cuts].tolist(), np.split(order, cuts[1:]), strict=True))


#: What goes back to a part about its records: record number, answer.
REPLY = ("<u4", "<u4")


def statuses(replies: pa.Table | None, bucket: np.ndarray, n: int) -> np.ndarray:
    """The answer to each of a part's ``n`` records (0: none came), given the
    bucket that each was sent to."""
    out = np.zeros(n, np.uint32)
    if replies is None or not replies.num_rows:
        return out
    at = split_by_bucket(bucket)
    row, (number, answer) = unpack(replies, REPLY)
    cuts = np.searchsorted(row, np.arange(replies.num_rows + 1))
    for k, b in enumerate(replies.column("bucket").to_pylist()):
        out[at[b][number[cuts[k]:cuts[k + 1]]]] = answer[cuts[k]:cuts[k + 1]]
    return out


def replies_to(table: pa.Table, row: np.ndarray, answer: np.ndarray) -> pa.Table:
    """Send each record with an answer back to the part it came from. ``row``:
    the row of ``table`` that each record came in, ascending."""
    number = np.arange(len(row)) - np.searchsorted(row, row)
    hit = np.flatnonzero(answer)
    out = pack(row[hit], 0, (number[hit].astype("<u4"), answer[hit].astype("<u4")))
    rows = out.column("bucket").to_numpy()
    return pa.table({"bucket": pa.array(table.column("bucket").to_numpy()[rows]),
                     "part": pa.array(table.column("part").to_numpy()[rows]), "body": out.column("body")})


def n_parts(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> int:
    """How many parts of about ``part_bytes`` the texts fill (one aggregate row)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-int(total) // part_bytes))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts).cast("long"))


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and UTF-8 bytes of a text column (null: empty)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    a = a.cast(pa.large_string()) if pa.types.is_string(a.type) else a
    if a.null_count:
        a = a.fill_null("")
    a = a.cast(pa.large_binary())
    n = len(a)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(a.buffers()[1], np.int64, n + 1, a.offset * 8)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def give_back(encodes: bool = False) -> None:
    """Return freed memory to the system, and the encoders' caches unless the
    task ``encodes``. Workers outlive their tasks, and what one stage leaves would
    stand beside the next one's arrays."""
    if not encodes:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False):
    """``run`` for ``mapInArrow``, giving memory back when a task begins and ends."""
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(encodes)
        try:
            yield from run(batches)
        finally:
            give_back(encodes)
    return inner


def filesystem(path: str):
    """The store of a path or URI, as executors open it, and the name in it."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def with_text_columns(docs: DataFrame, text: str, schema: str, make: Callable[[np.ndarray, np.ndarray], list[pa.Array]],
                      slices: Callable[[np.ndarray], Iterable[tuple[int, int]]], keep_text: bool = True) -> DataFrame:
    """``docs`` and the columns of ``schema``, which replace columns of their
    names. ``make`` gets the byte offsets and UTF-8 bytes of a slice of rows
    (null: empty) and returns the new columns; ``slices`` cuts a batch."""
    new = T.StructType.fromDDL(schema).fields
    src = docs.drop(*(f.name for f in new if f.name != text))
    kept = [f for f in src.schema if keep_text or f.name != text]
    names = [f.name for f in kept + new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(b.schema.get_field_index(text)))
            rest = b.select([f.name for f in kept])
            for lo, hi in slices(offsets):
                made = make(offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]])
                yield pa.RecordBatch.from_arrays([*rest.slice(lo, hi - lo).columns, *made], names=names)

    return src.mapInArrow(tidied(run), T.StructType(kept + new))
