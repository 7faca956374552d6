"""Operator 12: web archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records
of about ``frame_bytes`` (a longer record has a frame of its own). Behind them
stand two skippable frames, which plain decoders pass over:

    record map   record id -> frame number, offset and length inside the
                 frame's content, as a compressed Arrow stream
    seek table   compressed and plain size and checksum of every frame, in the
                 layout of the seekable format, ending in its footer

So a reader finds the table at the end of the file, and a record costs one seek
and one frame. A decoder that knows none of this reads the bundle as one
``.warc.zst``.

Payloads that are equal are stored once: of those with at least ``min_revisit``
bytes the one with the smallest page id is a response, the others are revisits
that name it. Which digests repeat is one aggregate; a page learns of it by a
join on its digest, whose large side Spark can split where one digest is hot.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope.session import shared_path

from .blobs import filesystem

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: The pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the Zstandard and seekable formats and of WARC 1.1.
MAP_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MAP = pa.schema([("record_id", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_BUNDLES = "path string, frames long, records long, bytes long"
_RECORDS = ("record_id string, page_id long, record_type string, target_uri string, refers_to_id string, refers_to long, "
            "payload_bytes long, payload_digest string, payload binary")


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}:{digest}"


def _page_of(rid: str) -> int | None:
    page = rid.split(":")[2]
    return None if page == "null" else int(page)


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>",
             *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def page_record(page_id: int | None, url: str | None, html: bytes, n_bytes: int, digest: str, refers_to: int | None,
                date: str = DATE) -> tuple[str, bytes]:
    """The id and bytes of a page's record: a response with its payload, or a
    revisit of the equal payload of ``refers_to``. Characters that cannot stand
    in a header are percent-encoded in the url; a null url has no header."""
    rid = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    headers = [("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")))
    if refers_to is None:
        return rid, _record("response", rid, headers, http + html)
    headers += [("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"), ("WARC-Profile", PROFILE)]
    return rid, _record("revisit", rid, headers, http)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class BundleWriter:
    """Writes records to one bundle."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.n_held = self.written = self.records = 0
        self.entries: list[tuple[int, int, int]] = []
        self.where: list[tuple[str, int, int, int]] = []

    def write(self, rid: str, record: bytes) -> None:
        if self.held and self.n_held + len(record) > self.frame_bytes:
            self._frame()
        self.where.append((rid, len(self.entries), self.n_held, len(record)))
        self.held.append(record)
        self.n_held += len(record)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.written += len(data)

    def _frame(self) -> None:
        plain = b"".join(self.held)
        packed = self.zstd.compress(plain)
        self._put(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> int:
        """Write what is left, the record map and the seek table; the number of
        frames with records."""
        if self.held:
            self._frame()
        frames = len(self.entries)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _MAP, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            columns = list(zip(*self.where, strict=True)) or [(), (), (), ()]
            out.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(columns, _MAP.types, strict=True)], schema=_MAP))
        record_map = _skippable(MAP_MAGIC, sink.getvalue().to_pybytes())
        self._put(record_map)
        entries = np.array([*self.entries, (len(record_map), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], ENTRY)
        self._put(_skippable(TABLE_MAGIC, entries.tobytes() + FOOTER.pack(len(entries), CHECKSUMS, FOOTER_MAGIC)))
        return frames


class Record(NamedTuple):
    record_id: str
    headers: dict[str, str]
    block: bytes


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first.encode() != VERSION:
        raise ValueError(f"no WARC record: {first!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    return Record(headers["WARC-Record-ID"][1:-1], headers, rest[:int(headers["Content-Length"])])


class Bundle:
    """Random access to a bundle's frames and records."""

    def __init__(self, path: str):
        store, name = filesystem(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        body = n * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(size - FOOTER.size - body, body), ENTRY)
        self.starts = np.cumsum(self.entries["packed"], dtype=np.int64) - self.entries["packed"]
        self.zstd = zstandard.ZstdDecompressor()
        self._map: pa.Table | None = None

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(int(start))
        return self.file.read(int(n))

    def frame(self, i: int) -> bytes:
        e = self.entries[i]
        plain = self.zstd.decompress(self._at(self.starts[i], e["packed"]), max_output_size=int(e["plain"]))
        if len(plain) != e["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != e["check"]:
            raise ValueError(f"frame {i} does not match the seek table")
        return plain

    @property
    def record_map(self) -> pa.Table:
        """record_id, frame, offset, length of every record, in file order."""
        if self._map is None:
            last = len(self.entries) - 1
            body = self._at(self.starts[last] + 8, int(self.entries[last]["packed"]) - 8)
            self._map = pa.ipc.open_stream(body).read_all()
        return self._map

    def record(self, rid: str) -> Record:
        """The (first) record of this id: one frame is read."""
        at = pa.compute.index(self.record_map.column("record_id"), rid).as_py()
        if at < 0:
            raise KeyError(rid)
        _, frame, offset, length = self.record_map.slice(at, 1).to_pylist()[0].values()
        return parse_record(self.frame(frame)[offset:offset + length])

    def records(self) -> Iterator[Record]:
        """All records in file order, a frame in memory at a time."""
        frame, data = -1, b""
        for batch in self.record_map.to_batches(max_chunksize=4096):
            for at, offset, length in zip(*(batch.column(c).to_pylist() for c in ("frame", "offset", "length")), strict=True):
                if at != frame:
                    frame, data = at, self.frame(at)
                yield parse_record(data[offset:offset + length])

    def close(self) -> None:
        self.file.close()


def write_bundles(pages: DataFrame, path: str, *, min_revisit: int = MIN_REVISIT, date: str = DATE, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write a WARC record for each row of ``pages`` (page_id, url, html) under
    ``path``, a folder that all executors reach, and return the bundles: ``path
    string, frames long, records long, bytes long``.

    The payload is the html in UTF-8 (null: empty). Rows with one payload of at
    least ``min_revisit`` bytes revisit the one with the smallest page_id; rows
    that share that page_id too are all responses, as they are the same record.
    Rows without a page_id revisit one that has it; where none has, all are
    responses. Every bundle begins with a warcinfo record, which is not counted.
    An empty table writes no bundle. A retried task writes under a temporary
    name first. Other columns are ignored.
    """
    spark = pages.sparkSession
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    src = src.withColumn("digest", F.sha2("html", 256)).withColumn("n_bytes", F.length("html").cast("long"))
    src.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")) \
        .where("n > 1 and least is not null").select("digest", "least").write.parquet(f"{path}/_repeats")
    repeats = spark.read.parquet(f"{path}/_repeats")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    judged = src.join(repeats, "digest", "left").select("page_id", "url", "n_bytes", "digest", refers.alias("refers_to"),
                                                        F.when(refers.isNull(), F.col("html")).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt, made = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
        sink = out = None

        def close() -> pa.RecordBatch:
            nonlocal sink, out, made
            frames, name = out.close(), f"pages-{task:06d}-{made:04d}.warc.zst"
            sink.close()
            store.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            row = pa.record_batch([[f"{path}/{name}"], [frames], [out.records - 1], [out.written]], names=["path", "frames", "records", "bytes"])
            sink = out = None
            made += 1
            return row

        for batch in batches:
            for i in range(0, len(batch), 256):
                for r in batch.slice(i, 256).to_pylist():
                    if out is None:
                        name = f"pages-{task:06d}-{made:04d}.warc.zst"
                        sink = store.open_output_stream(f"{root}/{name}.{attempt}")
                        out = BundleWriter(sink, frame_bytes, level)
                        info = f"urn:x-bundle:{task}:{made}"
                        out.write(info, _record("warcinfo", info, [("WARC-Date", date), ("WARC-Filename", name),
                                                                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(*page_record(r["page_id"], r["url"], r["html"] or b"", r["n_bytes"], r["digest"], r["refers_to"], date))
                    if out.written >= bundle_bytes:
                        yield close()
        if out is not None:
            yield close()

    judged.mapInArrow(write, _BUNDLES).write.parquet(f"{path}/_bundles")
    return spark.read.parquet(f"{path}/_bundles")


def _dealt(bundles: DataFrame) -> DataFrame:
    return bundles.select("path").repartition(max(1, bundles.count()))


def read_records(bundles: DataFrame, payload: bool = True) -> DataFrame:
    """The page records of ``bundles``: ``record_id string, page_id long,
    record_type string, target_uri string, refers_to_id string, refers_to long,
    payload_bytes long, payload_digest string, payload binary``.

    Size and digest are those of the full payload: a response's from the bytes
    read, a revisit's from its headers. The payload of a revisit is null, that
    of a response too unless ``payload``.
    """
    import hashlib
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]])
                        for f in _RECORDS.split(", ")])

    def row(r: Record) -> tuple:
        h, kind = r.headers, r.headers["WARC-Type"]
        http, _, body = r.block.partition(b"\r\n\r\n")
        said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        digest, size, refers = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(said["Content-Length"]), h.get("WARC-Refers-To")
        if kind == "response":
            size, found = len(body), hashlib.sha256(body).hexdigest()
            if found != digest:
                raise ValueError(f"{r.record_id}: the payload does not match its digest")
        refers = refers and refers[1:-1]
        return (r.record_id, _page_of(r.record_id), kind, h.get("WARC-Target-URI"), refers, _page_of(refers) if refers else None,
                size, digest, body if payload and kind == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            bundle, held, size = Bundle(path), [], 0
            for r in bundle.records():
                if r.headers["WARC-Type"] == "warcinfo":
                    continue
                held.append(row(r))
                size += len(r.block) if payload else 0
                if len(held) >= 4096 or size >= 4 * FRAME_BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held, size = [], 0
            bundle.close()
            if held:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return _dealt(bundles).mapInArrow(read, _RECORDS)


def record_index(bundles: DataFrame) -> DataFrame:
    """The record maps of all bundles: ``record_id string, frame long, offset
    long, length long, path string``. Joined with wanted ids it tells which
    frames to read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            bundle = Bundle(path)
            for b in bundle.record_map.to_batches(max_chunksize=65536):
                yield b.append_column("path", pa.array([path] * len(b)))
            bundle.close()

    return _dealt(bundles).mapInArrow(read, "record_id string, frame long, offset long, length long, path string") \
        .where(F.col("record_id").startswith("urn:x-page:"))


def op12_warc(pages: DataFrame) -> DataFrame:
    """Write the pages as bundles under the shared folder and return what the
    files hold: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    bundles = write_bundles(pages, shared_path(pages.sparkSession, "warc"))
    return read_records(bundles, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least <> page_id OR page_id IS NULL THEN least END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= 100"""
