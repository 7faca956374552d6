"""Operator 3: token ids as Arrow stream files of equal-length sequences.

Documents are dealt out by ranges of doc_id, so shard files in name order hold
the corpus in ascending doc_id order. Each shard holds the ids of its documents
one after the other, every document closed by an end id, cut into sequences of
``seq_len`` ids: a stream of record batches with two fixed-size-list columns,

    input_ids  fixed_size_list<uint16 or uint32>[seq_len]
    mask       fixed_size_list<bool>[seq_len]      (false: padding)

Every batch but the last holds ``rows`` sequences, lists carry no offsets and
nothing is null, so a memory-mapped file gives any sequence or mask as a slice
of the map, without a copy. ``<shard>.docs.arrow`` beside it lists doc_id,
start and n_tokens in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantscope.session import shared_path

from .blobs import filesystem, n_parts
from .tokens import default_path, encoder

SEQ_LEN = 1024
ROWS = 256
#: Bytes of text per shard file.
SHARD_BYTES = 16 << 20
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), seq_len)),
                      ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len))])


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences, a batch at a time."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int = SEQ_LEN, rows: int = ROWS):
        self.schema = sequence_schema(dtype, seq_len)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.dtype, self.seq_len, self.room = dtype, seq_len, seq_len * rows
        self.held: list[bytes] = []
        self.n_held = self.total = 0

    def write(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        if self.n_held >= self.room:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(flat) - len(flat) % self.room
            for i in range(0, whole, self.room):
                self._batch(flat[i:i + self.room])
            self.held, self.n_held = [flat[whole:].tobytes()], len(flat) - whole

    def _batch(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.seq_len) * self.seq_len
        mask = np.zeros(n, bool)
        mask[:len(ids)] = True
        padded = np.zeros(n, self.dtype)
        padded[:len(ids)] = ids
        self.total += len(ids)
        fields = [f.type for f in self.schema]
        self.out.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((padded, mask), fields, strict=True)],
            schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._batch(np.frombuffer(b"".join(self.held), self.dtype))
        self.out.close()


class SequenceFile:
    """Random access to one shard. A local file is memory-mapped: sequences and
    ids are views of the map."""

    def __init__(self, path: str):
        from pyarrow import fs
        store, name = filesystem(path)
        self._source = pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)
        reader = pa.ipc.open_stream(self._source)
        self.seq_len = reader.schema.field("input_ids").type.list_size
        self.batches = list(reader)
        self.rows = len(self.batches[0]) if self.batches else 0

    def __len__(self) -> int:
        return sum(map(len, self.batches[-1:])) + self.rows * (len(self.batches) - 1) if self.batches else 0

    def _flat(self, batch: int, column: str) -> pa.Array:
        return self.batches[batch].column(column).values

    def sequence(self, i: int) -> np.ndarray:
        b, k = divmod(i, self.rows)
        return self._flat(b, "input_ids").slice(k * self.seq_len, self.seq_len).to_numpy()

    def mask(self, i: int) -> np.ndarray:
        b, k = divmod(i, self.rows)
        return self._flat(b, "mask").slice(k * self.seq_len, self.seq_len).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids of the shard's stream from ``start``: a view where they lie
        in one batch."""
        out, per = [], self.rows * self.seq_len
        while n > 0:
            b, k = divmod(start, per)
            out.append(self._flat(b, "input_ids").slice(k, n).to_numpy()[:min(n, per - k)])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_sequences(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2,
                    seq_len: int = SEQ_LEN, rows: int = ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the corpus under ``path`` (a folder that all executors reach) and
    return its shards: ``shard long, path string, base long, n_tokens long``,
    ``base`` being the ids in all shards before it.

    Documents go in ascending doc_id order (null first); rows that share a
    doc_id go in the order of a hash of their text. Null texts are empty: their
    only id is the end id. An empty table gives no shard with documents. A
    retried task writes the same bytes to the same name, under a temporary name
    first. Other columns are ignored.
    """
    vocabulary = tokenizer or default_path()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("tie", F.xxhash64("text"))
    n = n_parts(src, "text", shard_bytes)
    dealt = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie") \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        store, root = filesystem(path)
        store.create_dir(root, recursive=True)
        name, attempt = f"{root}/shard-{shard:06d}", TaskContext.get().taskAttemptId()
        index: list[pa.RecordBatch] = []
        with store.open_output_stream(f"{name}.arrow.{attempt}") as sink:
            w, at = SequenceWriter(sink, enc.dtype, seq_len, rows), 0
            for batch in batches:
                sizes = []
                for i in range(0, len(batch), 512):
                    ids = enc.encode(batch.column("text").slice(i, 512).to_pylist())
                    for x in ids:
                        w.write(x + end)
                    sizes.extend(len(x) // enc.dtype.itemsize + 1 for x in ids)
                size = np.array(sizes, np.int64)
                start = at + np.cumsum(size) - size
                at += int(size.sum())
                index.append(pa.record_batch([batch.column("doc_id"), pa.array(start), pa.array(size)], schema=_INDEX))
            w.close()
        with store.open_output_stream(f"{name}.docs.arrow.{attempt}") as sink, pa.ipc.new_stream(sink, _INDEX) as out:
            for b in index:
                out.write_batch(b)
        for kind in ("docs.arrow", "arrow"):
            store.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([f"{path}/shard-{shard:06d}.arrow"]),
                               pa.array([at], pa.int64())], names=["shard", "path", "n_tokens"])

    spark = docs.sparkSession
    dealt.select("doc_id", "text").mapInArrow(write, "shard long, path string, n_tokens long") \
        .write.parquet(f"{path}/_shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/_shards").select(
        "shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_tokens")


def read_sequences(shards: DataFrame) -> DataFrame:
    """Read the files back: ``doc_id long, start long, n_tokens long, ids
    binary`` (little-endian unsigned 32-bit), one row per document; ``start``
    counts the ids of all documents before it."""
    return _read(shards, "doc_id long, start long, n_tokens long, ids binary",
                 lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def _read(shards: DataFrame, schema: str, value, kind: pa.DataType) -> DataFrame:
    names = [c.split()[0] for c in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = SequenceFile(row["path"])
                store, root = filesystem(row["path"].removesuffix(".arrow") + ".docs.arrow")
                with store.open_input_stream(root) as src:
                    for part in pa.ipc.open_stream(src):
                        for i in range(0, len(part), 1024):
                            p = part.slice(i, 1024)
                            start, size = (p.column(k).to_numpy() for k in (1, 2))
                            out = pa.array([value(f.ids(s, n)) for s, n in zip(start.tolist(), size.tolist(), strict=True)], kind)
                            yield pa.record_batch([p.column(0), pa.array(start + row["base"]), p.column(2), out], names=names)

    n = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    return shards.select("shard", "path", "base").repartition(n, "shard").mapInArrow(read, schema)


def op3_token_output(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as sequence files under the shared folder and return what
    the files hold: doc_id, start, n_tokens, ids_crc32."""
    shards = write_sequences(docs, shared_path(docs.sparkSession, "tokens"))
    return _read(shards, "doc_id long, start long, n_tokens long, ids_crc32 long",
                 lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())
