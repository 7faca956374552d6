"""Operator 7: best-fit packing of documents into fixed-size sequences.

Hierarchical residual packing. The documents are tokenised where they lie and
those that are longer than a sequence are cut; only the pieces' sizes and places
travel from here. Each task deals its pieces of one length to the groups in
turn, so that every group has the same mix of sizes whatever order the table is
in, and each group best-fits its pieces (longest first) into bins of its own. Bins that are nearly full are done.
The others go up a tree as single items, ``FAN_IN`` groups to a node, where the
same best fit joins them; this repeats until one node is left.

Best fit leaves at most one bin of a group half full or less, and two bins can
only be joined if one of them is: a node can join at most as many pairs as it
has groups below it. A group therefore hands up ``carry`` of its bins, those
with the most room, which is far more than its node has use for, and closes the
rest as they are; no node grows with the corpus. Every round is written to the
shared folder, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope.session import shared_path

from .blobs import tidied
from .rolling import ranges
from .tokens import default_path, encoder

CAPACITY = 2048
FAN_IN = 16
#: A bin with no more than this much room is done.
TOLERANCE = 16
#: Bins that a group hands up at most.
CARRY = 4096
#: Pieces that a group of the first round packs (about).
GROUP_PIECES = 32_768

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, turn long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("number", pa.int64()), ("turn", pa.int64())])
_BIN = pa.schema([("sequence_id", pa.int64()), ("node", pa.int64()), ("used", pa.int64()),
                  ("done", pa.bool_()), ("members", pa.list_(_MEMBER))])
_BIN_SQL = ("sequence_id long, node long, used long, done boolean, members array<struct<doc_id: long, "
            "piece: int, start: long, length: long, ids_crc32: long, offset: long>>")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still takes it (equally
    full bins are alike). ``rooms`` has a bit for every room that some open bin has."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def _pack(members: pa.ListArray, sizes: np.ndarray, node: int, first_id: int, capacity: int,
          tolerance: int, carry: int, last: bool) -> pa.RecordBatch:
    """Best-fit items (each a list of pieces) into bins; mark which are done."""
    bins = best_fit(sizes.tolist(), capacity)
    item = np.fromiter((i for b in bins for i in b), np.int64, len(sizes))
    ends = np.cumsum([len(b) for b in bins])
    used = np.add.reduceat(sizes[item], np.append(0, ends[:-1])) if bins else np.zeros(0, np.int64)
    done = np.ones(len(bins), bool)
    if not last:
        more = np.flatnonzero(capacity - used > tolerance)
        done[more[np.argsort(used[more], kind="stable")[:carry]]] = False
    # The pieces bin by bin, each behind the one before it.
    starts, count = members.offsets.to_numpy()[:-1], np.diff(members.offsets.to_numpy())
    pieces = pa.table(members.values.flatten(), names=[f.name for f in members.type.value_type]).take(ranges(starts[item], count[item]))
    n = np.add.reduceat(count[item], np.append(0, ends[:-1])) if bins else np.zeros(0, np.int64)
    length = pieces.column("length").to_numpy()
    at = np.cumsum(length) - length
    bound = np.append(0, np.cumsum(n))
    at -= np.repeat(at[bound[:-1]], n) if len(at) else at
    names = [f.name for f in _MEMBER]
    held = pa.StructArray.from_arrays([pa.array(at) if f == "offset" else pieces.column(f).combine_chunks() for f in names], fields=list(_MEMBER))
    return pa.record_batch([
        pa.array(np.arange(first_id, first_id + len(bins), dtype=np.int64)), pa.array(np.full(len(bins), node, np.int64)),
        pa.array(used, pa.int64()), pa.array(done), pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), held, type=_BIN.field("members").type)],
        schema=_BIN)


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
                   fan_in: int = FAN_IN, tolerance: int = TOLERANCE, carry: int = CARRY,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most
    ``capacity`` ids: one row per piece, ``doc_id long, piece int, start long,
    length long, ids_crc32 long, sequence_id long, offset long``.

    A document is the ids of its whole text and ``end_id``; only longer ones
    are cut, into pieces of ``capacity`` ids, the last being shorter. A null
    text is empty and has the end id alone; a null doc_id stays null; rows that
    repeat a doc_id are packed each for itself. An empty table gives no row.
    Sequences are gapless from offset 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer or default_path()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, turns = task << 40, {}
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        step = capacity * enc.dtype.itemsize
        for batch in batches:
            for i in range(0, len(batch), 512):
                rows, pieces = batch.slice(i, 512), []
                for doc, ids in zip(rows.column("doc_id").to_pylist(), enc.encode(rows.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = np.frombuffer(ids[at:at + step], enc.dtype)
                        # Each task begins its turn for a length somewhere else.
                        turn = turns[len(part)] = turns.get(len(part), task * 7919 + len(part) * 104729) + 1
                        pieces.append((doc, k, k * capacity, len(part), zlib.crc32(part.astype("<u4").tobytes()), number, turn))
                        number += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    def first(key, table):
        node = key[0].as_py()
        table = table.sort_by([("length", "descending"), ("number", "ascending")]).drop_columns(["number", "turn", "node"]).combine_chunks()
        n = table.num_rows
        alone = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.StructArray.from_arrays(
            [table.column(f.name).chunk(0) for f in _MEMBER if f.name != "offset"], names=[f.name for f in _MEMBER if f.name != "offset"]))
        return pa.Table.from_batches([_pack(alone, table.column("length").to_numpy(), node, node << 32, capacity, tolerance, carry, nodes == 1)])

    def merge(level: int, last: bool):
        def join(key, table):
            node = key[0].as_py()
            table = table.sort_by([("used", "descending"), ("sequence_id", "ascending")]).combine_chunks()
            first = (level << 56) + (node << 32)
            return pa.Table.from_batches([_pack(table.column("members").chunk(0), table.column("used").to_numpy(),
                                                node, first, capacity, tolerance, carry, last)])
        return join

    path = shared_path(spark, "packing")
    src.mapInArrow(tidied(cut, encodes=True), _PIECE_SQL).write.parquet(f"{path}/pieces")
    pieces = spark.read.parquet(f"{path}/pieces")
    nodes = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("node", F.pmod("turn", F.lit(nodes).cast("long")))
    dealt.groupBy("node").applyInArrow(first, _BIN_SQL).write.parquet(f"{path}/0")
    level, packed = 0, [spark.read.parquet(f"{path}/0")]
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // fan_in)
        up = packed[-1].where("not done").withColumn("node", F.expr(f"node div {fan_in}"))
        up.groupBy("node").applyInArrow(merge(level, nodes == 1), _BIN_SQL).write.parquet(f"{path}/{level}")
        packed.append(spark.read.parquet(f"{path}/{level}"))
    # The bins of the last round are final; of the earlier ones, those done.
    whole = packed[-1]
    for p in packed[:-1]:
        whole = whole.unionByName(p.where("done"))
    return whole.select("sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def op7_best_fit_packing(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence of a packing: sequence_id, n_pieces, used."""
    return placed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("used"))


