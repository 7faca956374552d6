"""Operator 11: the prefix trie of conversations, rolled up by centroids.

A node is a distinct sequence of first turns. Turns are numbered and hashed
along each conversation in a table sorted over all partitions (``scan``), so
neither a long conversation nor a first turn that a third of all conversations
share meets in one task. A node is known by its depth and 122 bits: the sum,
modulo 2**61 and twice, of a hash of each turn with its place, which rests on a
SHA-256 digest of role and text. Members are counted by one aggregate, and a
node's parent is the key of the place before.

Leaves and saved tokens of a subtree are totals over the forest of parent edges
(``centroid``). The hash of the ids that end in a node is read off a table
sorted by node and id: tasks join their stretches to pieces, and one task hashes
a node's pieces as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantscope.session import shared_path

from .centroid import LOCAL_NODES, subtree_totals
from .scan import MASK, running

WORD = r"[^\x20\x09-\x0D]+"
#: Characters of joined ids that make a piece.
PIECE = 1 << 20
_KEY = ["depth", "k1", "k2"]


def digests(role: Column, text: Column) -> tuple[Column, Column]:
    """120 bits that stand for a turn, as two longs."""
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("long")
    return part(1), part(16)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, d1, d2, words, place``: the turns of each conversation,
    numbered from 1 in the order of ``turn`` (null first; ties by a digest of
    role and text). Null role or text is empty; rows without a conv_id belong to
    no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    d1, d2 = digests(role, text)
    src = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), d1.alias("d1"), d2.alias("d2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return running(src, "conv_id", ["turn", "d1", "d2"])


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of ``ends`` (depth, k1, k2, conv_id)."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*_KEY, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.record_batch([*[[k] for k in key], [first], [",".join(held)]], names=[*by, "ids"])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1) if len(b) else np.zeros((0, 3), np.int64)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))[:len(keys)])
            ids = b.column(3).to_pylist()
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=False):
                now = tuple(keys[lo].tolist())
                if held and (now != key or size >= PIECE):
                    yield piece()
                    held, size = [], 0
                if not held:
                    key, first = now, ids[lo]
                held.extend(map(str, ids[lo:hi]))
                size += 8 * (hi - lo)
        if held:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for b in batches:
            for *now, ids in zip(*(b.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if now == key:
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=[*_KEY, "ends_sha256"])
                out = []
        if key:
            yield pa.record_batch([[k] for k in (*key, sha.hexdigest())], names=[*_KEY, "ends_sha256"])

    dealt = ends.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by)
    joined = dealt.mapInArrow(pieces, "depth long, k1 long, k2 long, conv_id long, ids string")
    return joined.repartition(n, *_KEY).sortWithinPartitions(*by).mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, *, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """One row per node: ``conv_id long`` (smallest member), ``depth long,
    parent_conv_id long`` (null for the root), ``n_convs, n_children, n_leaves,
    saved_tokens long, ends_sha256 string``.

    ``turns``: ``conv_id, place`` (1 to the conversation's length, without
    gaps), ``d1, d2`` (``digests``) and ``words``; ``conversations``: every
    ``conv_id`` once, those without a turn too. ``n_leaves`` counts the childless nodes of the
    subtree, ``saved_tokens`` sums its (n_convs - 1) * words, ``ends_sha256`` is
    the SHA-256 of the ids that end in the node, ascending and comma-joined.
    A node's last turn is turn ``depth`` of conversation ``conv_id``. No
    conversation gives no row, not even a root.
    """
    spark = turns.sparkSession
    path = shared_path(spark, "trie")
    e = [F.xxhash64(*([F.lit(i)] * i), "place", "d1", "d2").bitwiseAND(F.lit(MASK)).alias(f"e{i + 1}") for i in range(2)]
    src = turns.select("conv_id", F.col("place").alias("depth"), "words", *e)
    src = src.select("*", F.col("e1").alias("k1"), F.col("e2").alias("k2"))
    p = running(src, "conv_id", ["depth"], ["k1", "k2"], "_n").drop("_n")
    # The root is the place 0 of every conversation.
    zero = F.lit(0).cast("long")
    inner = p.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
                                 F.max("e1").alias("e1"), F.max("e2").alias("e2"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0") \
        .select(*[zero.alias(c) for c in _KEY], "conv_id", "n_convs", zero.alias("words"), zero.alias("e1"), zero.alias("e2"))
    inner.unionByName(root).withColumn("node", F.monotonically_increasing_id()).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    before = lambda k, e: F.when(F.col("depth") > 1, (F.col(k) - F.col(e)).bitwiseAND(F.lit(MASK))).otherwise(F.lit(0)).alias(k)
    child = nodes.where("depth > 0").select("node", (F.col("depth") - 1).alias("depth"), before("k1", "e1"), before("k2", "e2"))
    of = child.join(nodes.select(*_KEY, F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), _KEY) \
        .select("node", "parent", "parent_conv_id")
    children = of.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    forest = nodes.join(of, "node", "left").join(children, "node", "left").select(
        "node", "parent", *_KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    forest.write.parquet(f"{path}/forest")
    forest = spark.read.parquet(f"{path}/forest")
    totals = subtree_totals(forest, ["n_leaves", "saved_tokens"], local_nodes=local_nodes)
    last = p.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "depth").alias("k"))
    ends = conversations.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"k.{c}", zero).alias(c) for c in _KEY])
    return forest.drop("n_leaves", "saved_tokens").join(totals, "node").join(_ends_sha256(ends), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **options) -> DataFrame:
    """``prefix_trie`` of conversations as they stand (conv_id, turn, role,
    text), with the role and text of each node's last turn (null for the root)."""
    turns = turns_of(conversations)
    nodes = prefix_trie(turns, turns.select("conv_id").distinct(), **options)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                text.alias("text"), *[d.alias(f"d{i + 1}") for i, d in enumerate(digests(role, text))])
    at = nodes.join(turns.select("conv_id", F.col("place").alias("depth"), "turn", "d1", "d2"), ["conv_id", "depth"], "left")
    # Repeated rows say the same: any of them has the text.
    key = [at["conv_id"] == said["conv_id"], at["turn"].eqNullSafe(said["turn"]), at["d1"] == said["d1"], at["d2"] == said["d2"]]
    return at.join(said.dropDuplicates(["conv_id", "turn", "d1", "d2"]), key, "left") \
        .select(*[at[c] for c in nodes.columns], said["role"], said["text"])


def rebuilt(turns: DataFrame, heads: int = 4, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations with a shared beginning: conversation ``c`` has
    the first ``h`` turns of ``c - c % group`` (all if fewer, none if absent) and
    then its own after the first ``h``, with ``h = crc32(c) % heads``."""
    size = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    path = shared_path(turns.sparkSession, "rebuilt")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = size.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    size.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(base, "base", "left") \
        .withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0)))).write.parquet(path)
    convs = turns.sparkSession.read.parquet(path)
    what = ["d1", "d2", "words"]
    lead = turns.where(F.col("place") < heads).where(F.col("conv_id") % group == 0).withColumnRenamed("conv_id", "base")
    lead = convs.where("lead > 0").select("conv_id", "base", "h").join(lead, "base").where("place <= h").select("conv_id", "place", *what)
    own = turns.join(convs.where("n > h").select("conv_id", "h", "lead"), "conv_id").where("place > h") \
        .select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), *what)
    return lead.unionByName(own), convs.select("conv_id")


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return prefix_trie(*rebuilt(turns_of(conversations)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id AS c, CAST(conv_id AS VARCHAR) AS s, list({'r': role, 't': text} ORDER BY i) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT c, turns, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * len(s))), lambda a, k:
           xor(xor(a, CASE WHEN k % 8 = 0 THEN ascii(s[k // 8 + 1]) ELSE 0 END) >> 1,
               (xor(a, CASE WHEN k % 8 = 0 THEN ascii(s[k // 8 + 1]) ELSE 0 END) & 1) * 3988292384)), 4294967295) % 4 AS h
  FROM own),
r AS MATERIALIZED (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], a.turns[1:0]), a.turns[a.h + 1:]) AS p FROM h a LEFT JOIN own b ON b.c = a.base),
m AS MATERIALIZED (SELECT c, d, len(p) = d AS ends, p[1:d] AS k FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM r)),
n AS MATERIALIZED (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends
  FROM m GROUP BY k, d),
children AS MATERIALIZED (SELECT k[1:d - 1] AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
own_total AS (
  SELECT n.k, n.d, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.k[n.d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM n LEFT JOIN children c ON c.k = n.k),
total AS (
  SELECT k[1:a] AS k, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own_total) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens,
  n.ends AS ends_sha256
FROM n LEFT JOIN n p ON n.d > 0 AND p.k = n.k[1:n.d - 1] LEFT JOIN children c ON c.k = n.k JOIN total t ON t.k = n.k"""
