"""Text, vector, key-value and path jobs (the control plane's declared
extensions, R69-R78), as Spark joins and aggregates over Column expressions.
Only the trigram join and the LSH lookup multiply matrices in their tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tenantscope.functions import scalars as S
from tenantscope.session import shared_path

# Word separators for trigram and word jobs (anything that is
# not a letter or digit), trigram padding (two spaces before, one after).
WORD_SPLIT = r"[^\p{L}\p{N}]+"
TRGM_PAD_BEFORE, TRGM_PAD_AFTER = "  ", " "
DEFAULT_TRGM_THRESHOLD = 0.3


# ---------------------------------------------------------------------------
# Vectors (R69, R70)
# ---------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, summed in DOUBLE in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def centroids(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per key: one row per (key, position) aggregated, then the
    positions gathered back in order (bounded by the dimension)."""
    e = vectors.select(key, F.posexplode(vec).alias("pos", "x"))
    per = e.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (per.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_s"))
            .select(key, F.transform("_s", lambda s: s["m"]).alias(vec)))


def vector_topk(q: DataFrame, v: DataFrame, k: int = 3, metric: str = "cosine",
                q_id: str = "qid", v_id: str = "vec_id", vec: str = "embedding",
                blocks: int | None = None) -> DataFrame:
    """Exact top-k nearest vectors for every query vector.

    Every (query, vector) score is computed, as exact search requires, but
    through an equi-join: the corpus is split into ``blocks`` by hash and
    each query is copied once per block. Spark broadcasts the copied query
    side only when its measured size is under the broadcast threshold;
    otherwise it is a shuffled join. ``row_number() <= k`` is planned with
    a partial group limit, so each map task ships at most ``k`` rows per
    query before the final ranking. Ties go to the smaller id. ``blocks``
    defaults to the session's default parallelism, so a shuffled plan
    spreads the scoring over the whole cluster.
    """
    blocks = blocks or max(1, q.sparkSession.sparkContext.defaultParallelism)
    qq = (q.select(F.col(q_id).alias("_qid"), F.col(vec).alias("_qv"))
          .withColumn("_qn", norm(F.col("_qv")))
          .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    vv = (v.select(F.col(v_id).alias("_vid"), F.col(vec).alias("_vv"))
          .withColumn("_vn", norm(F.col("_vv")))
          .withColumn("_b", F.pmod(F.xxhash64("_vid"), F.lit(blocks)).cast("int")))
    j = qq.join(vv, "_b")
    d = dot(F.col("_qv"), F.col("_vv"))
    if metric == "cosine":
        score = F.try_divide(d, F.col("_qn") * F.col("_vn"))
    elif metric == "dot":
        score = d
    elif metric == "l2":
        score = -F.sqrt(F.aggregate(F.zip_with("_qv", "_vv", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                                    F.lit(0.0).cast("double"), lambda acc, x: acc + x))
    else:
        raise ValueError(metric)
    # A missing or zero vector has no direction and so no score.
    scored = j.select("_qid", "_vid", score.alias("score")).filter(F.col("score").isNotNull())
    w = Window.partitionBy("_qid").orderBy(F.col("score").desc(), F.col("_vid"))
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("_qid").alias(q_id), "rank", F.col("_vid").alias(v_id), "score"))


def semantic_lookup(q: DataFrame, cache: DataFrame, threshold: float,
                    ttl_seconds: int | None = None, q_ts: str | None = None,
                    c_ts: str | None = None, **kw) -> DataFrame:
    """The nearest cached entry (cosine) if it is at least
    ``threshold`` similar and, when timestamps are given, was cached no more
    than ``ttl_seconds`` before the query; else a miss (NULL id).

    With timestamps, expired entries are removed before ranking, so a stale
    nearer entry never hides a fresh one."""
    q_id, v_id, vec = kw.get("q_id", "qid"), kw.get("v_id", "vec_id"), kw.get("vec", "embedding")
    if ttl_seconds is not None and q_ts and c_ts:
        # Time-bounded: pair queries and entries on the TTL band first.
        qq = q.select(F.col(q_id).alias("_qid"), F.col(vec).alias("_qv"), F.col(q_ts).alias("_qts")) \
            .withColumn("_qn", norm(F.col("_qv")))
        cc = cache.select(F.col(v_id).alias("_vid"), F.col(vec).alias("_vv"), F.col(c_ts).alias("_cts")) \
                  .withColumn("_vn", norm(F.col("_vv")))
        # Equi-key on (TTL bucket, corpus block): queries are copied to
        # their bucket and the one before, and to every block, so a busy
        # bucket is split over ``blocks`` tasks; then the exact band.
        blocks = kw.get("blocks") or max(1, q.sparkSession.sparkContext.defaultParallelism)
        qb = F.floor(F.unix_timestamp(F.col("_qts").cast("timestamp")) / F.lit(ttl_seconds))
        qq = (qq.withColumn("_bk", F.explode(F.array(qb, qb - 1)))
              .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
        cc = (cc.withColumn("_bk", F.floor(F.unix_timestamp(F.col("_cts").cast("timestamp"))
                                           / F.lit(ttl_seconds)))
              .withColumn("_blk", F.pmod(F.xxhash64("_vid"), F.lit(blocks)).cast("int")))
        j = qq.join(cc, ["_bk", "_blk"]).filter(
            (F.col("_cts") <= F.col("_qts"))
            & (F.col("_cts") >= F.col("_qts") - F.make_interval(secs=F.lit(ttl_seconds))))
        s = j.select("_qid", "_vid", F.try_divide(dot(F.col("_qv"), F.col("_vv")), F.col("_qn") * F.col("_vn"))
                     .alias("score")).filter(F.col("score").isNotNull())
        w = Window.partitionBy("_qid").orderBy(F.col("score").desc(), F.col("_vid"))
        best = (s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == 1)
                .select(F.col("_qid").alias(q_id), F.col("_vid").alias(v_id), "score"))
    else:
        best = vector_topk(q, cache, 1, "cosine", q_id, v_id, vec).drop("rank")
    hit = F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False))
    allq = q.select(q_id)
    return (allq.join(best, q_id, "left")
            .select(q_id, F.when(hit, F.col(v_id)).alias(v_id), "score", hit.alias("hit")))


def semantic_lookup_lsh(q: DataFrame, cache: DataFrame, threshold: float, *, recall: float = 0.95, bits: int | None = None,
                        tables: int | None = None, q_id: str = "qid", v_id: str = "vec_id", vec: str = "embedding",
                        seed: int = 7) -> DataFrame:
    """R70 for large sides: as ``semantic_lookup`` without times, but only pairs
    that share one of ``tables`` buckets are scored, so an entry near the
    threshold can be missed. A bucket is the signs of ``bits`` random
    projections. Scores are exact (cosine in DOUBLE). By default the bits grow
    with the logarithm of the distinct entries, so that a bucket stays small,
    and there are as many tables as find an entry at the threshold with
    probability ``recall`` (``lsh_shape``), nearer ones more often. Equal
    vectors are hashed and scored once. Missing and zero vectors are misses and
    never found."""
    pairs = lsh_pairs(q, cache, threshold, recall=recall, bits=bits, tables=tables, q_id=q_id, v_id=v_id, vec=vec, seed=seed)
    near = pairs.filter(F.col("score") >= threshold).groupBy("_x") \
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_vid").alias("id"))).alias("b"))
    best = q.select(F.col(q_id).alias("_qid"), F.col(vec).alias("_x")).join(near, "_x").groupBy("_qid").agg(F.min("b").alias("b"))
    return (q.select(q_id).join(best, q[q_id] == best["_qid"], "left")
            .select(q_id, F.col("b.id").alias(v_id), (-F.col("b.s")).alias("score"), F.col("b").isNotNull().alias("hit")))


#: Entries that share a bucket by chance, about, and tables at most.
LSH_BUCKET, LSH_TABLES = 16, 64
#: Rows of a matrix of vectors that a task hashes at a time.
LSH_ROWS = 4096


def lsh_shape(entries: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits and tables: two vectors at the cosine ``threshold`` have a sign in
    common with probability ``1 - angle / pi``. Fewer bits where a low
    threshold would take more than ``LSH_TABLES``."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = min(48, max(1, round(math.log2(max(entries, 2) / LSH_BUCKET))))
    need = lambda k: 1 if same ** k >= recall else math.ceil(math.log(1 - recall) / math.log1p(-max(same ** k, 1e-9)))
    while bits > 1 and need(bits) > LSH_TABLES:
        bits -= 1
    return bits, min(need(bits), LSH_TABLES)


def lsh_pairs(q: DataFrame, cache: DataFrame, threshold: float, *, recall: float = 0.95, bits: int | None = None,
              tables: int | None = None, q_id: str = "qid", v_id: str = "vec_id", vec: str = "embedding",
              seed: int = 7) -> DataFrame:
    """``_x, _vid, score`` of the pairs that share a bucket, once for each
    bucket they share: a distinct query vector and a distinct entry, with the
    smallest id of those that hold it (null first)."""
    def directed(df: DataFrame, name: str) -> DataFrame:
        n = norm(F.col(name))
        return df.withColumn(f"{name}n", n).filter((n > 0) & (n < float("inf")))

    a = directed(q.select(F.col(vec).alias("_x")).distinct(), "_x")
    b = directed(cache.groupBy(F.col(vec).alias("_y")).agg(F.min(F.struct(F.col(v_id).alias("i"))).alias("_i")), "_y")
    shape = b.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_y")).alias("d")).first()
    k, t = lsh_shape(shape["n"], threshold, recall)
    k, t, dim = bits or k, tables or t, shape["d"] or 1
    planes = np.random.default_rng(seed).standard_normal((dim, t * k))

    def buckets(df: DataFrame, name: str, *keep: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), LSH_ROWS):
                    part = batch.slice(lo, LSH_ROWS)
                    x = part.column(0)
                    size = x.value_lengths().to_numpy()
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    m, here = np.zeros((len(part), dim)), at < dim
                    m[np.repeat(np.arange(len(part)), size)[here], at[here]] = x.flatten().to_numpy()[here]
                    sign = ((m @ planes) > 0).reshape(len(part), t, k) @ (1 << np.arange(k, dtype=np.int64))
                    yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(
                        pa.array(np.arange(len(part) + 1, dtype=np.int32) * t), pa.array(sign.ravel()))], names=[*part.schema.names, "_h"])
        t_in = df.select(name, *keep)
        kind = StructType([*t_in.schema.fields, StructField("_h", ArrayType(LongType()))])
        return t_in.mapInArrow(run, kind).select(name, *keep, F.posexplode("_h").alias("_t", "_s"))

    j = buckets(a, "_x", "_xn").join(buckets(b, "_y", "_yn", "_i"), ["_t", "_s"])
    return j.select("_x", F.col("_i.i").alias("_vid"), (dot(F.col("_x"), F.col("_y")) / (F.col("_xn") * F.col("_yn"))).alias("score"))


# ---------------------------------------------------------------------------
# Text (R71-R75)
# ---------------------------------------------------------------------------
def ilike_search(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Case-insensitive LIKE over whole texts."""
    return df.filter(F.col(col).ilike(pattern))


def words(c) -> Column:
    """Lower-cased words (runs of letters/digits) of a text, in order."""
    return F.filter(F.split(F.lower(S._c(c)), WORD_SPLIT), lambda w: F.length(w) > 0)


def _word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of each word, one after the other, and how many each has: a
    word is padded with two spaces before and one after, then cut into every
    3-character window. A trigram is its three code points in one integer."""
    text = "".join(f"{TRGM_PAD_BEFORE}{w}{TRGM_PAD_AFTER}" for w in words.to_pylist())
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = pc.utf8_length(words).to_numpy().astype(np.int64) + len(TRGM_PAD_BEFORE + TRGM_PAD_AFTER) - 2
    at = np.arange(n.sum()) + np.repeat(2 * np.arange(len(n)), n)
    return c[at] << 42 | c[at + 1] << 21 | c[at + 2], n


# Records whose words are cut at a time, and the cells of a table of them by gram.
GRAM_ROWS, GRAM_CELLS = 1024, 1 << 26


def _gram_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per record: id, gram count and the distinct trigrams of its
    words. A word is cut once for all the records of a batch that have it."""
    t = df.select(F.col(id_col).alias("_id"), F.array_distinct(words(text_col)).alias("_w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), GRAM_ROWS):
                part = batch.slice(lo, GRAM_ROWS)
                word = part.column(1).flatten().dictionary_encode()
                code, n = _word_grams(word.dictionary)
                codes, gram = np.unique(code, return_inverse=True)
                k = word.indices.to_numpy()
                size = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy()
                row, start = np.repeat(np.arange(len(part)), size), np.cumsum(n) - n
                many = n[k]
                at = np.arange(many.sum()) + np.repeat(start[k] - (np.cumsum(many) - many), many)
                cell = np.repeat(row, many) * len(codes) + gram[at]
                if len(part) * len(codes) <= GRAM_CELLS:
                    seen = np.zeros(len(part) * len(codes), bool)
                    seen[cell] = True
                    cell = np.flatnonzero(seen)
                else:
                    cell = np.unique(cell)
                row, gram = np.divmod(cell, max(1, len(codes)))
                own = np.bincount(row, minlength=len(part))
                ends = np.append(0, np.cumsum(own)).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.array(own.astype(np.int32)),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[gram]))], names=["_id", "_n", "_g"])

    return t.mapInArrow(cut, StructType([t.schema["_id"], StructField("_n", IntegerType()), StructField("_g", ArrayType(LongType()))]))


def _ratio(threshold: float) -> tuple[int, int]:
    """The threshold as written, as a ratio of integers: 0.8 is 4/5, not the
    nearest double, so a pair that reaches it exactly is kept."""
    f = Fraction(str(threshold))
    return f.numerator, f.denominator


def _result(pairs: DataFrame, a_id: str, b_id: str, num: int, den: int) -> DataFrame:
    union = F.col("_an") + F.col("_bn") - F.col("shared")
    # Rounded half up in integers, which is what round() does with the ratio, only faster.
    sim = F.expr("(2000000 * shared + (_an + _bn - shared)) DIV (2 * (_an + _bn - shared)) / 1000000D")
    same = a_id == b_id
    return (pairs.filter((union > 0) & (F.col("shared") * F.lit(den) >= union * F.lit(num)))
            .select(F.col("_a").alias(f"a_{a_id}" if same else a_id),
                    F.col("_b").alias(f"b_{b_id}" if same else b_id),
                    F.col("shared").cast("bigint").alias("shared"),
                    F.col("_an").cast("bigint").alias("a_grams"),
                    F.col("_bn").cast("bigint").alias("b_grams"),
                    sim.alias("similarity")))


# Records and grams in a block, at most (expected: records are dealt by hash), blocks
# of a table of fewer records, and records of the smallest of those.
BLOCK_RECORDS, BLOCK_GRAMS, BLOCKS, BLOCK_LEAST = 4096, 1 << 21, 128, 512
# Blocks of a group that stay and that come to them, rows of a tile of these and those,
# and columns of grams that are multiplied at a time.
STAY, COME, TILE, BLOCK_COLUMNS = 2, 8, (1024, 512), 8192
# A column that more than one in so many records have is kept as bits, and leaders of a group.
BITS, LEADERS = 16, 8
# Listing a pair of records that share a gram costs as much as so many cells of a product of
# matrices; pairs that are listed at a time.
LIST, LISTED = 350, 1 << 22
# Pairs found in a batch of rows.
FOUND = 1 << 16


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


class _Blocks(NamedTuple):
    packed: DataFrame
    sizes: list[tuple[int, int]]  # the smallest and largest gram count of each block
    grams: int


def _blocks(sets: DataFrame, merge: bool) -> _Blocks:
    """The records in blocks of like size, one row a block. A size of more
    records than a block holds is dealt by a hash of the id. With ``merge``, rows
    of one id and size are a record and their grams count as often as they come.

    A block is packed by gram, the most frequent first: bits of the records that
    have it, or their places if they are few."""
    found = sets.groupBy("_n").agg(F.count(F.lit(1)).alias("r")).orderBy("_n").collect()
    most = min(BLOCK_RECORDS, max(BLOCK_LEAST, -(-sum(r for _, r in found) // BLOCKS)))
    dealt: list[tuple[int, int, int]] = []
    sizes: list[tuple[int, int]] = []
    first = parts = records = grams = 0
    for n, r in found:
        if not sizes or records + r > most or grams + n * r > BLOCK_GRAMS:
            first, parts, records, grams = len(sizes), max(-(-r // most), -(-n * r // BLOCK_GRAMS)), 0, 0
            sizes += [(n, n)] * parts
        dealt.append((n, first, parts))
        sizes[first:] = [(low, n) for low, _ in sizes[first:]]
        records, grams = records + r, grams + n * r
    to = F.broadcast(sets.sparkSession.createDataFrame(dealt, "_n int, _first int, _parts int"))
    t = sets.join(to, "_n").select("_id", "_n", "_g", (F.col("_first") + F.pmod(F.xxhash64("_id"), F.col("_parts"))).cast("int").alias("_block"))
    key = sets.schema["_id"].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        # By id: a block is packed more than once, from rows that come in any order,
        # and its pairs with itself go by the places of its records.
        t = t.sort_by("_id").combine_chunks()
        ids, size = t["_id"].combine_chunks(), t["_n"].to_numpy().astype(np.int64)
        grams = t["_g"].combine_chunks().flatten().dictionary_encode()
        row = np.repeat(np.arange(len(size)), size)
        if merge:
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            _, one, of = np.unique(code * (int(size.max()) + 1) + size, return_index=True, return_inverse=True)
            ids, size, row = ids.take(pa.array(one)), size[one], of[row]
        gram, n = grams.indices.to_numpy(), len(size)
        many = np.bincount(gram, minlength=len(grams.dictionary))
        rank = np.argsort(-many, kind="stable")
        column = np.empty(len(rank), np.int64)
        column[rank] = np.arange(len(rank))
        cell = np.sort(column[gram] * n + row)
        wide = int((many * BITS > n).sum())
        in_bits = (cell < wide * n) & np.append(True, cell[1:] != cell[:-1])
        m = np.zeros((wide, n), bool)
        m.ravel()[cell[in_bits]] = True
        at, row = np.divmod(cell[~in_bits], n)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table([t["_block"].slice(0, 1), one(ids), one(pa.array(size.astype(np.int32))), one(grams.dictionary.take(pa.array(rank))),
                         pa.array([np.packbits(m, axis=1).tobytes()], pa.binary()),
                         one(pa.array(np.bincount(at, minlength=len(rank)).astype(np.int32))),
                         pa.array([row.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes()], pa.binary())],
                        names=["_block", "ids", "sizes", "vocabulary", "bits", "counts", "rows"])

    return _Blocks(t.groupBy("_block").applyInArrow(
        pack, f"_block int, ids array<{key}>, sizes array<int>, vocabulary array<long>, bits binary, counts array<int>, rows binary"),
        sizes, sum(n * r for n, r in found))


class _Block(NamedTuple):
    number: int
    ids: pa.Array
    size: np.ndarray
    vocabulary: pa.Array
    start: np.ndarray             # of the rows of each gram, and the end of the last
    row: np.ndarray


def _unpack(t: pa.Table) -> Iterator[_Block]:
    for k in range(len(t)):
        ids, size, vocabulary, counts = (t[c][k].values for c in ("ids", "sizes", "vocabulary", "counts"))
        size, counts, n = size.to_numpy().astype(np.int64), counts.to_numpy(), len(ids)
        bits, rows = (t[c][k].as_buffer() for c in ("bits", "rows"))
        m = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n)
        column, row = np.divmod(np.flatnonzero(m), n)
        column = np.append(column, np.repeat(np.arange(len(counts)), counts))
        row = np.append(row, np.frombuffer(rows, np.uint16 if n <= 1 << 16 else np.uint32))
        if counts[:len(m)].any():
            order = np.argsort(column, kind="stable")
            column, row = column[order], row[order]
        start = np.append(0, np.cumsum(np.bincount(column, minlength=len(counts))))
        yield _Block(t["_block"][k].as_py(), ids, size, vocabulary, start, row)


class _Leaders(NamedTuple):
    vocabulary: pa.Array
    has: np.ndarray               # by gram and leader
    size: np.ndarray


def _leaders(b: _Block, threshold: float) -> _Leaders:
    """Records of the block that between them are near most of it."""
    n = len(b.size)
    at = np.unique(np.linspace(0, n - 1, min(n, 8 * LEADERS)).astype(np.int64))
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    to = place[b.row]
    m = np.zeros((len(b.vocabulary), len(at)), np.float32)
    m[np.repeat(np.arange(len(b.vocabulary)), np.diff(b.start))[to >= 0], to[to >= 0]] = 1
    shared = m.T @ m
    near = shared / (b.size[at][:, None] + b.size[at][None, :] - shared) >= threshold / 2
    chosen, left = [], np.ones(len(at), bool)
    while left.any() and len(chosen) < LEADERS:
        chosen.append(int((near & left).sum(1).argmax()))
        left &= ~near[chosen[-1]]
    return _Leaders(b.vocabulary, m[:, chosen] > 0, b.size[at[chosen]])


class _Part(NamedTuple):
    at: np.ndarray                # the places in the block of its records
    size: np.ndarray
    far: np.ndarray               # Jaccard distance of each to each leader
    start: np.ndarray             # as in a block
    row: np.ndarray


def _parts(b: _Block, leaders: _Leaders | None, most: int) -> list[_Part]:
    """The records by their nearest leader, at most ``most`` in a part."""
    n, width = len(b.size), len(b.vocabulary)
    column = np.repeat(np.arange(width), np.diff(b.start))
    if leaders:
        to = pc.index_in(b.vocabulary, value_set=leaders.vocabulary)
        has = leaders.has[to.fill_null(0).to_numpy()] & to.is_valid().to_numpy(zero_copy_only=False)[:, None]
        shared = np.stack([np.bincount(b.row[has[column, k]], minlength=n) for k in range(len(leaders.size))], 1)
        far = 1 - shared / (b.size[:, None] + leaders.size - shared)
        nearest = far.argmin(1)
        order = np.lexsort((far.min(1), nearest))
        cuts = np.flatnonzero(np.diff(nearest[order])) + 1
    else:
        far, order, cuts = np.zeros((n, 0)), np.arange(n), np.zeros(0, np.int64)
    ends = np.unique(np.concatenate([np.arange(lo, hi, most) for lo, hi in zip([0, *cuts], [*cuts, n], strict=True)] + [[n]])).astype(np.int64)
    of, place = np.empty(n, np.int64), np.empty(n, np.int64)
    of[order] = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    place[order] = np.arange(n) - np.repeat(ends[:-1], np.diff(ends))
    part = of[b.row]
    by = np.argsort(part.astype(np.uint16) if len(ends) <= 1 << 16 else part, kind="stable")
    many = np.bincount(part * width + column, minlength=(len(ends) - 1) * width).reshape(-1, width)
    row, end = place[b.row[by]], np.append(0, np.cumsum(many.sum(1)))
    return [_Part(order[ends[k]:ends[k + 1]], b.size[order[ends[k]:ends[k + 1]]], far[order[ends[k]:ends[k + 1]]],
                  np.append(0, np.cumsum(many[k])), row[end[k]:end[k + 1]]) for k in range(len(ends) - 1)]


def _near(p: _Part, q: _Part, num: int, den: int) -> _Part | None:
    """The records of ``p`` that can reach the threshold with one of ``q``: by
    their size, and by the triangle inequality of the Jaccard distance."""
    most = 1 - num / den + 1e-9
    keep = (p.size * den >= q.size.min() * num) & (p.size * num <= q.size.max() * den) \
        & ((p.far >= q.far.min(0) - most) & (p.far <= q.far.max(0) + most)).all(1)
    if keep.sum() > 0.8 * len(keep):
        return p
    if not keep.any():
        return None
    here, place = keep[p.row], np.cumsum(keep) - 1
    return _Part(p.at[keep], p.size[keep], p.far[keep], np.append(0, np.cumsum(here))[p.start], place[p.row[here]])


def _overlap(p: _Part, q: _Part, in_p: np.ndarray, in_q: np.ndarray, merge: bool) -> np.ndarray:
    """Shared grams of every record of ``p`` with every one of ``q``. The grams
    that both have are columns ``in_p`` and ``in_q``; 0/1 rows are multiplied over
    the frequent ones, for others the pairs that share one are listed."""
    out = np.zeros((len(p.at), len(q.at)), np.float32)
    n_p, n_q = np.diff(p.start)[in_p], np.diff(q.start)[in_q]
    pairs = n_p * n_q
    frequent = pairs * LIST >= out.size

    def matrix(s: _Part, columns: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, row = np.repeat(np.arange(len(columns)), n), s.row[_runs(s.start[columns], n)]
        if merge:
            return np.bincount(at * len(s.at) + row, minlength=len(columns) * len(s.at)).astype(np.float32).reshape(len(columns), -1)
        m = np.zeros((len(columns), len(s.at)), np.float32)
        m[at, row] = 1
        return m

    both = np.flatnonzero(frequent & (pairs > 0))
    for lo in range(0, len(both), BLOCK_COLUMNS):
        k = both[lo:lo + BLOCK_COLUMNS]
        out += matrix(p, in_p[k], n_p[k]).T @ matrix(q, in_q[k], n_q[k])
    rare = np.flatnonzero(~frequent & (pairs > 0))
    for k in np.split(rare, np.flatnonzero(np.diff(np.cumsum(pairs[rare]) // LISTED)) + 1):
        column, j = np.repeat(k, n_q[k]), q.row[_runs(q.start[in_q[k]], n_q[k])]
        i = p.row[_runs(p.start[in_p[column]], n_p[column])]
        if len(i):
            out += np.bincount(i * len(q.at) + np.repeat(j, n_p[column]), minlength=out.size).reshape(out.shape)
    return out


def trigram_join(a: DataFrame, b: DataFrame, a_id: str, a_text: str, b_id: str, b_text: str,
                 threshold: float = DEFAULT_TRGM_THRESHOLD, self_join: bool = False,
                 method: str = "auto") -> DataFrame:
    """All (a, b) pairs whose trigram sets have Jaccard similarity
    >= ``threshold`` (> 0), exactly.

    Records are put in blocks of like size, and blocks meet whose sizes can
    reach the threshold. The shared grams of two blocks are a product of 0/1
    matrices, so a pair costs no row before it is known to reach the threshold,
    however common its grams. A group holds ``STAY`` blocks of the larger side
    and ``COME`` of the other, so a block is copied to few groups. Where ``a`` is
    a query set of one block, the work grows with ``b``; a self-join looks at
    every pair of like size that is not too far apart by its distances to the
    group's leaders (above a threshold of a half). With ``self_join`` (a is b)
    pairs are reported once with a < b.

    The methods differ where an id repeats or is null. ``probe`` (default when
    ``a`` is a query set, e.g. passages or search strings): rows of one id and
    gram count are one record, null being an id, and add up their grams.
    ``prefix`` (default for self-joins): every row with an id is a record.
    The gram sets are stored when this is called.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if method == "auto":
        method = "prefix" if self_join else "probe"
    if method not in ("probe", "prefix"):
        raise ValueError(method)
    num, den = _ratio(threshold)
    merge = method == "probe"
    spark = a.sparkSession

    def stored(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        path = shared_path(spark, "trigrams")
        t = df.select(id_col, text_col) if id_col != text_col else df.select(id_col)
        if not merge:
            t = t.filter(F.col(id_col).isNotNull())
        # Dealt out first if files are few: a file can be one task, and texts are dear to cut.
        if len(t.inputFiles()) < spark.sparkContext.defaultParallelism:
            t = t.repartition(2 * spark.sparkContext.defaultParallelism)
        _gram_sets(t, id_col, text_col).write.parquet(path)
        return spark.read.parquet(path).filter(F.col("_n") > 0)

    blocks_a = _blocks(stored(a, a_id, a_text), merge)
    blocks_b = blocks_a if self_join else _blocks(stored(b, b_id, b_text), merge)
    # The larger side stays: it goes to few groups, the other one to many.
    swap = blocks_b.grams > blocks_a.grams
    large, small = (blocks_b, blocks_a) if swap else (blocks_a, blocks_b)
    stay, come, group = [], [], 0
    for first in range(0, len(large.sizes), STAY):
        home = large.sizes[first:first + STAY]
        meet = [k for k, (lo, hi) in enumerate(small.sizes) if (not self_join or k >= first)
                and hi * den >= home[0][0] * num and lo * num <= home[-1][1] * den]
        for k in range(0, len(meet), COME):
            stay += [(first + x, group) for x in range(len(home))]
            come += [(x, group) for x in meet[k:k + COME]]
            group += 1
    # New column ids on each side, as both may come from one table.
    left, right = (t.packed.join(F.broadcast(spark.createDataFrame(to, "_block int, _group int")), "_block")
                   .select(F.col("_group").alias("_group"), *(F.col(c).alias(c) for c in t.packed.columns)).groupBy("_group")
                   for t, to in ((large, stay), (small, come)))
    close = not merge and 2 * num > den

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        """A row for each tile that has pairs: the records of its rows and
        columns, bits of the pairs that reach the threshold, and their shared grams."""
        out: list[pa.RecordBatch] = []
        homes, leaders = list(_unpack(x)), None
        if close and homes:
            leaders = _leaders(max(homes, key=lambda h: len(h.ids)), num / den)
        homes = [(h, _parts(h, leaders, TILE[0])) for h in homes]
        for c in _unpack(y) if homes else ():
            parts = _parts(c, leaders, TILE[1])
            for h, own in homes:
                if self_join and h.number > c.number:
                    continue
                to_h = pc.index_in(c.vocabulary, value_set=h.vocabulary)
                in_c = np.flatnonzero(to_h.is_valid().to_numpy(zero_copy_only=False))
                in_h = to_h.take(pa.array(in_c)).to_numpy()
                for p, q in ((p, q) for p in own for q in parts):
                    if (p := _near(p, q, num, den)) is None or (q := _near(q, p, num, den)) is None:
                        continue
                    m = _overlap(p, q, in_h, in_c, merge)
                    hit = (m > 0) & (m >= np.add.outer(p.size * (num / (num + den)), q.size * (num / (num + den)) - 0.5))
                    if self_join and h.number == c.number:
                        hit &= p.at[:, None] < q.at[None, :]
                    i, j = np.nonzero(hit)
                    shared, np_, nq = m[i, j].astype(np.int64), p.size[i], q.size[j]
                    ok = (shared * (num + den) >= (np_ + nq) * num) & (nq * den >= np_ * num) & (nq * num <= np_ * den)
                    if not ok.any():
                        continue
                    hit[i[~ok], j[~ok]] = False
                    i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                    out.append(pa.record_batch([
                        *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for b, s, at in ((h, p, i), (c, q, j))
                          for v in (b.ids.take(pa.array(s.at[at])), pa.array(s.size[at].astype(np.int32)))),
                        pa.array([np.packbits(hit[np.ix_(i, j)]).tobytes()], pa.binary()),
                        pa.array([(shared := shared[ok]).astype(np.uint16 if shared.max() < 1 << 16 else np.int64).tobytes()], pa.binary())], schema=tiles))
        return pa.Table.from_batches(out, tiles)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[list]) -> pa.RecordBatch:
            return pa.record_batch([pa.concat_arrays(x) for x in zip(*found, strict=True)], schema=found_as)

        found, held = [], 0
        for batch in batches:
            for k in range(len(batch)):
                ids, n, other_ids, other_n = (batch.column(c)[k].values for c in range(4))
                bits, shared = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in (4, 5))
                i, j = np.divmod(np.flatnonzero(np.unpackbits(bits, count=len(ids) * len(other_ids))), len(other_ids))
                i, j, shared = pa.array(i), pa.array(j), shared.view(np.uint16 if len(shared) == 2 * len(i) else np.int64)
                x, y = (ids.take(i), n.take(i)), (other_ids.take(j), other_n.take(j))
                (a_, an), (b_, bn) = (y, x) if swap else (x, y)
                found.append([a_, b_, an, bn, pa.array(shared.astype(np.int64))])
                held += len(i)
                if held >= FOUND:
                    yield rows(found)
                    found, held = [], 0
        if found:
            yield rows(found)

    kinds = [t.packed.schema["ids"].dataType.elementType.simpleString() for t in (large, small)]
    tile = f"_x array<{kinds[0]}>, _xn array<int>, _y array<{kinds[1]}>, _yn array<int>, _bits binary, _shared binary"
    pair = "_a {}, _b {}, _an int, _bn int, shared long".format(*(kinds[::-1] if swap else kinds))
    tiles, found_as = (to_arrow_schema(StructType.fromDDL(x)) for x in (tile, pair))
    found = left.cogroup(right).applyInArrow(compare, tile).mapInArrow(pairs, pair)
    if self_join:
        up = F.col("_a") < F.col("_b")
        found = found.filter(F.col("_a") != F.col("_b")).select(
            F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"),
            F.when(up, F.col("_an")).otherwise(F.col("_bn")).alias("_an"),
            F.when(up, F.col("_bn")).otherwise(F.col("_an")).alias("_bn"), "shared")
    return _result(found, a_id, b_id, num, den)


def trigram_search(df: DataFrame, id_col: str, text_col: str, q: str,
                   threshold: float = DEFAULT_TRGM_THRESHOLD) -> DataFrame:
    """R72 against one query string (``similarity(text, q) >= t``)."""
    qdf = df.sparkSession.createDataFrame([(0, q)], "qid int, qtext string")
    return trigram_join(qdf, df, "qid", "qtext", id_col, text_col, threshold).drop("qid")


def unaccent(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Accent-free search key."""
    return df.withColumn(out or f"{col}_unaccent", S.unaccent(col))


def ci_group(df: DataFrame, col: str, id_col: str | None = None) -> DataFrame:
    """Case-insensitive grouping of a column (key = lower case)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if id_col:
        aggs.append(F.count_distinct(id_col).alias("records"))
    return df.groupBy(F.lower(F.col(col)).alias(f"{col}_ci")).agg(*aggs)


def ci_join(a: DataFrame, b: DataFrame, a_col: str, b_col: str, how: str = "inner") -> DataFrame:
    """Case-insensitive equality join through the ``UTF8_LCASE``
    collation (a hash join on collation keys)."""
    return a.join(b, F.collate(a[a_col], "UTF8_LCASE") == F.collate(b[b_col], "UTF8_LCASE"), how)


def ci_group_collated(df: DataFrame, col: str) -> DataFrame:
    """R74 with the collation as the grouping key: ``n`` rows a group, and the
    smallest of its spellings (by bytes) in its name."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.collate(F.col(col), "UTF8_LCASE").alias("_k"))
            .agg(F.min(F.col(col)).alias(col), F.count(F.lit(1)).alias("n")).drop("_k"))


def word_counts_ci(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Case-insensitive word frequencies over whole texts (partial
    aggregation merges a hot word map-side)."""
    w = df.select(id_col, F.explode(words(text_col)).alias("word"))
    # Two plain aggregates instead of a distinct count (no Expand): per
    # (word, record), then per word.
    per = w.groupBy("word", id_col).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("word").agg(F.sum("_n").cast("bigint").alias("n"),
                                   F.count(F.lit(1)).alias("records"))


# ---------------------------------------------------------------------------
# Key-value metadata and tree paths
# ---------------------------------------------------------------------------
def kv_ops(df: DataFrame, id_col: str, json_col: str, extra: dict[str, str] | None = None,
           key: str | None = None) -> DataFrame:
    """JSON object -> map, optional merge with constant pairs, then one
    row per (id, key, value); ``has_key`` flags ``key`` in the source map."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    if extra:
        right = F.create_map(*[x for kv in extra.items() for x in map(F.lit, kv)])
        # The right side wins a shared key; map_concat itself refuses one.
        m2 = F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(right, k)), right)
    else:
        m2 = m
    base = df.select(id_col, m.alias("_m"), m2.alias("_m2"))
    if key:
        base = base.withColumn("has_key", F.coalesce(F.map_contains_key("_m", F.lit(key)), F.lit(False)))
    cols = [id_col] + (["has_key"] if key else [])
    return base.select(*cols, F.explode("_m2").alias("key", "value"))


URL_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def path_rollup(df: DataFrame, url_col: str) -> DataFrame:
    """Every ancestor prefix of each URL path (root '/' included) with
    its depth and the number of records in its subtree."""
    path = F.regexp_extract(F.col(url_col), URL_PATH, 1)
    segs = F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)
    p = df.select(segs.alias("_s"))
    anc = p.select(F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("depth"), "_s")
    prefix = F.when(F.col("depth") == 0, F.lit("/")).otherwise(
        F.concat(F.lit("/"), F.array_join(F.slice("_s", F.lit(1), F.col("depth")), "/")))
    return anc.groupBy(prefix.alias("prefix"), "depth").agg(F.count(F.lit(1)).alias("records"))
