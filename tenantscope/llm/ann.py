"""Operator 5: nearest neighbours by stable projections and an incremental search.

Inner products become distances: with M the largest norm, a vector x gets the
extra component sqrt(M^2 - |x|^2) and a query is scaled to norm M, so the
largest inner product is the smallest distance. A few Gaussian (2-stable)
projections then keep distances up to a chi-square factor: the projected
distance of two points, squared and divided by their true one squared, follows
chi-square with as many degrees of freedom as there are projections.

Vectors are indexed in blocks: each block's projections go into a kd-tree. A
query takes the tree's leaves in order of their projected distance and
verifies all vectors in them with true inner products. It stops when the next
leaf is so far away that, by the chi-square test, a vector nearer than the
k-th found would lie beyond it with a probability of at most 1 - ``confidence``.

Queries and vectors meet in a grid of (vector block, query block) cells of
bounded size; no side is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
PROJECTIONS = 8
CONFIDENCE = 0.98
LEAF = 32
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 4096
_SEED = 7


def chi_square_quantile(p: float, m: int) -> float:
    """Inverse of the chi-square distribution function for an even ``m``."""
    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total
    lo, hi = 0.0, 1e4
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Leaves of a median-split kd-tree: ranges of ``order`` and their boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            part = points[self.order[lo:hi]]
            spread = part.max(0) - part.min(0) if hi > lo else np.zeros(1)
            if hi - lo <= leaf or not spread.max():
                bounds.append((lo, hi))
                continue
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, spread.argmax()], mid)]
            todo += [(lo + mid, hi), (lo, lo + mid)]
        self.bounds = bounds
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in bounds])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in bounds])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each point of ``q`` to each leaf's box."""
        out = np.zeros((len(q), len(self.low)))
        for j in range(q.shape[1]):
            x = q[:, j:j + 1]
            out += np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0) ** 2
        return out


def search_block(x: np.ndarray, q: np.ndarray, norm: float, k: int, *, projections: int = PROJECTIONS,
                 confidence: float = CONFIDENCE, leaf: int = LEAF) -> np.ndarray:
    """Rows of ``x`` found nearest to each query, ``k`` or all (-1: none)."""
    k = min(k, len(x))
    lift = np.sqrt(np.maximum(norm ** 2 - (x * x).sum(1), 0))
    a = np.random.default_rng(_SEED).standard_normal((x.shape[1] + 1, projections))
    scale = norm / np.sqrt((q * q).sum(1))
    qs = q * scale[:, None]
    tree = KdTree(x @ a[:-1] + lift[:, None] * a[-1], leaf)
    far = tree.distances(qs @ a[:-1])
    visit = np.argsort(far, axis=1, kind="stable")
    beyond = chi_square_quantile(confidence, projections)
    score = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), -1, np.int64)
    active = np.arange(len(q))
    for t in range(len(tree.bounds)):
        # A distance in the lifted space: |q|^2 + |x|^2 - 2 q.x with both norms M.
        kth = np.maximum(2 * norm ** 2 - 2 * score[active, -1], 0)
        active = active[~(far[active, visit[active, t]] > beyond * kth)]
        if not len(active):
            break
        at = visit[active, t]
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            rows, leaf_no = active[order[lo:hi]], at[order[lo]]
            members = tree.order[slice(*tree.bounds[leaf_no])]
            s = np.hstack([score[rows], qs[rows] @ x[members].T])
            i = np.hstack([found[rows], np.broadcast_to(members, (len(rows), len(members)))])
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            low = np.argsort(-s, axis=1)
            score[rows], found[rows] = np.take_along_axis(s, low, 1), np.take_along_axis(i, low, 1)
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy().reshape(len(lists), -1)


_FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_SQL = "query_id long, query_key long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, *, confidence: float = CONFIDENCE,
            projections: int = PROJECTIONS, leaf: int = LEAF, block_vectors: int = BLOCK_VECTORS,
            block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` vectors with the largest inner product found for each query:
    ``query_id long, rank int, vec_id long, score double``, nearest first, ties
    to the smaller vec_id. Both inputs: ``vec_id``, ``embedding`` (an array of
    numbers). A row with a query's vec_id is no candidate of it; with fewer
    candidates all are returned.

    Rows whose vec_id or embedding is null, empty, zero or holds a null or
    non-finite component take no part. Vectors only meet queries of their own
    length. Repeated rows are candidates each; a query row that is repeated
    whole is answered once, rows with one vec_id and different vectors each for
    itself. Empty tables give no row. Other columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
        ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ok & F.exists("x", lambda c: c != 0))

    if projections % 2:
        raise ValueError("the number of projections must be even")
    v, q = clean(vectors), clean(queries).dropDuplicates(["vec_id", "x"])
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))
    size = v.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    n_queries = q.count()
    blocks, q_blocks = (max(1, -(-n // per)) for n, per in ((size["n"], block_vectors), (n_queries, block_queries)))
    top_norm = float(size["m"] or 0) * (1 + 1e-12)
    # Both sides of a cell need keys of one type (long) to meet.
    long = lambda n: F.lit(n).cast("long")
    every = lambda n: F.explode(F.sequence(long(0), long(n - 1)))
    cells = v.select("vec_id", "x", F.size("x").alias("dim"), F.pmod(F.xxhash64("vec_id"), long(blocks)).alias("block"),
                     every(q_blocks).alias("q_block"))
    key = F.xxhash64("vec_id", "x")
    asks = q.select("vec_id", "x", key.alias("key"), F.size("x").alias("dim"), F.pmod(key, long(q_blocks)).alias("q_block"),
                    every(blocks).alias("block"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        left = left.sort_by("vec_id")
        ids, all_x = left.column("vec_id").to_numpy(), _matrix(left.column("x"))
        qid, qkey, qx = right.column("vec_id").to_numpy(), right.column("key").to_numpy(), _matrix(right.column("x"))
        # Equal vectors are searched once; each stands for its smallest ids.
        rows = np.ascontiguousarray(all_x + 0.0).view(f"V{8 * all_x.shape[1]}").ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        x = all_x[first]
        order = np.argsort(which, kind="stable")
        begin = np.searchsorted(which[order], np.arange(len(first) + 1))
        # One place for the query's own row, some for scores that differ in
        # their last bits from the sums that rank the result.
        found = search_block(x, qx, top_norm, k + 9, projections=projections, confidence=confidence, leaf=leaf)
        out = []
        for j in range(len(qx)):
            hit = found[j][found[j] >= 0]
            score = (x[hit] * qx[j]).sum(1)
            same = [order[begin[h]:begin[h + 1]][:k + 1] for h in hit]
            cand = ids[np.concatenate(same)]
            sc = np.repeat(score, [len(s) for s in same])
            other = cand != qid[j]
            cand, sc = cand[other], sc[other]
            best = np.lexsort((cand, -sc))[:k]
            out.append((np.full(len(best), qid[j]), np.full(len(best), qkey[j]), cand[best], sc[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_FOUND)

    by = ["block", "q_block", "dim"]
    found = cells.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(cell, _FOUND_SQL)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
