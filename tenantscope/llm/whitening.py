"""Operator 13: embedding whitening by shifted CholeskyQR.

Entries become integers, ``x = floor(64 c) + 1000000``, so that sums and
deviations are exact. The centred rows ``Y = x - S / n`` are never stored. Each
pass over the table forms the Gram matrix of the rows as they are then, task by
task, and its Cholesky factor makes them more orthonormal in the next pass:

    G = Q'Q,  R'R = G (+ a shift in the first pass),  Q <- Q R^-1

``Q R^-1`` is a triangular solve on the rows that a task holds. The shift keeps
the first factor defined when ``Y`` is ill-conditioned; two more passes remove
what it cost, as their Gram matrices are close to the identity. The factors
compose to ``Y = Q R``, and the SVD of the small ``R`` has the principal
directions and spreads of ``Y``, without squaring its condition.

Only d sums and d (d + 1) / 2 Gram entries (d: the dimension) come to the driver
from a pass, already added up over all tasks; rows stay in their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
PASSES = 3
SCALE, OFFSET = 64, 1_000_000
#: Larger entries take no part: their integers would leave no room for sums.
MAX_ENTRY = float(1 << 32)
#: Directions with less of the largest spread than this are no components.
RANK = 1e-12
#: Entries of the rows that a task works on at a time.
BLOCK = 1 << 19


class Fit(NamedTuple):
    n: int
    dim: int
    sums: list[int]               # exact, per dimension
    wide: bool                    # n * x may pass 64 bits
    axes: np.ndarray              # dim x k, unit columns
    variance: np.ndarray          # of each component, falling
    explained: np.ndarray
    identity_error: float


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id``, ``x`` (array of double) of the rows with a whole, finite vector."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MAX_ENTRY))
    return x.where(F.coalesce(F.size("x"), F.lit(0)) > 0).where(whole)


def integers(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches and the integers of their vectors."""
    for batch in batches:
        if not len(batch):
            continue
        lists = batch.column(batch.schema.get_field_index("x"))
        dim = len(lists[0])
        step = max(1, BLOCK // dim)
        for i in range(0, len(batch), step):
            part = batch.slice(i, step)
            yield part, integers(part.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(len(part), dim))


def scaled(x: np.ndarray, fit: Fit | tuple) -> np.ndarray:
    """``n x - S``, exactly: 64-bit where it fits, else Python's integers."""
    n, sums, wide = fit
    if wide:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array(sums, np.int64)


def solve_right(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``y r^-1`` for an upper triangular ``r``, column by column."""
    q = np.empty_like(y)
    for j in range(r.shape[1]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``of`` (which maps a block of integers to
    ``size`` numbers): one partial sum a task, added up by Spark."""
    dtype = np.float64 if kind == "double" else np.int64

    def partial(batches):
        total = None
        for _, x in _blocks(batches):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(size)), pa.array(total.astype(dtype))], names=["k", "v"])

    out = rows.select("x").mapInArrow(partial, f"k long, v {kind}").groupBy("k") \
        .agg(F.sum("v" if kind == "double" else F.col("v").cast("decimal(38,0)")).alias("v"))
    total = np.zeros(size, np.float64 if kind == "double" else object)
    for r in out.collect():  # ``size`` rows, in one job however many partitions they lie in
        total[r["k"]] = r["v"] if kind == "double" else int(r["v"])
    return total


def _gram(rows: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    upper = np.triu_indices(dim)

    def part(x):
        q = of(x)
        return (q.T @ q)[upper]

    g = np.zeros((dim, dim))
    g[upper] = _summed(rows, part, len(upper[0]))
    return g + np.triu(g, 1).T


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular ``R`` with ``R'R = G``, plus a shift if it is asked for
    or ``G`` is not positive definite."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(g, 2)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def _root(g: np.ndarray) -> np.ndarray:
    """Any ``R`` with ``R'R = G``; triangular where ``G`` has full rank."""
    try:
        return np.linalg.cholesky(g).T
    except np.linalg.LinAlgError:
        e, w = np.linalg.eigh(g)
        return np.sqrt(np.maximum(e, 0))[:, None] * w.T


def fit(rows: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> Fit | None:
    """Principal directions of all ``rows`` (``usable``; one length); None
    without rows. Directions along which nothing varies are left out."""
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform("x", F.abs))).alias("m")).first()
    if not shape["n"]:
        return None
    n, dim = shape["n"], shape["d"]
    wide = n * (SCALE * shape["m"] + OFFSET + 1) * 2 >= 1 << 62
    sums = [int(s) for s in _summed(rows, lambda x: x.sum(0), dim, "long")]
    exact = (n, sums, wide)
    factors: list[np.ndarray] = []

    def q(x):
        y = scaled(x, exact).astype(np.float64) / n
        for r in factors:
            y = solve_right(y, r)
        return y

    none = Fit(n, dim, sums, wide, np.zeros((dim, 0)), np.zeros(0), np.zeros(0), 0.0)
    for k in range(passes):
        g = _gram(rows, dim, q)
        if not k and not g.any():
            return none
        factors = [*factors, factor(g, n, not k) if k < passes - 1 else _root(g)]
    r = np.eye(dim)
    for f in factors:
        r = f @ r
    _, s, vt = np.linalg.svd(r)
    keep = min(components, int((s > RANK * s[0]).sum()))
    axes, variance = vt[:keep].T, s[:keep] ** 2 / n
    to = axes / np.sqrt(variance)

    def whitened(x):
        w = scaled(x, exact).astype(np.float64) / n @ to
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = _summed(rows, whitened, keep + keep * keep)
    mean = total[:keep] / n
    cov = total[keep:].reshape(keep, keep) / n - np.outer(mean, mean)
    return Fit(n, dim, sums, wide, axes, variance, variance / (s ** 2 / n).sum(), float(np.abs(cov - np.eye(keep)).max()))


def _deviation(k: np.ndarray) -> pa.Array:
    """Exact sums of squares; null beyond 38 digits."""
    kind = pa.decimal128(38, 0)
    most = int(np.abs(k).max()) if k.dtype != object else 1 << 62
    if most * most * k.shape[1] < 1 << 63:
        return pa.array((k * k).sum(1)).cast(kind)
    sums = [sum(int(c) ** 2 for c in row) for row in k]
    return pa.array([Decimal(s) if s < 10 ** 38 else None for s in sums], kind)


def whiten(vectors: DataFrame, components: int = COMPONENTS, *, column: str = "embedding",
           passes: int = PASSES) -> tuple[DataFrame, Fit | None]:
    """``vec_id long, deviation decimal(38,0), whitened array<double>`` of every
    row of ``vectors`` with a usable vector, and the fit: ``deviation`` is the
    sum over dimensions of ``(n x - S)^2``, ``whitened`` the row on the first
    ``components`` principal directions, each scaled to variance 1.

    Rows take no part whose vector is null, empty, holds null or non-finite
    entries or entries beyond ``MAX_ENTRY``, or is not as long as most of the
    others (of equally many the longest). Null and repeated vec_ids stay, row by
    row. Directions without variance have no component, so equal vectors alone
    give empty arrays; an empty table gives no row and the fit None. Other
    columns are ignored.
    """
    rows = usable(vectors, column)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return rows.limit(0).select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.col("x").alias("whitened")), None
    rows = rows.where(F.size("x") == length["d"])
    f = fit(rows, components, passes)
    exact, to = (f.n, f.sums, f.wide), f.axes / np.sqrt(f.variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            k = scaled(x, exact)
            w = k.astype(np.float64) / exact[0] @ to
            ends = np.arange(len(part) + 1, dtype=np.int32) * w.shape[1]
            yield pa.record_batch([part.column(0), _deviation(k), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))],
                                  names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>"), f


def op13_embedding_whitening(embeddings: DataFrame) -> DataFrame:
    """One row per vector and component up to 32: vec_id, component, n,
    deviation, whitened, explained, identity_error. ``deviation`` is null beyond
    64 bits."""
    rows, f = whiten(embeddings)
    explained = F.array(*[F.lit(float(e)) for e in (f.explained if f else [])]).cast("array<double>")
    return rows.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(f.n if f else 0).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(f.identity_error if f else 0.0).alias("identity_error"))
