"""Whitening against a plain eigendecomposition of the exact covariance."""

import numpy as np
import pytest
from tenantscope.llm import whitening
from tenantscope.llm.whitening import integers, op13_embedding_whitening, solve_right, whiten


def plain(rows):
    """(n, deviations, eigenvalues, projections over sqrt(e)) of exact integers."""
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    k = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in x]
    y = np.array([[a / n for a in v] for v in k])
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    return n, [sum(a * a for a in v) for v in k], e, y, w


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    emb = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    source = {r.vec_id: list(r.embedding) for r in emb.collect()}
    ids = sorted(source)
    n, dev, e, y, w = plain([source[i] for i in ids])
    got = {}
    for r in op13_embedding_whitening(emb).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == ids and all(sorted(g) == list(range(1, 33)) for g in got.values())
    white = np.array([[got[i][c].whitened for c in range(1, 33)] for i in ids])
    want = y @ w[:, :32] / np.sqrt(e[:32])
    sign = np.sign((white * want).sum(0))
    assert np.abs(white - want * sign).max() < 1e-8
    assert np.abs(white.T @ white / n - np.eye(32)).max() < 1e-10
    first = got[ids[0]]
    assert {r.n for g in got.values() for r in g.values()} == {n}
    assert [got[i][1].deviation for i in ids] == dev and {r.deviation for r in first.values()} == {dev[0]}
    assert np.allclose([first[c].explained for c in range(1, 33)], (e / e.sum())[:32], rtol=1e-10)
    assert len({r.identity_error for g in got.values() for r in g.values()}) == 1 and 0 <= first[1].identity_error < 1e-10


def test_ill_conditioned_rows(spark):
    """Columns that are nearly the same: the shift of the first pass is needed,
    the next passes remove its trace."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((400, 1)) * 3e7
    rows = np.floor(np.hstack([a, a + rng.integers(-1, 2, (400, 1)) / 64, rng.standard_normal((400, 2)), np.full((400, 1), 5.0)]) * 64) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
    out, fit = whiten(df)
    n, dev, e, y, w = plain(rows)
    got = {r.vec_id: r for r in out.collect()}
    assert len(fit.variance) == 4 and fit.identity_error < 1e-6  # the constant column has no component
    assert np.allclose(fit.variance[:3], e[:3], rtol=1e-6)
    assert [int(got[i].deviation) for i in range(400)] == dev
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    white = np.array([got[i].whitened for i in range(400)])
    assert np.allclose(np.abs((white * u[:, :4]).sum(0)), np.sqrt(n), rtol=1e-4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (None, [-1.0, 2.0, 0.015]), (2, None), (3, []), (4, [nan, 1.0, 1.0]), (5, [1.0, inf, 0.0]),
            (6, [None, 1.0, 1.0]), (7, [1.0, 2.0]), (8, [4.0, 0.0, -0.25]), (9, [0.0, 0.0, 0.0]), (10, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(4)
    keep = [(i, np.array(v, np.float32)) for i, v in rows if i in (1, None, 8, 9)]
    got = op13_embedding_whitening(df).collect()
    n, dev, e, y, w = plain([v for _, v in keep])
    assert n == 5 and len(got) == 5 * 3 and {r.n for r in got} == {5}
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for (i, _), d in zip(keep, dev, strict=True))
    want = np.sort(np.abs(y @ w / np.sqrt(e)).ravel())
    assert np.allclose(np.sort([abs(r.whitened) for r in got]), want, atol=1e-9)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], df.schema[:2])
    assert not op13_embedding_whitening(same).collect()
    out, fit = whiten(same)
    assert [(r.deviation, r.whitened) for r in out.collect()] == [(0, [])] * 4 and fit.n == 4
    assert not op13_embedding_whitening(df.limit(0)).collect()


def test_numbers_beyond_64_bits(spark):
    big = [2.0 ** 31 - 7, -(2.0 ** 31), 3.5, 1.25]
    df = spark.createDataFrame([(i, [v, -v / 3]) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    out, fit = whiten(df)
    n, dev, *_ = plain([[v, -v / 3] for v in big])
    assert sorted(int(r.deviation) for r in out.collect()) == sorted(dev)
    x = integers(np.array([[v, -v / 3] for v in big]))
    assert (whitening.scaled(x, (n, fit.sums, True)) == whitening.scaled(x, (n, fit.sums, False))).all()
    wide = np.array([[3 << 60, 1], [-(3 << 60), 5]], object)
    assert [int(v) for v in whitening._deviation(np.array([[1 << 61, 1]], object)).to_pylist()] == [(1 << 122) + 1]
    assert whitening._deviation(wide * 100).to_pylist() == [None, None]


def test_triangular_solve():
    rng = np.random.default_rng(0)
    r = np.triu(rng.standard_normal((6, 6))) + 4 * np.eye(6)
    y = rng.standard_normal((9, 6))
    assert np.allclose(solve_right(y, r) @ r, y)


def test_sums_come_in_one_job_however_many_partitions(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 6)))], "vec_id long, embedding array<double>")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("whitening-sums", "sums")
        whiten(df)
        jobs = len(sc.statusTracker().getJobIdsForGroup("whitening-sums"))
    finally:
        sc._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < jobs <= 30  # not one for each partition of each pass
