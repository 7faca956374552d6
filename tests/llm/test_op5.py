"""Nearest neighbours: recall and order against brute force."""

import numpy as np
import pytest
from tenantscope.llm.ann import KdTree, chi_square_quantile, nearest, op5_nearest_neighbours


def exact(rows, queries, k=20):
    ok = {}
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for i, q in {(i, tuple(q)): (i, q) for i, q in queries if (i, tuple(q)) not in ok}.values():
        if not q or not any(q):
            continue
        s = sorted((-float((v * np.array(q)).sum()), j) for j, v in good if j != i and len(v) == len(q))
        out[i] = [(j, -x) for x, j in s[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    emb = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in emb.collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0])
    for df in (op5_nearest_neighbours(emb), nearest(emb, emb.where("vec_id % 20 = 0"), block_vectors=150, block_queries=20)):
        got = found(df)
        assert got.keys() == want.keys()
        hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        vec = dict(rows)
        for i, xs in got.items():
            assert len(xs) == len(want[i]) and xs == sorted(xs, key=lambda x: (-x[1], x[0]))
            assert np.allclose([s for _, s in xs], [np.dot(np.array(vec[j], float), np.array(vec[i], float)) for j, _ in xs], atol=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [3.0, -1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (40, [0.0, 0.0]), (60, None), (None, [5.0, 5.0]), (7, [-1.0, -2.0]), (8, [1.0, 2.0, 3.0]), (80, [1.0, 0.0, 1.0]), (9, []), (0, [1.0, 2.0]),
            (7, [-1.0, -2.0])] + [(100 + i, [2.0, 2.0]) for i in range(60) if (100 + i) % 20]
    emb = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    want = exact(rows, [(i, v) for i, v in rows if i is not None and i % 20 == 0 and v])
    for kw in ({}, {"block_vectors": 10, "block_queries": 1}):
        assert found(nearest(emb, emb.where("vec_id % 20 = 0"), confidence=1 - 1e-9, **kw)) == want
    assert want[0][0] == (101, 6.0) and want.keys() == {0, 20, 80}
    assert not op5_nearest_neighbours(emb.limit(0)).collect()


def test_parts():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    x = np.random.default_rng(0).standard_normal((500, 4))
    t = KdTree(x, 16)
    assert sorted(t.order.tolist()) == list(range(500)) and max(b - a for a, b in t.bounds) <= 16
    q = np.zeros((1, 4))
    for d, (a, b) in zip(t.distances(q)[0], t.bounds):
        assert d <= (x[t.order[a:b]] ** 2).sum(1).min() + 1e-12
