"""Prefix trie against plain dictionaries; centroid totals against a walk."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tenantscope.llm import prefix_trie
from tenantscope.llm.centroid import decompose, subtree_totals
from tenantscope.llm.prefix_trie import ORACLE, conversation_trie, op11_prefix_trie
from tenantscope.llm.scan import MASK, running


def conversations(rows):
    """Turns of each conversation in order."""
    out = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def trie(convs):
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    leaf = dict.fromkeys(nodes, True)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
            leaf[k[:-1]] = False
    for k, m in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += leaf[k]
            saved[k[:d]] += (len(m) - 1) * words
    return sorted((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest()) for k, m in nodes.items())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(parts)


def test_query(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = trie(rebuilt(conversations([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])))
    assert sorted(tuple(r) for r in op11_prefix_trie(df).collect()) == want


def random_rows(seed, convs=90):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-25, 300), convs):
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t * 3 + 1]) if t else None, rng.choice(["user", "bot", None]), rng.choice(["hi there", "a  b\tc", "", None, "x é y"])))
    seen, out = set(), []
    for r in rows:  # no ties here: their order is a digest's
        if r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


@pytest.mark.parametrize("seed,local", [(1, 60), (3, 10 ** 6)])
def test_odd_conversations(spark, seed, local, monkeypatch):
    rows = [*random_rows(seed), (None, 0, "user", "lost"), (301, 0, "user", "long " * 50_000), (341, None, None, None)]
    df = frame(spark, rows)
    turns = prefix_trie.turns_of(df)
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), local_nodes=local).collect()
    assert sorted(tuple(r) for r in got) == trie(rebuilt(conversations(rows)))
    plain = conversation_trie(df, local_nodes=local).collect()
    assert sorted(tuple(r)[:8] for r in plain) == trie(conversations(rows))
    own = conversations(rows)
    assert all((r.role, r.text) == ((None, None) if not r.depth else own[r.conv_id][r.depth - 1]) for r in plain)


def test_sql_on_odd_conversations(spark):
    rows = random_rows(9)
    db = duckdb.connect()
    db.register("conversations", frame(spark, rows).toArrow())
    assert sorted(db.sql(ORACLE).fetchall()) == trie(rebuilt(conversations(rows)))


def test_repeats_ties_and_empty_tables(spark):
    rows = [(40, 1, "user", "b"), (40, 1, "user", "a"), (40, 1, "user", "a"), (60, 1, "user", "a"), (60, 1, "user", "b"), (60, 1, "user", "a")]
    a, b = frame(spark, rows), frame(spark, rows[::-1], 1)
    got = [sorted(tuple(r) for r in op11_prefix_trie(x).collect()) for x in (a, b)]
    assert got[0] == got[1] and max(r[1] for r in got[0]) == 3
    assert not op11_prefix_trie(a.limit(0)).collect() and not op11_prefix_trie(a.withColumn("conv_id", F.lit(None).cast("long"))).collect()


def test_one_long_conversation_is_cut(spark):
    """A conversation spread over all partitions, with a hot first turn."""
    rows = [(0, i, "user", str(i % 7)) for i in range(700)] + [(20 * i, 0, "user", "0") for i in range(1, 60)]
    df = frame(spark, rows)
    assert sorted(tuple(r) for r in op11_prefix_trie(df).collect()) == trie(rebuilt(conversations(rows)))


def test_running(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, 50]), i, rng.randrange(1 << 61)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, at long, v long").repartition(5)
    got = {(r.key, r.at): (r.place, r.v) for r in running(df, "key", ["at"], ["v"]).collect()}
    seen, total = {}, {}
    for k, at, v in sorted(rows):
        seen[k], total[k] = seen.get(k, 0) + 1, (total.get(k, 0) + v) & MASK
        assert got.pop((k, at)) == (seen[k], total[k])
    assert not got


def forest(kind, n, rng):
    if kind == "chain":
        parent = [None, *range(n - 1)]
    elif kind == "star":
        parent = [None] + [0] * (n - 1)
    elif kind == "trees":
        parent = [None if rng.random() < 0.05 else rng.randrange(i) if i else None for i in range(n)]
    else:
        parent = [None] + [max(0, i - rng.randint(1, 4)) for i in range(1, n)]
    name = rng.sample(range(10 * n), n)
    return name, [None if p is None else name[p] for p in parent]


def walked(name, parent, value):
    up, out = dict(zip(name, parent, strict=True)), dict.fromkeys(name, 0)
    for v, x in zip(name, value, strict=True):
        while v is not None:
            out[v] += x
            v = up[v]
    return out


def test_totals(spark):
    """Trees of all kinds in one forest; components of more than 30 nodes are
    taken apart as tables, the others in a task."""
    rng, rows = random.Random(4), []
    for k, kind in enumerate(("chain", "star", "trees", "deep")):
        name, parent = forest(kind, 120, rng)
        rows += [(v + 10_000 * k, None if p is None else p + 10_000 * k) for v, p in zip(name, parent, strict=True)]
    name, parent = zip(*rows, strict=True)
    a, b = [rng.randrange(-9, 9) for _ in name], [rng.randrange(1 << 40) for _ in name]
    df = spark.createDataFrame(list(zip(name, parent, a, b, strict=True)), "node long, parent long, a long, b long").repartition(3)
    want = {v: (x, y) for (v, x), y in zip(walked(name, parent, a).items(), walked(name, parent, b).values(), strict=True)}
    got = {r.node: (r.a, r.b) for r in subtree_totals(df, ["a", "b"], local_nodes=30, batch_nodes=1).collect()}
    assert got == want
    assert not subtree_totals(df.limit(0), ["a"]).collect()


@pytest.mark.parametrize("kind", ["chain", "star", "trees", "deep"])
def test_decompose(kind):
    rng = random.Random(kind)
    for n in (1, 2, 3, 40, 999):
        name, parent = forest(kind, n, rng)
        at = {v: i for i, v in enumerate(name)}
        up = np.array([i if p is None else at[p] for i, p in enumerate(parent)])
        top = up.copy()
        while (top[top] != top).any():
            top = top[top]
        value = np.array([[rng.randrange(100)] for _ in name])
        size = np.array(list(walked(name, parent, [1] * n).values()))
        got = decompose(up, top, size, value, np.zeros_like(value))
        assert got[:, 0].tolist() == list(walked(name, parent, value[:, 0].tolist()).values())
