"""LSH lookup, rule refresh by bucket, collated keys, VARIANT permissions and
the prefix tree of row numbers."""

import glob
import os

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL, plan_text
from pyspark.sql import functions as F
from tenantscope.operators import access, audit, ranking
from tenantscope.operators import text_vector as TV
from tenantscope.plans.roundtrips import near_queries
from tenantscope.sources.fixtures import Fleet
from tenantscope.streaming import streams as ST


@pytest.mark.parametrize("chunk", [1 << 28, 1 << 34])
def test_row_numbers_of_sparse_ids(spark, chunk, monkeypatch):
    """Ids so far apart that every row is a chunk of its own."""
    monkeypatch.setattr(ranking, "FAN", 8)
    ids = [i * i * 7919 + (i % 3) * (1 << 30) for i in range(300)]
    rows = [("hot" if k % 3 else f"g{k % 4}", i) for k, i in enumerate(ids)] + [("hot", None), (None, 5), (None, 1 << 40)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(5)
    for down in (False, True):
        got = ranking.row_number_within(df, ["g"], "id", chunk_width=chunk, descending=down, total="n")
        groups = {}
        for g, i in rows:
            groups.setdefault(g, []).append(i)
        want = set()
        for g, xs in groups.items():
            xs.sort(key=lambda i: (i is not None, i or 0), reverse=down)
            want |= {(g, i, n + 1, len(xs)) for n, i in enumerate(xs)}
        assert {tuple(r) for r in got.select("g", "id", "rn", "n").collect()} == want


def test_no_window_of_the_tree_holds_more_than_its_fan(spark):
    sizes = spark.range(100_000).select(F.struct(F.lit("t").alias("t")).alias("_g"),
                                        F.struct(F.lit(1).alias("n"), (F.col("id") * 1000).alias("c")).alias("_c"), F.lit(1).alias("_n"))
    levels = ranking._levels(100_000_000)
    assert levels == 2
    got = ranking._offsets(sizes, levels)
    assert got.where("_off <> _c.c div 1000 or _total <> 100000").isEmpty() and got.count() == 100_000
    # Only the top of the tree is a window of the whole group.
    assert sizes.select(F.floor(F.col("_c.c") / ranking.FAN ** levels)).distinct().count() <= ranking.FAN


def test_lsh_finds_what_the_exact_lookup_finds(spark, capsys):
    v = Fleet(spark, SF_MID).raw("embeddings")
    q = near_queries(v)
    exact = {r.qid: r for r in TV.semantic_lookup(q, v, 0.9).collect() if r.hit}
    got = {r.qid: r for r in TV.semantic_lookup_lsh(q, v, 0.9).collect()}
    assert len(got) == q.count() and len(exact) > 50
    same = [k for k, r in exact.items() if got[k].vec_id == r.vec_id]
    assert all(abs(got[k].score - exact[k].score) < 1e-12 for k in same)
    assert all(exact[k].vec_id is not None for k, r in got.items() if r.hit)  # never a hit that is none
    recall, share = len(same) / len(exact), _scored(q, v) / (q.count() * v.count())
    with capsys.disabled():
        print(f"\nLSH lookup: recall {recall:.3f}, pairs scored {share:.3f} of all")
    assert recall >= 0.9 and share < 0.6


def _scored(q, v) -> int:
    """Pairs that share a bucket: all that the join computes a distance for."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    unit = lambda t, i: t.select(F.col(i).alias("i"), F.col("embedding").alias("x")).withColumn("n", TV.norm(F.col("x"))) \
        .withColumn("features", array_to_vector(F.transform("x", lambda x: x.cast("double") / F.col("n"))))
    a, b = unit(q, "qid"), unit(v, "vec_id")
    m = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=0.25 / 8, numHashTables=8, seed=7).fit(b)
    return m.approxSimilarityJoin(a, b, 9.0, "d").count()


def test_lsh_buckets_stay_small_as_entries_grow(spark):
    share = []
    for n in (500, 50_000, 5_000_000):
        bits, tables = TV.lsh_shape(n, 0.9, 0.95)
        same = 1 - np.arccos(0.9) / np.pi
        assert 1 - (1 - same ** bits) ** tables >= 0.95
        share.append(tables / 2 ** bits)
    assert share[0] < 0.3 and share[1] < 0.01 and share[2] < 0.0005
    assert all(TV.lsh_shape(10 ** 9, t, 0.95)[1] <= TV.LSH_TABLES for t in (-1.0, 0.0, 0.5, 1.0))
    v = Fleet(spark, SF_MID).raw("embeddings")
    q = near_queries(v)
    assert TV.lsh_pairs(q, v, 0.9).count() < 0.3 * q.count() * v.count()
    # Copies are hashed and scored once; the smallest id stands for them.
    more = v.unionByName(v.withColumn("vec_id", F.col("vec_id") + 10_000))
    assert TV.lsh_pairs(q, more, 0.9).count() == TV.lsh_pairs(q, v, 0.9).count()


def test_lsh_odd_rows(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 2.0])], "qid long, embedding array<double>")
    v = spark.createDataFrame([(7, [5.0, 0.0]), (6, [1.0, 0.0]), (8, None), (9, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.qid: (r.vec_id, r.score, r.hit) for r in TV.semantic_lookup_lsh(q, v, 0.9).collect()}
    assert got == {1: (6, 1.0, True), 2: (None, None, False), 3: (None, None, False), 4: (None, None, False)}
    assert not any(r.hit for r in TV.semantic_lookup_lsh(q, v.limit(0), 0.9).collect())


def test_refresh_touches_the_changed_tenants_only(spark, tmp_path):
    f, out = Fleet(spark, SF_SMALL), str(tmp_path / "rules")
    db, wl = f.databases, f.ip_whitelist
    rules = lambda w: sorted(tuple(r) for r in access.generate_rules(db, w).select("database_name", "rule_no", "line").collect())
    ST.refresh_rules(db, wl, wl.select("database_id"), out, 16)
    stored = lambda: sorted(tuple(r) for r in ST.read_rules(spark, out).collect())
    assert stored() == rules(wl)
    stamp = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/bucket=*/*.parquet")}
    before = stamp()
    tenant = access.generate_rules(db, wl).select("database_name").first()[0]
    gone = db.where(F.col("database_name") == tenant).select(F.col("id").alias("database_id"))
    less = wl.join(gone, "database_id", "left_anti").select(*wl.columns)
    ST.refresh_rules(db, less, gone, out, 16)
    assert stored() == rules(less) != rules(wl)
    after = stamp()
    changed = {os.path.dirname(p) for p in before.keys() ^ after.keys()}
    assert len(changed) == 1 and all(after[p] == t for p, t in before.items() if os.path.dirname(p) not in changed)
    # A bucket that loses its last rule is emptied.
    ST.refresh_rules(db, wl.limit(0), wl.select("database_id"), out, 16)
    assert stored() == []


def test_collated_keys_group_beyond_ascii(spark):
    df = spark.createDataFrame([("École",), ("ÉCOLE",), ("école",), ("Ecole",), (None,)], "w string")
    assert sorted(tuple(r) for r in TV.ci_group_collated(df, "w").collect()) == [("Ecole", 1), ("École".upper(), 3)]


def test_permissions_are_parsed_once(spark):
    keys = spark.createDataFrame([(1, "a", '{"databases": ["read", "create"], "x": [1]}'), (2, "b", "no json"), (3, "c", None),
                                  (4, "d", '{"databases": "read"}'), (5, "e", '{"databases": [1, "delete"]}')], "id long, name string, permissions string")
    good, bad = audit.key_permissions_variant(keys)
    flags = {r.id: (r.can_create, r.can_read, r.can_update, r.can_delete) for r in good.collect()}
    assert flags[1] == (True, True, False, False) and flags[2] == flags[3] == (False,) * 4
    assert [r.id for r in bad.collect()] == [2]
    assert plan_text(good).lower().count("parse_json") + plan_text(good).lower().count("parsejson") <= 2 and len(flags) == 5
