"""Skew-safe windows against plain windows; text and vector jobs against
brute force on small fixtures."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL, plan_text
from tenantscope.operators import ranking, text_vector as TV, windows as W


def _skewed_stats(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        tenant = 1 if i % 3 else rnd.randint(2, 6)  # tenant 1 holds two thirds
        day = rnd.randint(0, 20)
        rows.append((i, tenant, rnd.randint(0, 10 ** 6), rnd.randint(0, 50), day, i % 4))
    return (spark.createDataFrame(rows, "total_queries long, database_id long, size_bytes long, "
                                        "active_connections int, d int, seq int")
            .withColumn("recorded_at", F.timestamp_add("DAY", F.col("d"),
                                                       F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
            .drop("d"))


def test_row_number_within_equals_plain(spark):
    df = _skewed_stats(spark)
    want = df.withColumn("rn", F.row_number().over(
        Window.partitionBy("database_id").orderBy("total_queries")))
    for width in (1, 16, 10 ** 6):
        got = ranking.row_number_within(df, ["database_id"], "total_queries", out="rn", chunk_width=width, total="n")
        assert sorted(map(tuple, got.select("total_queries", "rn").collect())) == \
            sorted(map(tuple, want.select("total_queries", "rn").collect())), width
        sizes = {r[0]: r[1] for r in df.groupBy("database_id").count().collect()}
        assert {(r["database_id"], r["n"]) for r in got.collect()} == set(sizes.items())


@pytest.mark.parametrize("descending", [False, True])
def test_row_number_keeps_null_keys_and_groups(spark, descending):
    df = spark.createDataFrame([("a", None), ("a", 5), ("a", 9), (None, 1), (None, None), ("b", 70000), ("b", 3)], "g string, k long")
    order = F.col("k").desc() if descending else F.col("k")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(order)))
    for width in (1, 4, 1 << 16):
        got = ranking.row_number_within(df, ["g"], "k", chunk_width=width, descending=descending)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_size_growth_and_rolling_equal_plain_windows(spark):
    df = _skewed_stats(spark)
    order = W.STATS_ORDER
    w = Window.partitionBy("database_id").orderBy(*order)
    plain = df.select("total_queries", F.lag("size_bytes").over(w).alias("prev_size"),
                      F.round(F.avg("active_connections").over(w.rowsBetween(-6, 0)), 4).alias("ra"),
                      F.max("active_connections").over(w.rowsBetween(-6, 0)).alias("rm"))
    want = {r[0]: tuple(r[1:]) for r in plain.collect()}
    for chunk in (None, F.date_trunc("MONTH", F.col("recorded_at")), F.lit(0)):
        g = {r["total_queries"]: r["prev_size"] for r in W.size_growth(df, chunk=chunk).collect()}
        rc = {r["total_queries"]: (r["rolling_avg"], r["rolling_max"])
              for r in W.rolling_connections(df, chunk=chunk).collect()}
        assert g == {k: v[0] for k, v in want.items()}
        assert rc == {k: (v[1], v[2]) for k, v in want.items()}


def test_windows_of_small_and_large_tenants(spark, monkeypatch):
    """A small tenant's years are its chunks: a year of daily samples leaves
    one tail, not one a day. Large tenants, a null one too, are cut by the hour."""
    df = _skewed_stats(spark)
    df = df.unionByName(df.where("database_id = 1").withColumn("database_id", F.lit(None).cast("long")))
    w = Window.partitionBy("database_id").orderBy(*W.STATS_ORDER)
    want = {tuple(r) for r in df.select("database_id", "total_queries", F.lag("size_bytes").over(w)).collect()}
    for rows in (0, 300, 1 << 18):
        monkeypatch.setattr(W, "TENANT_ROWS", rows)
        large = {r[0] for r in df.where(W._large(df, "database_id")).select("database_id").distinct().collect()}
        assert large == {0: {None, 1, 2, 3, 4, 5, 6}, 300: {None, 1}, 1 << 18: set()}[rows]
        got = {tuple(r) for r in W.size_growth(df).select("database_id", "total_queries", "prev_size").collect()}
        assert got == want, rows


def test_windows_take_null_times_tenants_and_values(spark):
    rows = [(1, 7, 10, 5, None), (2, 7, 20, None, "2024-01-01 00:00:00"), (3, 7, None, 8, "2024-01-01 00:00:00"),
            (4, 7, 50, 1, "2024-01-01 05:30:00"), (5, None, 1, 2, None), (6, None, 2, 4, "2024-03-01 00:00:00"), (7, 7, 60, None, None)]
    df = spark.createDataFrame([(*r[:4], 0, r[4]) for r in rows], "total_queries long, database_id long, size_bytes long, "
                               "active_connections int, seq int, at string").withColumn("recorded_at", F.col("at").cast("timestamp_ntz")).drop("at")
    w = Window.partitionBy("database_id").orderBy(*W.STATS_ORDER)
    want = {r[0]: tuple(r[1:]) for r in df.select(
        "total_queries", F.lag("size_bytes").over(w), F.round(F.avg("active_connections").over(w.rowsBetween(-2, 0)), 4),
        F.max("active_connections").over(w.rowsBetween(-2, 0)), F.count("*").over(w.rowsBetween(-2, 0))).collect()}
    grown = {r["total_queries"]: r["prev_size"] for r in W.size_growth(df).collect()}
    rolled = {r["total_queries"]: (r["rolling_avg"], r["rolling_max"], r["window_rows"]) for r in W.rolling_connections(df, rows=3).collect()}
    assert grown == {k: v[0] for k, v in want.items()} and rolled == {k: v[1:] for k, v in want.items()}


def test_windows_and_rules_scan_their_input_at_most_twice(spark):
    q = E.queries()
    for name, most in (("access_rules", 4), ("admit_intended", 10)):
        assert plan_text(q[name](spark, SF_SMALL)).count("FileScan") <= most, name
    # Both levels of chunk tails read one exchange: only the plan that ran shows it.
    for name in ("size_growth", "rolling_connections"):
        df = q[name](spark, SF_SMALL)
        df.collect()
        ran = plan_text(df).partition("== Initial Plan ==")[0]
        assert "isFinalPlan=true" in ran and ran.count("FileScan") <= 2 and ran.count("ReusedExchange") == 1, name


def test_no_window_holds_a_whole_tenant(spark):
    """One tenant with a row an hour for 300 days: chunks meet by month, months
    by tenant."""
    n = 7200
    df = spark.range(n).select((F.col("id") % 1).alias("database_id"), F.timestamp_add("HOUR", F.col("id"), F.lit("2023-01-01").cast("timestamp_ntz")).alias("recorded_at"),
                               F.col("id").alias("seq"), F.col("id").alias("total_queries"), (F.col("id") * 10).alias("size_bytes"))
    df = df.withColumn("recorded_at", F.col("recorded_at") + F.expr("INTERVAL 7 MINUTES"))
    out = W.size_growth(df)
    rows = {r.seq: r.prev_size for r in out.collect()}
    assert rows == {i: (i - 1) * 10 if i else None for i in range(n)}
    ran = plan_text(out).partition("== Initial Plan ==")[0]
    # partition and order of each window that ran
    keys = re.findall(r"\], \[([^\]]*)\], \[([^\]]*)\]", "".join(x for x in ran.splitlines() if " Window [" in x))
    assert [k for k in keys if k[0].count("#") == 1 and k[1].startswith("_m#")] and not [k for k in keys if k[0].count("#") == 1 and k[1].startswith("_c#")]


def _py_trigrams(text):
    import regex
    out = set()
    for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()):
        if w:
            p = "  " + w + " "
            out.update(p[i:i + 3] for i in range(len(p) - 2))
    return out


def test_trigram_join_equals_brute_force(spark):
    texts = ["the quick brown fox", "the quick brown fax", "a lazy dog sleeps", "lazy dogs sleep",
             "Quick brown foxes", "zebra", "zebras", "", "the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    g = [_py_trigrams(x) for x in texts]
    for t in (0.1, 0.2, 0.5, 0.8, 1.0):
        for self_join in (True, False):
            want = {}
            for i in range(len(texts)):
                for j in range(len(texts)):
                    if (j > i or not self_join) and g[i] and g[j]:
                        s = len(g[i] & g[j]) / len(g[i] | g[j])
                        if s >= t:
                            want[(i, j)] = round(s, 6)
            for method in ("probe", "prefix"):
                got = {(r["a_id"], r["b_id"]): r["similarity"] for r in TV.trigram_join(
                    df, df, "id", "text", "id", "text", t, self_join=self_join, method=method).collect()}
                assert got == want, (t, self_join, method)


@pytest.mark.parametrize("t", [0.1, 0.6, 1.0])
def test_trigram_blocks_lose_and_repeat_no_pair(spark, monkeypatch, t):
    """Many small blocks, several rounds of columns, one gram in every text,
    words outside the basic plane, and texts without words."""
    monkeypatch.setattr(TV, "BLOCK_RECORDS", 8)
    monkeypatch.setattr(TV, "BLOCK_COLUMNS", 5)
    monkeypatch.setattr(TV, "GRAM_ROWS", 4)
    monkeypatch.setattr(TV, "GRAM_CELLS", 16)
    rnd = random.Random(2)
    pool = ["the", "quick", "Äpfel", "\U00010400\U00010428x", "zebra", "fox", "lazy", "dog9", "数据库"]
    texts = ["the " + " ".join(rnd.choices(pool, k=rnd.randint(0, 7))) for _ in range(40)] + [None, "", "!?"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    g = [_py_trigrams(x or "") for x in texts]
    want = {(i, j): len(g[i] & g[j]) for i in range(len(g)) for j in range(len(g))
            if g[i] and g[j] and len(g[i] & g[j]) / len(g[i] | g[j]) >= t - 1e-12}
    one = TV.trigram_join(df, df, "id", "text", "id", "text", t, self_join=True).collect()
    assert sorted((r.a_id, r.b_id, r.shared, r.a_grams, r.b_grams) for r in one) == \
        sorted((i, j, n, len(g[i]), len(g[j])) for (i, j), n in want.items() if i < j)
    two = TV.trigram_join(df, df, "id", "text", "id", "text", t).collect()
    assert sorted((r.a_id, r.b_id, r.shared) for r in two) == sorted((*k, n) for k, n in want.items())


def test_trigram_join_makes_no_row_per_shared_gram(spark):
    df = spark.createDataFrame([(i, f"the same words again {i}") for i in range(30)], "id long, text string")
    for method in ("probe", "prefix"):
        p = plan_text(TV.trigram_join(df, df, "id", "text", "id", "text", 0.4, method=method))
        assert "CoGroups" in p and "inline" not in p, method


def test_trigram_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([(1, "abc def"), (2, "abc deg")], "id long, text string")
    p = plan_text(TV.trigram_join(df, df, "id", "text", "id", "text", 0.3, self_join=True))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_vector_topk_equals_numpy(spark, fleet):
    emb = fleet.raw("embeddings")
    q = TV.centroids(emb, "label").withColumnRenamed("label", "qid")
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in TV.vector_topk(q, emb, k=3, blocks=4).collect()}
    rows = emb.collect()
    ids = np.array([r["vec_id"] for r in rows])
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    for r in q.collect():
        c = np.array(r["embedding"])
        s = m @ c / (np.linalg.norm(m, axis=1) * np.linalg.norm(c))
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:3]
        assert [got[(r["qid"], k + 1)] for k in range(3)] == [int(ids[i]) for i in order]
    assert "NestedLoopJoin" not in plan_text(TV.vector_topk(q, emb, k=3))


def test_semantic_lookup_ttl(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "2024-01-01 10:00:00"), (2, [0.0, 1.0], "2024-01-01 10:00:00")],
                              "qid long, embedding array<float>, t string") \
        .withColumn("ts", F.col("t").cast("timestamp_ntz"))
    cache = spark.createDataFrame([(10, [1.0, 0.1], "2024-01-01 09:30:00"), (11, [0.0, 1.0], "2024-01-01 08:00:00"),
                                   (12, [0.1, 1.0], "2024-01-01 09:59:00")],
                                  "vec_id long, embedding array<float>, t string") \
        .withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r["qid"]: (r["vec_id"], r["hit"]) for r in
           TV.semantic_lookup(q, cache, 0.9, ttl_seconds=3600, q_ts="ts", c_ts="ts").collect()}
    assert got == {1: (10, True), 2: (12, True)}  # 11 is nearer for q2 but expired


def test_path_rollup_and_kv(spark):
    pages = spark.createDataFrame([("https://a.example.com/en/1",), ("http://b.example.com/en/2?x=1",),
                                   ("https://c.example.com/",)], "url string")
    got = {(r["prefix"], r["depth"]): r["records"] for r in TV.path_rollup(pages, "url").collect()}
    assert got == {("/", 0): 3, ("/en", 1): 2, ("/en/1", 2): 1, ("/en/2", 2): 1}
    kv = spark.createDataFrame([(1, '{"k": 5, "z": "a"}')], "id long, details string")
    rows = sorted((r["key"], r["value"], r["has_key"]) for r in
                  TV.kv_ops(kv, "id", "details", {"source": "audit"}, key="k").collect())
    assert rows == [("k", "5", True), ("source", "audit", True), ("z", "a", True)]


def test_ci_join_collation(spark):
    a = spark.createDataFrame([("Café",)], "n string")
    b = spark.createDataFrame([("CAFÉ",), ("cafe",)], "m string")
    assert TV.ci_join(a, b, "n", "m").count() == 1


def test_chat_history(spark, fleet):
    conv = fleet.raw("conversations")
    last = W.chat_history(conv, 2)
    per = {r["conv_id"]: r["n"] for r in last.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    tot = {r["conv_id"]: r["n"] for r in conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per == {k: min(2, v) for k, v in tot.items()}
    arr = W.chat_history_arrays(conv, 2).first()["history"]
    assert [x["turn"] for x in arr] == sorted(x["turn"] for x in arr)
    assert math.isfinite(len(arr))


def _shuffled(plan):
    """Bytes of the rows that the exchanges of a plan that ran have dealt out."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _shuffled(plan.executedPlan())
    if "QueryStage" in name:
        return _shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if name == "Exchange" else 0
    return own + sum(_shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def test_trigram_self_join_copies_little(spark):
    """Every record is like every other in size, so that all blocks meet."""
    rnd = random.Random(5)
    pool = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(400)]
    rows = [(i, " ".join(rnd.sample(pool, 60))) for i in range(9000)] + [(9000 + i, " ".join(pool[:60])) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    out = TV.trigram_join(df, df, "id", "text", "id", "text", 0.8, self_join=True)
    assert {(9000, 9001), (9000, 9002), (9001, 9002)} <= {(r.a_id, r.b_id) for r in out.collect()}
    sets = TV._gram_sets(df, "id", "text").agg({"_n": "sum"}).first()[0]
    assert _shuffled(out._jdf.queryExecution().executedPlan()) < 20 * sets, sets


def test_trigram_blocks_do_not_depend_on_the_order_of_rows(spark):
    """A block that meets itself is packed twice, from rows in any order."""
    df = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(60)], "id long, text string").coalesce(1)
    sets = TV._gram_sets(df, "id", "text")
    one, two = ([(r["_block"], r["ids"], bytes(r["bits"]), bytes(r["rows"])) for r in TV._blocks(t, False).packed.orderBy("_block").collect()]
                for t in (sets.sort("_id"), sets.sort(F.desc("_id"))))
    assert one == two and one[0][1] == sorted(one[0][1])
