"""Operators on the declared schemas (UUID keys) and on inputs that real feeds
hold: missing numbers, repeated requests, broken lines, other pool headers,
vectors without a direction, NULL keys."""

import datetime as dt

from pyspark.sql import functions as F

from tenantscope.operators import access, audit, checks, registry, text_vector as TV, windows as W
from tenantscope.sources import control, logs
from tenantscope.streaming import streams as ST

AS_OF = "2024-04-15 00:00:00"
U = ["00000000-0000-4000-8000-00000000000" + c for c in "123"]
T0 = dt.datetime(2024, 1, 1)


def stored(spark, tmp_path, table, rows):
    schema = control.TABLE_SCHEMAS[table]
    spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).write.parquet(f"{tmp_path}/{table}")
    return control.read_control(spark, str(tmp_path), table)


def test_operators_run_on_the_declared_tables(spark, tmp_path):
    db = stored(spark, tmp_path, "databases", [
        {"id": U[0], "database_name": "tenant_a", "username": "user_a", "password_hash": "h", "status": "active", "created_at": T0},
        {"id": U[1], "database_name": "tenant_b", "username": "user_b", "password_hash": "h", "status": "suspended", "created_at": T0}])
    wl = stored(spark, tmp_path, "ip_whitelist", [
        {"id": 1, "database_id": U[0], "ip_address": "10.0.0.0/8", "added_at": T0}, {"id": 2, "database_id": U[1], "ip_address": "::1"}])
    stats = stored(spark, tmp_path, "database_stats", [
        {"id": i, "database_id": U[0], "size_bytes": 10 * i, "active_connections": i, "recorded_at": None if i == 1 else T0} for i in (1, 2, 3)])
    req = stored(spark, tmp_path, "tenant_requests", [
        {"friendly_name": "x", "owner_email": "x@e", "max_connections": None, "request_no": 1},
        {"friendly_name": "x", "owner_email": "x@e", "max_connections": None, "request_no": 1},
        {"friendly_name": "y", "owner_email": "y@e", "max_connections": 0, "request_no": None},
        {"friendly_name": "", "owner_email": "z@e", "max_connections": 3, "request_no": 4}])
    catalog = stored(spark, tmp_path, "db_catalog", [{"datname": "tenant_a", "datistemplate": False, "size_bytes": 5}])
    keys = stored(spark, tmp_path, "api_keys", [{"id": U[2], "key_hash": "k", "permissions": '{"databases": ["read"]}'}])
    logged = stored(spark, tmp_path, "audit_logs", [{"id": 1, "api_key_id": U[2], "action": "database_created", "resource_id": U[0], "created_at": T0}])

    out = registry.register(req, db, AS_OF)
    new = out["accepted"].collect()
    assert len(new) == 1 and len(new[0].id) == 36 and new[0].password_hash is None and new[0].max_connections == 20
    assert [r.resource_id for r in out["audit"].collect()] == [new[0].id]
    assert sorted(r.reason for r in out["rejected"].collect()) == [
        "duplicate_in_batch", registry.REQUIRED_MESSAGE, "request_no is required"]
    assert {(r.friendly_name, r.max_connections) for r in out["rejected"].collect()} == {("x", None), ("y", 0), ("", 3)}

    ask = spark.createDataFrame([(U[0], "1.2.3.4", "", 1), (U[0], "1.2.3.4", "b", 2), (U[0], "1.2.3.4", "c", 1), (U[0], "5.6.7.8", "", None),
                                 (U[2], "1.1.1.1", "", 3), (U[0], "10.0.0.0/8", "", 4), (U[0], "bad", "", 5), (None, None, None, 6)],
                                "database_id string, ip_address string, description string, request_no long")
    added = access.add_ips(ask, wl, db, AS_OF)
    assert [(r.id, r.ip_address) for r in added["added"].collect()] == [(3, "1.2.3.4")]
    assert sorted(r.reason for r in added["rejected"].collect()) == [
        "already_listed", "database_not_found", "duplicate_in_batch", "duplicate_in_batch", "invalid_ip", "invalid_ip", "request_no is required"]

    assert {r.id: r.prev_size for r in W.size_growth(stats).collect()} == {1: None, 2: 10, 3: 20}
    assert {r.id: r.window_rows for r in W.rolling_connections(stats, 2).collect()} == {1: 1, 2: 2, 3: 2}
    assert registry.active_databases(db, wl, catalog).count() == 1
    assert access.generate_rules(db, wl).count() == 3
    assert audit.audit_with_tenant(logged, db).first().database_name == "tenant_a"
    assert audit.audit_by_key(logged, keys).count() == 1
    assert checks.orphans(stats, "database_id", db).count() == 0

    gone = checks.cascade_delete({"databases": (db, "id"), "ip_whitelist": (wl, "database_id")}, db.filter("status = 'suspended'"), as_of=AS_OF)
    assert [(r.action, r.resource_id, r.details) for r in gone["audit"].collect()] == [
        ("database_deleted", U[1], '{"database_name":"tenant_b","username":"user_b"}')]
    removed = access.remove_ips(wl, spark.createDataFrame([(1, U[0])], "id long, database_id string"), AS_OF)
    assert [(r.action, r.details) for r in removed["audit"].collect()] == [("ip_whitelist_removed", '{"ip_address":"10.0.0.0/8"}')]


def test_broken_log_lines_go_to_bad(spark):
    ok = "2024-02-01 00:00:00 UTC [7]: [1-1] user=u,db=d,app=a,client=h "
    lines = [ok + "LOG:  duration: 12.5 ms  x", ok + "DEBUG1:  m", "2024-02-30" + ok[10:] + "LOG:  m", "garbage", "", None,
             ok.replace("[7]", "[99999999999999999999]") + "LOG:  m", ok + "LOG:  a\x1fb", ok.replace("00:00:00", "00:00:00.123") + "LOG:  m"]
    good, bad = logs.parse_server_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = good.collect()
    assert sorted(r.level for r in rows) == ["DEBUG1", "LOG", "LOG"] and {r.duration_ms for r in rows} == {12.5, None}
    assert {r.ts.microsecond for r in rows} == {0, 123000}
    assert sorted(map(str, (r._bad for r in bad.collect()))) == sorted(map(str, lines[2:8]))
    lines = ["2024-01-01T10:00:00.123Z GET /a/12", "2024-01-01T10:00:00Z GET /a", "notatime GET /y", "garbage", None, "2024-13-01T00:00:00.000Z GET /z"]
    good, bad = logs.parse_access_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.route for r in good.collect()) == ["/a", "/a/:id"] and bad.count() == 4


def test_pool_columns_follow_the_header(spark):
    lines = [(" database | user | cl_active | cl_waiting | cl_active_cancel_req | sv_active | sv_active_cancel | sv_idle | sv_used", "new"),
             ("----------+------", "new"), (" t1 | u1 | 5 | 1 | 9 | 2 | 8 | 3 | 4", "new"), ("(1 row)", "new"),
             (" database | user | cl_active | sv_used", "old"), (" t2 | u2 | 6 | x", "old"), (" t3 | u3 | 1 | 2 | 3 | 4 | 5", "none")]
    df = spark.createDataFrame(lines, "value string, host string")
    got = sorted(tuple(r) for r in control.parse_pools(df, table="host").collect())
    assert got == [("new", "t1", "u1", 5, 1, 2, 3, 4), ("none", "t3", "u3", 1, 2, 3, 4, 5), ("old", "t2", "u2", 6, None, None, None, None)]


def grams(text):
    return {p[i:i + 3] for w in text.split() for p in ["  " + w + " "] for i in range(len(p) - 2)}


def test_trigram_pairs_at_exactly_the_threshold(spark):
    """A similarity of exactly 0.8, at sizes where 0.8 in doubles rounds up."""
    letters = [chr(0x4E00 + i) for i in range(40)]  # one-letter words have two grams, two-letter words three
    pairs = [(" ".join(letters[:12]), " ".join(letters[:12] + ["mn", "op"])),
             (" ".join(letters[:14]), " ".join(letters[:16] + ["mn"])),
             (" ".join(letters[:30]), " ".join(letters[:36] + ["mn"]))]
    assert [(len(grams(a)), len(grams(b)), len(grams(a) & grams(b))) for a, b in pairs] == [(24, 30, 24), (28, 35, 28), (60, 75, 60)]
    for a, b in pairs:
        df = spark.createDataFrame([(1, a), (2, b)], "id long, text string")
        for method in ("probe", "prefix"):
            for t, n in ((0.8, 1), (0.81, 0)):
                assert TV.trigram_join(df, df, "id", "text", "id", "text", t, self_join=True, method=method).count() == n


def test_vectors_without_a_direction_are_no_match(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.6, 0.8])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid long, embedding array<float>")
    assert [(r.qid, r.vec_id) for r in TV.vector_topk(q, v, 5).orderBy("qid", "rank").collect()] == [(1, 1), (1, 4)]
    assert {r.qid: r.hit for r in TV.semantic_lookup(q, v, 0.9).collect()} == {1: True, 2: False}
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    got = TV.semantic_lookup(q.withColumn("ts", ts), v.withColumn("ts", ts), 0.9, ttl_seconds=60, q_ts="ts", c_ts="ts")
    assert {r.qid: (r.vec_id, r.hit) for r in got.collect()} == {1: (1, True), 2: (None, False)}


def test_kv_merge_right_side_wins(spark):
    df = spark.createDataFrame([(1, '{"source": "x", "k": "1"}'), (2, "{}"), (3, None)], "id long, details string")
    got = sorted((r.id, r.has_key, r.key, r.value) for r in TV.kv_ops(df, "id", "details", {"source": "audit"}, key="k").collect())
    assert got == [(1, True, "k", "1"), (1, True, "source", "audit"), (2, False, "source", "audit")]


def test_null_cache_keys_never_hit(spark):
    rows = [(None, 0), (None, 10), ("a", 0), ("a", 10), ("a", 5000), ("b", 7)]
    df = spark.createDataFrame(rows, "cache_key string, s int").withColumn("ts", F.timestamp_add("SECOND", "s", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    for splits in (1, 12):
        got = ST.ttl_hits(df, df.filter("s = 0").select("cache_key", "ts"), 3600, splits=splits)
        assert [(r.cache_key, r.s) for r in got.collect()] == [("a", 10)]
