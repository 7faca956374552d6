"""Streams over files (availableNow) against their batch twins; late rows,
restart from checkpoint; sinks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tenantscope.operators import access
from tenantscope.sources import logs, sinks
from tenantscope.streaming import streams as ST


def _files(df, path):
    df.write.mode("errorifexists").parquet(path)
    return path


def _rows(spark, name):
    return spark.sql(f"SELECT * FROM {name}")


def test_audit_stream_equals_batch_for_closed_windows(spark, fleet, tmp_path):
    audit = fleet.audit_logs
    src = _files(audit, str(tmp_path / "audit"))
    s = spark.readStream.schema(audit.schema).parquet(src)
    ST.run_available(ST.audit_summary_windows(s), "audit_days", str(tmp_path / "ck"))
    got = sorted(map(tuple, _rows(spark, "audit_days").collect()))
    mx = audit.agg(F.max("created_at")).first()[0]
    batch = ST.audit_summary_windows(audit).filter(
        F.date_add(F.col("date"), 1).cast("timestamp_ntz") <= F.lit(mx) - F.expr("INTERVAL 1 HOUR"))
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 0


def test_late_row_dropped_on_time_row_kept_and_restart(spark, tmp_path):
    schema = "id long, action string, c string"
    src = str(tmp_path / "src")

    def put(rows, part):
        spark.createDataFrame(rows, schema).withColumn("created_at", F.col("c").cast("timestamp_ntz")) \
            .drop("c").write.mode("append").parquet(src + f"/p={part}")
    put([(1, "x", "2024-01-02 10:00:00"), (2, "x", "2024-01-05 12:00:00")], 1)
    sch = spark.read.parquet(src).schema
    ck, out = str(tmp_path / "ck"), str(tmp_path / "out")

    def run():
        s = spark.readStream.schema(sch).parquet(src)
        ST.run_available_to(ST.audit_summary_windows(s), out, ck)
    run()
    put([(3, "x", "2024-01-03 09:00:00"), (4, "x", "2024-01-05 11:30:00")], 2)  # late, on time
    run()  # restart from the same checkpoint
    put([(5, "x", "2024-01-07 12:00:00")], 3)
    run()
    got = {str(r["date"]): r["count"] for r in spark.read.parquet(out).collect()}
    assert got.get("2024-01-02") == 1 and got.get("2024-01-05") == 2
    assert "2024-01-03" not in got


def test_ttl_stream_equals_batch(spark, fleet, tmp_path):
    c = fleet.cache_requests
    src = _files(c, str(tmp_path / "cache"))
    s = spark.readStream.schema(c.schema).parquet(src)
    out = ST.ttl_hits_stream(s, ST.cache_fills(s))
    ST.run_available(out, "ttl_hits", str(tmp_path / "ck"))
    got = sorted(r["request_id"] for r in _rows(spark, "ttl_hits").collect())
    want = sorted(r["request_id"] for r in ST.ttl_hits(c, ST.cache_fills(c)).collect())
    assert got == want


def test_rate_and_session_streams(spark, fleet, tmp_path):
    c = fleet.conn_log
    src = _files(c, str(tmp_path / "conn"))
    s = spark.readStream.schema(c.schema).parquet(src)
    ST.run_available(ST.connection_rate(s), "rates", str(tmp_path / "ck1"))
    ST.run_available(ST.sessions(s), "sess", str(tmp_path / "ck2"))
    mx = c.agg(F.max("ts")).first()[0]
    wm = F.lit(mx) - F.expr("INTERVAL 1 HOUR")
    rates = ST.connection_rate(c).filter(F.col("window_end") <= wm)
    sess = ST.sessions(c).filter(F.col("session_end") <= wm)
    assert sorted(map(tuple, _rows(spark, "rates").collect())) == sorted(map(tuple, rates.collect()))
    assert sorted(map(tuple, _rows(spark, "sess").collect())) == sorted(map(tuple, sess.collect()))


def test_slow_stream_and_dedupe(spark, fleet, tmp_path):
    log_dir = str(tmp_path / "log")
    fleet.server_log.write.text(log_dir)
    ST.run_available(ST.slow_stream(spark, log_dir), "slow", str(tmp_path / "ck1"))
    want = logs.parse_server_log(spark.read.text(log_dir))[0].filter("duration_ms >= 1000").count()
    assert _rows(spark, "slow").count() == want > 0
    c = fleet.cache_requests
    src = _files(c, str(tmp_path / "cache"))
    s = spark.readStream.schema(c.schema).parquet(src)
    ST.run_available(ST.dedupe_stream(s, ["cache_key"]), "dedup", str(tmp_path / "ck2"))
    d = _rows(spark, "dedup")
    assert d.count() == d.select("cache_key").distinct().count() == c.select("cache_key").distinct().count()


def test_rules_stream_rebuilds_rules(spark, fleet, tmp_path):
    wl_dir = _files(fleet.ip_whitelist, str(tmp_path / "wl"))
    changes = spark.readStream.schema(fleet.ip_whitelist.schema).parquet(wl_dir)
    out = str(tmp_path / "rules")
    q = ST.rules_stream(changes, lambda: (fleet.databases, spark.read.parquet(wl_dir)), out,
                        str(tmp_path / "ck"))
    q.awaitTermination()
    lines = spark.read.text(out + "/batch=0").count()
    want = access.rules_text(access.generate_rules(fleet.databases, fleet.ip_whitelist)).count()
    assert lines == want > 0


def test_write_rules_in_file_order(spark, fleet, tmp_path):
    rules = access.generate_rules(fleet.databases, fleet.ip_whitelist)
    out = str(tmp_path / "hba")
    sinks.write_rules(rules, out, num_files=4)
    lines = []
    for f in sorted(glob.glob(os.path.join(out, "part-*"))):
        lines += open(f).read().splitlines()
    want = [r["line"] for r in access.rules_text(rules).orderBy("database_name", "rule_no").collect()]
    assert lines == want
    with pytest.raises(Exception):
        sinks.write_rules(rules, out)


def test_export_json_and_backup(spark, fleet, tmp_path):
    n = sinks.export_json(fleet.databases, str(tmp_path / "json"))
    assert n == fleet.databases.count() == spark.read.json(str(tmp_path / "json")).count()
    base = sinks.backup_snapshot({"databases": fleet.databases, "ip_whitelist": fleet.ip_whitelist},
                                 str(tmp_path / "bk"), "2024-04-15 00:00:00")
    assert base.endswith("20240415_000000")
    assert spark.read.parquet(base + "/ip_whitelist").count() == fleet.ip_whitelist.count()
    assert glob.glob(base + "/databases/*.gz.parquet")
    with pytest.raises(Exception):
        sinks.backup_snapshot({"databases": fleet.databases}, str(tmp_path / "bk"), "2024-04-15 00:00:00")


def test_text_readers(spark, tmp_path):
    p = tmp_path / "access.log"
    p.write_text("2024-01-01T10:00:00.123Z GET /api/databases\n"
                 "2024-01-01T10:00:01.000Z DELETE /api/databases/1a2b3c4d-0000-1111-2222-333344445555/whitelist/42\n"
                 "garbage\n")
    good, bad = logs.read_access_log(spark, str(p))
    assert [x["_bad"] for x in bad.collect()] == ["garbage"]
    r = [(x["method"], x["route"]) for x in good.collect()]
    assert r == [("GET", "/api/databases"), ("DELETE", "/api/databases/:id/whitelist/:id")]
    info = tmp_path / "info"
    info.mkdir()
    (info / "cache-a.txt").write_text("# Stats\nkeyspace_hits:80\nkeyspace_misses:20\nfoo:1\n")
    row = logs.read_cache_info(spark, str(info)).first()
    assert (row["host"], row["keyspace_hits"], row["keyspace_misses"]) == ("cache-a", 80.0, 20.0)
    pools = tmp_path / "pools.txt"
    pools.write_text(" database        | user     | cl_active | cl_waiting | sv_active | sv_idle | sv_used\n"
                     "-----------------+----------+-----------+------------+-----------+---------+---------\n"
                     " tenant_abc123   | user_abc | 5         | 0          | 2         | 3       | 5\n"
                     " postgres_control| api_user | 2         | 0          | 1         | 1       | 2\n"
                     "(2 rows)\n")
    from tenantscope.sources import control
    got = [tuple(x) for x in control.read_pools(spark, str(pools)).collect()]
    assert got == [("tenant_abc123", "user_abc", 5, 0, 2, 3, 5), ("postgres_control", "api_user", 2, 0, 1, 1, 2)]
    good, bad = logs.parse_server_log(spark.createDataFrame(
        [("2024-01-01 00:00:07 UTC [12]: [1-1] user=u,db=d,app=psql,client=10.0.0.1 LOG:  duration: 1500.000 ms  statement: SELECT 1",),
         ("not a log line",)], "value string"))
    g = good.first()
    assert (g["pid"], g["db"], g["level"], g["duration_ms"]) == (12, "d", "LOG", 1500.0)
    assert bad.count() == 1


def test_append_windows_drop_late_rows_and_evict_state(spark, tmp_path):
    """A second start of the stream: the row that lies behind the watermark is
    dropped, closed days leave the state, open ones are not yet appended."""
    days = lambda *ts: spark.createDataFrame([(t, "a") for t in ts], "created_at string, action string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    feed, out, ck = (str(tmp_path / n) for n in ("feed", "out", "ck"))
    lots = [days("2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-03 10:00:00"),
            days("2024-01-01 11:00:00", "2024-01-03 11:00:00", "2024-01-05 10:00:00")]
    dropped, held = [], []
    for lot in lots:
        lot.coalesce(1).write.mode("append").parquet(feed)
        q = ST.run_available_to(ST.audit_summary_windows(spark.readStream.schema(lot.schema).parquet(feed)), out, ck)
        ops = [o for p in q.recentProgress for o in p["stateOperators"]]
        dropped.append(sum(o["numRowsDroppedByWatermark"] for o in ops))
        held.append(ops[-1]["numRowsTotal"])
    got = sorted((str(r.date), r["count"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 2)]
    assert dropped == [0, 1] and held == [1, 1]
