"""Queries that go through storage: readers over declared tables, sinks read
back, and streams run over everything available. Feeds are the fixture views,
written under the shared folder first, because a stream reads files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope import schemas
from tenantscope.operators import audit, changes, checks, registry
from tenantscope.operators import text_vector as TV
from tenantscope.plans import oracle_sql as Q
from tenantscope.plans.catalog import QUERIES, _ip_requests, _removal_keys, query
from tenantscope.session import shared_path
from tenantscope.sources import control, sinks
from tenantscope.sources.fixtures import AS_OF, Fleet
from tenantscope.sources.versions import VersionedTables
from tenantscope.streaming import streams as ST

_UUID = "'00000000-0000-4000-8000-' || lpad(CAST(id AS VARCHAR), 12, '0')"


def _twin(name: str, batch: str):
    """Register a stream whose whole result is that of a batch query."""
    def deco(fn):
        QUERIES[name] = (fn, QUERIES[batch][1])
        return fn
    return deco


def _uuid(c: str):
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col(c).cast("string"), 12, "0"))


def _written(spark, df: DataFrame, name: str) -> str:
    path = shared_path(spark, "feed")
    df.write.parquet(f"{path}/{name}")
    return path


def _stream(spark, df: DataFrame) -> DataFrame:
    path = f"{_written(spark, df, 'rows')}/rows"
    return spark.readStream.schema(df.schema).parquet(path)


def _out(spark) -> tuple[str, str]:
    base = shared_path(spark, "stream")
    return f"{base}/out", f"{base}/checkpoint"


# --- readers and sinks -------------------------------------------------------
@query("control_scan", f"""
SELECT {_UUID} AS id, database_name, username, owner_email, friendly_name, max_connections, status,
  created_at, updated_at
FROM databases
""")
def q_control_scan(spark, d):
    """The stored registry with its UUID keys, by its declared schema."""
    path = _written(spark, Fleet(spark, d).databases.withColumn("id", _uuid("id")), "databases")
    return registry.list_databases(control.read_control(spark, path, "databases"))


@query("activity_snapshot", f"""
SELECT pid, datname, TIMESTAMP '{AS_OF}' AS snapshot_ts FROM activity
""")
def q_activity_snapshot(spark, d):
    return control.read_activity(spark, f"{_written(spark, Fleet(spark, d).activity, 'activity')}/activity", AS_OF)


@query("catalog_snapshot", f"""
SELECT datname, datistemplate, size_bytes, TIMESTAMP '{AS_OF}' AS snapshot_ts FROM db_catalog
""")
def q_catalog_snapshot(spark, d):
    return control.read_catalog(spark, f"{_written(spark, Fleet(spark, d).db_catalog, 'db_catalog')}/db_catalog", AS_OF)


@query("backup_restored", """
SELECT 'audit_logs' AS "table", COUNT(*) AS rows, CAST(SUM(id) AS BIGINT) AS ids FROM audit_logs
UNION ALL SELECT 'databases', COUNT(*), CAST(SUM(id) AS BIGINT) FROM databases
UNION ALL SELECT 'ip_whitelist', COUNT(*), CAST(SUM(id) AS BIGINT) FROM ip_whitelist
""")
def q_backup_restored(spark, d):
    """A dated backup, read back."""
    f = Fleet(spark, d)
    names = ["audit_logs", "databases", "ip_whitelist"]
    base = sinks.backup_snapshot({n: getattr(f, n) for n in names}, shared_path(spark, "backup"), AS_OF)
    parts = [spark.read.parquet(f"{base}/{n}").agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"),
                                                   F.sum("id").alias("ids")) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("listing_export", """
SELECT id, database_name, username, owner_email, friendly_name, max_connections, status FROM databases
""")
def q_listing_export(spark, d):
    """The listing as JSON lines, read back."""
    out = shared_path(spark, "export")
    listing = registry.list_databases(Fleet(spark, d).databases).drop("created_at", "updated_at")
    sinks.export_json(listing, out)
    return spark.read.schema(listing.schema).json(out)


# --- streams -----------------------------------------------------------------
@_twin("stream_audit_summary", "audit_summary_windows")
def q_stream_audit_summary(spark, d):
    out, ck = _out(spark)
    ST.run_complete_to(ST.audit_summary_windows(_stream(spark, Fleet(spark, d).audit_logs)), out, ck)
    return spark.read.parquet(out)


@_twin("stream_connection_rate", "connection_rate_windows")
def q_stream_connection_rate(spark, d):
    out, ck = _out(spark)
    ST.run_complete_to(ST.connection_rate(_stream(spark, Fleet(spark, d).conn_log)), out, ck)
    return spark.read.parquet(out)


@_twin("stream_client_sessions", "client_sessions")
def q_stream_client_sessions(spark, d):
    out, ck = _out(spark)
    ST.run_complete_to(ST.sessions(_stream(spark, Fleet(spark, d).conn_log)), out, ck)
    return spark.read.parquet(out)


@_twin("stream_ttl_hits", "cache_ttl_hits")
def q_stream_ttl_hits(spark, d):
    c = Fleet(spark, d).cache_requests
    out, ck = _out(spark)
    ST.run_available_to(ST.ttl_hits_stream(_stream(spark, c), ST.cache_fills(_stream(spark, c))), out, ck)
    return spark.read.parquet(out)


@_twin("stream_slow_statements", "slow_statements")
def q_stream_slow_statements(spark, d):
    feed = shared_path(spark, "log")
    Fleet(spark, d).server_log.write.text(feed)
    out, ck = _out(spark)
    ST.run_available_to(ST.slow_stream(spark, feed), out, ck)
    return spark.read.parquet(out)


@query("stream_dedupe", "SELECT DISTINCT database_id, client_ip FROM conn_log")
def q_stream_dedupe(spark, d):
    """Which connection of a client stays depends on arrival, so the query
    returns the clients; the delay covers the whole feed."""
    out, ck = _out(spark)
    ST.run_available_to(ST.dedupe_stream(_stream(spark, Fleet(spark, d).conn_log), ["database_id", "client_ip"],
                                         within="3650 days"), out, ck)
    return spark.read.parquet(out).select("database_id", "client_ip")


@query("stream_rules", f"""
WITH rules AS ({Q.ACCESS_RULES}),
heads AS (SELECT DISTINCT database_name FROM rules)
SELECT line FROM rules
UNION ALL SELECT '' FROM heads
UNION ALL SELECT '# Rules for ' || database_name FROM heads
""")
def q_stream_rules(spark, d):
    """The rule files that one batch of whitelist changes leaves."""
    f = Fleet(spark, d)
    out, ck = _out(spark)
    ST.rules_stream(_stream(spark, f.ip_whitelist), lambda: (f.databases, f.ip_whitelist), out, ck).awaitTermination()
    return spark.read.text(f"{out}/batch=0").withColumnRenamed("value", "line")


# --- append-mode windows: late rows dropped, open windows kept back ---------------
ARRIVALS = 3


def _slice(df: DataFrame, ts: str) -> DataFrame:
    """``df`` with ``_us`` (its time in microseconds) and ``_slice``, the third of
    the whole span that it lies in."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    b = df.agg(F.min(us).alias("lo"), (F.max(us) + 1).alias("hi")).first()
    lo, hi = (b["lo"], b["hi"]) if b["lo"] is not None else (0, 1)
    return df.withColumn("_us", us).withColumn("_slice", F.expr(f"({ARRIVALS} * (_us - {lo})) div {hi - lo}"))


def _closed(spark, df: DataFrame, ts: str, number: str, job) -> DataFrame:
    """A feed that comes in ``ARRIVALS`` lots, by time, but that every tenth row
    which is over three hours behind its lot comes with the next one. The stream
    is started for each lot and goes on from its checkpoint; the result is what
    it has appended in the end."""
    cut = _slice(df, ts)
    newest = cut.groupBy("_slice").agg(F.max("_us").alias("_newest"))
    late = (F.col(number) % 10 == 0) & (F.col("_slice") < ARRIVALS - 1) & (F.col("_us") < F.col("_newest") - 3 * 3_600_000_000)
    dealt = cut.join(newest, "_slice").withColumn("_lot", F.col("_slice") + F.when(late, 1).otherwise(0))
    feed, (out, ck) = shared_path(spark, "feed"), _out(spark)
    for lot in range(ARRIVALS):
        dealt.where(F.col("_lot") == lot).select(*df.columns).write.mode("append").parquet(feed)
        ST.run_available_to(job(spark.readStream.schema(df.schema).parquet(feed)), out, ck)
    return spark.read.parquet(out)


def _lots_sql(table: str, ts: str, number: str) -> str:
    """``ok``: the feed with ``wm``, the watermark before each row's lot (null:
    none yet), and ``final``, the watermark in the end (microseconds)."""
    return f"""
b AS (SELECT min(epoch_us({ts})) AS lo, max(epoch_us({ts})) + 1 AS hi FROM {table}),
s AS (SELECT t.*, epoch_us({ts}) AS us, ({ARRIVALS} * (epoch_us({ts}) - lo)) // (hi - lo) AS slice FROM {table} t, b),
n AS (SELECT *, max(us) OVER (PARTITION BY slice) AS newest FROM s),
a AS (SELECT *, slice + CASE WHEN {number} % 10 = 0 AND slice < {ARRIVALS - 1} AND us < newest - 3 * 3600000000 THEN 1 ELSE 0 END AS lot FROM n),
m AS (SELECT lot + 1 AS lot, max(max(us)) OVER (ORDER BY lot) // 1000 * 1000 - 3600000000 AS wm FROM a GROUP BY lot),
ok AS MATERIALIZED (SELECT a.*, m.wm, (SELECT max(wm) FROM m) AS final FROM a LEFT JOIN m USING (lot))"""


@query("stream_audit_summary_closed", f"""
WITH {_lots_sql('audit_logs', 'created_at', 'id')},
w AS (SELECT action, wm, final, us // 86400000000 * 86400000000 + 86400000000 AS ends FROM ok)
SELECT CAST(make_timestamp(ends - 86400000000) AS DATE) AS date, action, COUNT(*) AS count
FROM w WHERE (wm IS NULL OR ends > wm) AND ends <= final GROUP BY ends, action
""")
def q_stream_audit_summary_closed(spark, d):
    """R79 in append mode: closed days only, without the rows that came too late."""
    return _closed(spark, Fleet(spark, d).audit_logs, "created_at", "id", ST.audit_summary_windows)


@query("stream_connection_rate_closed", f"""
WITH {_lots_sql('conn_log', 'ts', 'conn_id')},
w AS (SELECT database_id, wm, final, unnest([us // 300000000 * 300000000 + 300000000, us // 300000000 * 300000000 + 600000000]) AS ends FROM ok)
SELECT make_timestamp(ends - 600000000) AS window_start, make_timestamp(ends) AS window_end, database_id, COUNT(*) AS connections
FROM w WHERE (wm IS NULL OR ends > wm) AND ends <= final GROUP BY ends, database_id
""")
def q_stream_connection_rate_closed(spark, d):
    """R80 in append mode."""
    return _closed(spark, Fleet(spark, d).conn_log, "ts", "conn_id", ST.connection_rate)


@query("stream_client_sessions_closed", f"""
WITH {_lots_sql('conn_log', 'ts', 'conn_id')},
k AS (SELECT database_id, us, final, lag(us) OVER (PARTITION BY database_id ORDER BY us) AS prev FROM ok WHERE wm IS NULL OR us + 1800000000 > wm),
i AS (SELECT *, SUM(CASE WHEN prev IS NULL OR us >= prev + 1800000000 THEN 1 ELSE 0 END) OVER (
        PARTITION BY database_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM k)
SELECT database_id, make_timestamp(MIN(us)) AS session_start, make_timestamp(MAX(us) + 1800000000) AS session_end, COUNT(*) AS events
FROM i GROUP BY database_id, sid, final HAVING MAX(us) + 1800000000 <= final
""")
def q_stream_client_sessions_closed(spark, d):
    """R81 in append mode."""
    return _closed(spark, Fleet(spark, d).conn_log, "ts", "conn_id", ST.sessions)


# --- change jobs that commit --------------------------------------------------------
def _store(spark, d: str) -> tuple[Fleet, VersionedTables]:
    """The control tables as version 1, the audit trail dealt by day."""
    f, store = Fleet(spark, d), VersionedTables(spark, shared_path(spark, "store"))
    names = ["databases", "ip_whitelist", "database_stats", "shadow_databases", "audit_logs"]
    store.commit("load", 0, {n: getattr(f, n) for n in names}, by_day={"audit_logs": "created_at"})
    return f, store


def _suspended(f: Fleet) -> DataFrame:
    return f.databases.where("status = 'suspended'").select("id")


@query("versioned_registry", f"""
SELECT id, database_name, username, owner_email, friendly_name, max_connections, status FROM databases
WHERE status IS DISTINCT FROM 'suspended'
UNION ALL
SELECT id, database_name, username, owner_email, friendly_name, max_connections, status FROM ({QUERIES['register_accepted'][1]})
""")
def q_versioned_registry(spark, d):
    """R49 and R25 committed one after the other; the newest version's registry."""
    f, store = _store(spark, d)
    changes.register_tenants(store, f.tenant_requests, AS_OF, "register")
    changes.remove_tenants(store, _suspended(f), AS_OF, "remove")
    return store.read("databases").select("id", "database_name", "username", "owner_email", "friendly_name", "max_connections", "status")


@query("versioned_whitelist", f"""
SELECT w.* FROM (SELECT * FROM ip_whitelist UNION ALL SELECT * FROM ({QUERIES['add_ips_added'][1]})) w
WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey AS id, o_custkey AS database_id FROM orders WHERE o_orderstatus = 'F') k
                  WHERE k.id = w.id AND k.database_id = w.database_id)
""")
def q_versioned_whitelist(spark, d):
    """R50 and R26 committed one after the other; the newest version's allow list."""
    f, store = _store(spark, d)
    changes.add_whitelist(store, _ip_requests(f), AS_OF, "add")
    changes.remove_whitelist(store, _removal_keys(f), AS_OF, "remove")
    return store.read("ip_whitelist")


@query("versioned_audit", f"""
SELECT action, resource_type, resource_id, details, created_at FROM audit_logs
UNION ALL SELECT action, resource_type, resource_id, details, created_at FROM ({QUERIES['register_audit'][1]})
UNION ALL SELECT action, resource_type, resource_id, details, created_at FROM ({QUERIES['cascade_delete_audit'][1]})
""")
def q_versioned_audit(spark, d):
    """The audit trail after both registry jobs."""
    f, store = _store(spark, d)
    changes.register_tenants(store, f.tenant_requests, AS_OF, "register")
    changes.remove_tenants(store, _suspended(f), AS_OF, "remove")
    return store.read("audit_logs").select("action", "resource_type", "resource_id", "details", "created_at")


def _cutoff() -> str:
    from datetime import datetime, timedelta

    from tenantscope.operators.audit import RETENTION_DAYS
    return str(datetime.fromisoformat(AS_OF) - timedelta(days=RETENTION_DAYS))


@_twin("retention_by_day", "retention_kept")
def q_retention_by_day(spark, d):
    """R18 on the trail dealt by day: old days go unread."""
    _, store = _store(spark, d)
    store.expire("retention", "audit_logs", _cutoff())
    return store.read("audit_logs")


@query("stream_rules_incremental", f"SELECT database_name, CAST(rule_no AS INT) AS rule_no, line FROM ({Q.ACCESS_RULES})")
def q_stream_rules_incremental(spark, d):
    """The allow list comes in two lots; the second refreshes the rules of
    its tenants only."""
    f = Fleet(spark, d)
    feed, (out, ck) = shared_path(spark, "feed"), _out(spark)
    schema = f.ip_whitelist.schema
    for lot in ("id % 50 <> 0", "id % 50 = 0"):
        f.ip_whitelist.where(lot).write.mode("append").parquet(feed)
        come = spark.read.schema(schema).parquet(feed)
        ST.rules_stream_incremental(spark.readStream.schema(schema).parquet(feed), lambda: (f.databases, come), out, ck).awaitTermination()  # noqa: B023
    return ST.read_rules(spark, out)


@_twin("key_permissions_variant", "key_permissions")
def q_key_permissions_variant(spark, d):
    return audit.key_permissions_variant(Fleet(spark, d).api_keys)[0]


@query("owner_groups_collated", """
SELECT min(v) AS owner_email, COUNT(*) AS n FROM (
  SELECT CASE WHEN id % 2 = 0 THEN upper(owner_email) ELSE owner_email END AS v FROM databases
  UNION ALL SELECT owner_email FROM databases) WHERE v IS NOT NULL GROUP BY lower(v)
""")
def q_owner_groups_collated(spark, d):
    """Owners of two listings that spell them in different cases."""
    t = Fleet(spark, d).databases
    other = t.select(F.when(F.col("id") % 2 == 0, F.upper("owner_email")).otherwise(F.col("owner_email")).alias("owner_email"))
    return TV.ci_group_collated(other.unionByName(t.select("owner_email")), "owner_email")


# --- checks on tables that break the rules --------------------------------------
@query("orphans_stats_of_active", """
SELECT s.* FROM database_stats s
WHERE s.database_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM databases d WHERE d.id = s.database_id AND d.status = 'active')
""")
def q_orphans_stats_of_active(spark, d):
    """R27 after suspended tenants were removed: their statistics are orphans."""
    f = Fleet(spark, d)
    return checks.orphans(f.database_stats, "database_id", f.databases.filter("status = 'active'"))


@query("orphans_audit_of_expired_keys", f"""
SELECT a.* FROM audit_logs a
WHERE a.api_key_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM api_keys k WHERE k.id = a.api_key_id AND NOT coalesce(k.expires_at < TIMESTAMP '{AS_OF}', false))
""")
def q_orphans_audit_of_expired_keys(spark, d):
    f = Fleet(spark, d)
    live = f.api_keys.filter(~F.coalesce(F.col("expires_at") < F.lit(AS_OF).cast("timestamp_ntz"), F.lit(False)))
    return checks.orphans(f.audit_logs, "api_key_id", live)


_DIRTY_SQL = """(SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE database_name END AS database_name,
  CASE WHEN id % 5 = 0 THEN repeat(username, 30) ELSE username END AS username,
  CASE WHEN id % 3 = 0 THEN NULL ELSE username END AS password_hash,
  CASE WHEN id % 11 = 0 THEN repeat(status, 9) ELSE status END AS status FROM databases)"""


def _violations(column: str, rule: str, test: str) -> str:
    return (f"SELECT 'databases' AS \"table\", '{column}' AS \"column\", '{rule}' AS rule, "
            f"CAST(count_if({column} {test}) AS BIGINT) AS violations FROM {_DIRTY_SQL}")


def _long(column: str, n: int) -> str:
    return (f"SELECT 'databases', '{column}', 'max_length_{n}', "
            f"CAST(count_if(length({column}) > {n}) AS BIGINT) FROM {_DIRTY_SQL}")


@query("column_violations_dirty", " UNION ALL ".join(
    [_violations(c, "not_null", "IS NULL") for c in ("id", "database_name", "username", "password_hash")]
    + [_long(c, n) for c, n in (("database_name", 255), ("username", 255), ("password_hash", 255), ("status", 50))]))
def q_column_violations_dirty(spark, d):
    t = Fleet(spark, d).databases
    k = t["id"]
    dirty = t.select("id", F.when(k % 7 != 0, t["database_name"]).alias("database_name"),
                     F.when(k % 5 == 0, F.repeat("username", F.lit(30))).otherwise(t["username"]).alias("username"),
                     F.when(k % 3 != 0, t["username"]).alias("password_hash"),
                     F.when(k % 11 == 0, F.repeat("status", F.lit(9))).otherwise(t["status"]).alias("status"))
    return checks.column_violations(dirty, "databases", schemas.NOT_NULL["databases"], schemas.VARCHAR_LIMITS["databases"])


@query("unique_registry_names", """
SELECT database_name, COUNT(*) AS rows FROM (
  SELECT database_name FROM databases UNION ALL SELECT database_name FROM databases WHERE id % 9 = 0
  UNION ALL SELECT NULL FROM databases WHERE id % 9 = 0)
WHERE database_name IS NOT NULL GROUP BY database_name HAVING COUNT(*) > 1
""")
def q_unique_registry_names(spark, d):
    names = Fleet(spark, d).databases.select("id", "database_name")
    again = names.filter(names["id"] % 9 == 0)
    return checks.unique_violations(names.unionByName(again).unionByName(
        again.withColumn("database_name", F.lit(None).cast("string"))), ["database_name"])


def near_queries(v: DataFrame) -> DataFrame:
    """Questions that resemble a cached one: every fifth vector, moved by 0.3 of
    its neighbour in id order."""
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return v.where("vec_id % 5 = 0").join(other, "vec_id") \
        .select(F.col("vec_id").alias("qid"), F.zip_with("embedding", "o", lambda x, y: x + y * 0.3).alias("embedding"))


def q_semantic_lookup_lsh(spark, d):
    """R70 with random-projection buckets; approximate, so without SQL (the test
    measures its recall)."""
    v = Fleet(spark, d).raw("embeddings")
    return TV.semantic_lookup_lsh(near_queries(v), v, 0.9)


QUERIES["semantic_lookup_lsh"] = (q_semantic_lookup_lsh, None)
