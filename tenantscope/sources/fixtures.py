"""Fixture views: the control tables and feeds derived from the driver's
TPC-H-like parquet tables, so Spark and the SQL oracle see the same rows.

Each function reads only the driver tables it needs; Catalyst prunes the
scan to the referenced columns and pushes the filters into parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TS = "2024-01-01 00:00:00"
# Fixed clock of the test data (the reference calls NOW()).
AS_OF = "2024-04-15 00:00:00"


# Tables whose rows carry whole texts (their jobs do heavy per-row work,
# tokenising, trigrams, regexes, before the first shuffle), with their
# unique keys. Spreading on a unique key never gathers a group (e.g. one
# conversation) into one task.
TEXT_TABLES = {"documents": ["doc_id"], "pages": ["page_id"],
               "conversations": ["conv_id", "turn"], "benchmark": ["item_id"]}


# Job setting: into how many partitions text tables are dealt when read.
SPREAD = "spark.tenantscope.text.partitions"


def table(spark: SparkSession, sf_dir: str, name: str, spread_on: list[str] | None = None) -> DataFrame:
    """Read one driver table.

    A text table stored as one small file scans as one task, so its per-row
    text work would use one core until the first shuffle. A job on such files
    sets ``SPREAD``, and text tables (and tables read with ``spread_on``) are
    hash-dealt on their unique key over that many partitions. Without the
    setting, as on a cluster with many files, all tables are read as they
    are stored. Filters and column pruning reach the scan either way."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    keys = spread_on or TEXT_TABLES.get(name)
    n = spark.conf.get(SPREAD, None)
    return df.repartition(int(n), *keys) if keys and n else df


def _pad8(c: Column) -> Column:
    return F.lpad(c.cast("string"), 8, "0")


def _ntz(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def databases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    username = F.concat(F.lit("user_"), _pad8(c.c_custkey))
    created = F.timestamp_add("HOUR", c.c_custkey, _ntz(BASE_TS))
    return c.select(
        c.c_custkey.alias("id"),
        F.concat(F.lit("tenant_"), _pad8(c.c_custkey)).alias("database_name"),
        username.alias("username"),
        F.sha2(username, 256).alias("password_hash"),
        F.concat(F.lit("owner"), (c.c_custkey % 97).cast("string"),
                 F.lit("@example.com")).alias("owner_email"),
        c.c_name.alias("friendly_name"),
        (F.lit(10) + F.lit(10) * (c.c_custkey % 5)).cast("int").alias("max_connections"),
        F.when(c.c_acctbal >= 0, "active").otherwise("suspended").alias("status"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def ip_whitelist(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    suffix = (F.when(o.o_orderkey % 5 == 0, "/8").when(o.o_orderkey % 5 == 1, "/16")
              .when(o.o_orderkey % 5 == 2, "/24").when(o.o_orderkey % 5 == 3, "/32")
              .otherwise(""))
    ip = F.concat(F.lit("10."), (o.o_custkey % 256).cast("string"), F.lit("."),
                  (o.o_orderkey % 256).cast("string"), F.lit("."),
                  F.when(o.o_orderkey % 13 == 0, "300").otherwise("0"), suffix)
    return (o.filter(o.o_orderkey % 4 == 0)
            .select(o.o_orderkey.alias("id"), o.o_custkey.alias("database_id"),
                    ip.alias("ip_address"), o.o_orderpriority.alias("description"),
                    o.o_orderdate.alias("added_at")))


def api_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        s.s_suppkey.alias("id"),
        F.concat(F.lit("hash_"), s.s_name).alias("key_hash"),
        s.s_name.alias("name"),
        F.when(s.s_suppkey % 2 == 0, '{"databases": ["create", "read"]}')
         .otherwise('{"databases": ["read"]}').alias("permissions"),
        _ntz(BASE_TS).alias("created_at"),
        F.when(s.s_suppkey % 3 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.timestamp_add("HOUR", s.s_suppkey * 12, _ntz(BASE_TS)))
         .alias("expires_at"),
    )


_ACTIONS = {"signup": "database_created", "error": "database_deleted",
            "click": "ip_whitelist_added", "view": "ip_whitelist_removed"}


def audit_logs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    action = F.lit("other")
    for k, v in reversed(list(_ACTIONS.items())):
        action = F.when(e.event_type == k, v).otherwise(action)
    return e.select(
        e.event_id.alias("id"), (e.user_id % 12).alias("api_key_id"),
        action.alias("action"), F.lit("database").alias("resource_type"),
        e.user_id.cast("string").alias("resource_id"),
        e.props.alias("details"), e.ts.alias("created_at"))


def database_stats(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        li.l_orderkey.alias("total_queries"), li.l_suppkey.alias("database_id"),
        F.floor(li.l_extendedprice * 1024).cast("bigint").alias("size_bytes"),
        li.l_quantity.cast("int").alias("active_connections"),
        li.l_shipdate.alias("recorded_at"), li.l_linenumber.alias("seq"))


def shadow_databases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        p.p_partkey.alias("id"), p.p_partkey.alias("parent_database_id"),
        F.concat(F.lit("shadow_"), p.p_partkey.cast("string")).alias("shadow_database_name"),
        F.concat(F.lit("su_"), p.p_brand).alias("shadow_username"),
        F.lit("active").alias("status"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return (e.filter(e.event_type == "click")
            .select(e.event_id.alias("pid"),
                    F.concat(F.lit("tenant_"), _pad8(e.user_id)).alias("datname")))


def db_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return (p.filter(p.p_partkey % 7 != 0)
            .select(F.concat(F.lit("tenant_"), _pad8(p.p_partkey)).alias("datname"),
                    (p.p_partkey % 50 == 0).alias("datistemplate"),
                    F.floor(p.p_retailprice * 1000000).cast("bigint").alias("size_bytes")))


def pool_snapshot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = o.o_orderkey
    return o.select(
        F.concat(F.lit("tenant_"), _pad8(o.o_custkey)).alias("pool_database"),
        F.concat(F.lit("user_"), _pad8(o.o_custkey)).alias("pool_user"),
        (k % 50).cast("int").alias("cl_active"), (k % 7).cast("int").alias("cl_waiting"),
        (k % 25).cast("int").alias("sv_active"), (k % 5).cast("int").alias("sv_idle"),
        (k % 3).cast("int").alias("sv_used"), o.o_orderdate.alias("ts"))


def conn_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ip = F.concat(F.lit("10."), ((e.user_id + e.event_id % 3) % 256).cast("string"),
                  F.lit("."), (e.event_id % 256).cast("string"), F.lit("."),
                  (F.floor(e.value).cast("bigint") % 256).cast("string"))
    return e.select(e.event_id.alias("conn_id"), e.user_id.alias("database_id"),
                    ip.alias("client_ip"), (e.event_id % 2 == 0).alias("is_ssl"), e.ts)


def server_log(spark: SparkSession, d: str) -> DataFrame:
    # Log lines are text: spread like the text tables before parsing.
    e = table(spark, d, "events", spread_on=["event_id"])
    line = F.concat(
        F.substring(e.ts.cast("string"), 1, 19), F.lit(" UTC ["), e.event_id.cast("string"),
        F.lit("]: [1-1] user=user_"), _pad8(e.user_id),
        F.lit(",db=tenant_"), _pad8(e.user_id),
        F.lit(",app=psql,client=10.0.0."), (e.user_id % 256).cast("string"),
        F.lit(" LOG:  duration: "), F.floor(e.value * 20).cast("bigint").cast("string"),
        F.lit(".000 ms  statement: SELECT "), e.user_id.cast("string"))
    return e.select(line.alias("value"))


def cache_requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = (F.when(e.event_type == "view", "products")
            .when(e.event_type == "click", "session").otherwise("ai"))
    key = F.concat(F.lit("site:store_"), (e.user_id % 5).cast("string"), F.lit(":"), kind,
                   F.when(e.event_type == "purchase", ":embeddings:doc_").otherwise(":"),
                   e.user_id.cast("string"))
    return e.select(e.event_id.alias("request_id"), e.ts,
                    (e.user_id % 16).cast("int").alias("db"), key.alias("cache_key"),
                    (e.value >= 20).alias("hit"),
                    F.floor(e.value * 1000).cast("bigint").alias("duration_us"))


def backups(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return (o.filter(o.o_orderkey % 10 == 0)
            .select(F.concat(F.lit("postgres_control_"), o.o_orderkey.cast("string"),
                             F.lit(".sql.gz")).alias("name"),
                    o.o_orderdate.alias("mtime")))


def tenant_requests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = c.c_custkey
    return c.select(
        F.when(k % 11 == 0, "").otherwise(c.c_name).alias("friendly_name"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("o"), k.cast("string"), F.lit("@example.com")))
         .alias("owner_email"),
        F.when(k % 3 == 0, F.lit(None).cast("int")).when(k % 5 == 0, F.lit(0))
         .otherwise((k % 40).cast("int")).alias("max_connections"),
        k.alias("request_no"))


VIEWS = {
    "databases": databases, "ip_whitelist": ip_whitelist, "api_keys": api_keys,
    "audit_logs": audit_logs, "database_stats": database_stats,
    "shadow_databases": shadow_databases, "activity": activity,
    "db_catalog": db_catalog, "pool_snapshot": pool_snapshot, "conn_log": conn_log,
    "server_log": server_log, "cache_requests": cache_requests, "backups": backups,
    "tenant_requests": tenant_requests,
}


class Fleet:
    """Lazy accessor for the fixture views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self.spark, self.sf_dir)
        raise AttributeError(name)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)
