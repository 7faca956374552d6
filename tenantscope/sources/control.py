"""Readers for the control tables and server snapshots.

Schemas are explicit (``schemas``), never inferred. Parquet scans get
column pruning and filter pushdown from Catalyst; JDBC reads are split into
parallel range queries on a numeric column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantscope import schemas

TABLE_SCHEMAS = {
    "databases": schemas.DATABASES, "ip_whitelist": schemas.IP_WHITELIST,
    "api_keys": schemas.API_KEYS, "audit_logs": schemas.AUDIT_LOGS,
    "database_stats": schemas.DATABASE_STATS, "shadow_databases": schemas.SHADOW_DATABASES,
    "activity": schemas.ACTIVITY, "db_catalog": schemas.DB_CATALOG,
    "pool_snapshot": schemas.POOL_SNAPSHOT, "conn_log": schemas.CONN_LOG,
    "cache_requests": schemas.CACHE_REQUESTS, "backups": schemas.BACKUPS,
    "tenant_requests": schemas.TENANT_REQUESTS,
}


def read_control(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
                 jdbc: dict | None = None) -> DataFrame:
    """Scan one control table.

    ``fmt='parquet'`` (default) reads ``{path}/{table}`` with the fixed
    schema. ``fmt='jdbc'`` reads from the database with ``jdbc`` options
    (``url``, ``properties`` and, for a parallel read, ``column``,
    ``lowerBound``, ``upperBound``, ``numPartitions``).
    """
    if fmt == "jdbc":
        o = dict(jdbc or {})
        url, props = o.pop("url"), o.pop("properties", {})
        if "column" in o:
            return spark.read.jdbc(url, o.pop("query", table), column=o["column"],
                                   lowerBound=o["lowerBound"], upperBound=o["upperBound"],
                                   numPartitions=o["numPartitions"], properties=props)
        return spark.read.jdbc(url, o.pop("query", table), properties=props)
    reader = spark.read.format(fmt)
    if table in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[table])
    return reader.load(f"{path.rstrip('/')}/{table}")


def _snapshot(df: DataFrame, snapshot_ts) -> DataFrame:
    if snapshot_ts is None:
        return df
    return df.withColumn("snapshot_ts", F.lit(snapshot_ts).cast("timestamp_ntz"))


def read_activity(spark: SparkSession, path: str, snapshot_ts=None) -> DataFrame:
    """Server activity snapshot (pid, datname), stamped with its time."""
    return _snapshot(spark.read.schema(schemas.ACTIVITY).parquet(path), snapshot_ts)


def read_catalog(spark: SparkSession, path: str, snapshot_ts=None) -> DataFrame:
    """Database catalogue with sizes."""
    return _snapshot(spark.read.schema(schemas.DB_CATALOG).parquet(path), snapshot_ts)


# Pool-table columns as the pooler prints them.
POOL_COLUMNS = ["database", "user", "cl_active", "cl_waiting", "sv_active", "sv_idle", "sv_used"]


def parse_pools(lines: DataFrame, col: str = "value", snapshot_ts=None, table: str | None = None) -> DataFrame:
    """The pooler's ``|``-separated pool table (header, rule line, rows,
    optional ``(n rows)`` footer) to typed columns. Columns are found by their
    names in the header line, because poolers of different versions print
    different columns; one that the header lacks is NULL. ``table`` names a
    column that tells several printed tables apart (a file, a host); their
    headers may differ. The header lines, one or few per table, are joined
    back; rows without a header line are read in ``POOL_COLUMNS`` order."""
    v = F.col(col)
    cells = F.transform(F.split(v, r"\|"), lambda x: F.trim(x))
    by = F.col(table) if table else F.lit(0)
    rows = lines.filter((F.instr(v, "|") > 0) & ~F.trim(v).startswith("-")).select(by.alias("_t"), cells.alias("c"))
    is_head = F.get(F.col("c"), F.lit(0)) == POOL_COLUMNS[0]
    heads = rows.filter(is_head).groupBy("_t").agg(F.min("c").alias("h"))
    usual = F.array(*map(F.lit, POOL_COLUMNS))
    data = rows.filter(~is_head).join(heads, "_t", "left").withColumn("h", F.coalesce("h", usual))

    def cell(name: str):
        at = F.array_position("h", F.lit(name))
        return F.when(at > 0, F.get(F.col("c"), (at - 1).cast("int")))

    out = data.select(*([F.col("_t").alias(table)] if table else []), cell("database").alias("pool_database"),
                      cell("user").alias("pool_user"), *[cell(n).try_cast("int").alias(n) for n in POOL_COLUMNS[2:]])
    return _snapshot(out, snapshot_ts)


def read_pools(spark: SparkSession, path: str, snapshot_ts=None) -> DataFrame:
    return parse_pools(spark.read.text(path), snapshot_ts=snapshot_ts)


def render_pools(pools: DataFrame) -> DataFrame:
    """The pool table as the pooler prints it (one data line per row), for
    round trips and tests."""
    return pools.select(F.concat_ws(" | ", F.concat(F.lit(" "), F.col("pool_database")),
                                    "pool_user", *[F.col(c).cast("string") for c in POOL_COLUMNS[2:]])
                        .alias("value"))
