"""Tenant registry jobs: listings, lookups, statistics, registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantscope.functions import scalars as S

LISTING_COLS = ["id", "database_name", "username", "owner_email", "friendly_name",
                "max_connections", "status", "created_at", "updated_at"]
DEFAULT_MAX_CONNECTIONS = 20
REQUIRED_MESSAGE = "friendlyName and ownerEmail are required"


def list_databases(db: DataFrame) -> DataFrame:
    """Registry without the password hash, newest first; ``id`` is
    the tie-break the original ordering lacked."""
    cols = [c for c in LISTING_COLS if c in db.columns]
    return db.select(*cols).orderBy(F.col("created_at").desc(), F.col("id"))


def get_databases(db: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Lookup by id for a whole set of ids (0 or 1 row each).
    A left-semi join never duplicates registry rows."""
    keys = ids.select(F.col(id_col).alias("_id"))
    cols = [c for c in LISTING_COLS if c in db.columns]
    return db.join(keys, db["id"] == keys["_id"], "left_semi").select(*cols)


def active_databases(db: DataFrame, wl: DataFrame, catalog: DataFrame) -> DataFrame:
    """R34 (R21): active tenants with whitelist count and size.

    The whitelist is reduced to one row per tenant *before* the join
    (partial + final aggregate; a hot tenant is merged map-side), so the
    join never carries raw whitelist rows. Tenants without entries get 0.
    """
    per_tenant = (wl.groupBy(F.col("database_id").alias("_tid"))
                  .agg(F.count_distinct("id").alias("whitelisted_ips")))
    active = db.filter(F.col("status") == "active")
    sizes = catalog.select(F.col("datname").alias("_dn"), "size_bytes")
    return (active.join(per_tenant, active["id"] == per_tenant["_tid"], "left")
            .join(sizes, active["database_name"] == sizes["_dn"], "left")
            .select("id", "database_name", "friendly_name", "owner_email",
                    "max_connections", "status", "created_at",
                    F.coalesce("whitelisted_ips", F.lit(0)).cast("bigint").alias("whitelisted_ips"),
                    "size_bytes"))


def connections_by_db(activity: DataFrame) -> DataFrame:
    """Sessions per database name; the NULL group (background
    processes) is kept."""
    return activity.groupBy("datname").agg(F.count(F.lit(1)).alias("connections"))


def database_stats_now(db: DataFrame, catalog: DataFrame, activity: DataFrame) -> DataFrame:
    """Size and live connections for every tenant at once (the API asks
    one tenant per call and joins two servers' answers client-side)."""
    conns = (activity.filter(F.col("datname").isNotNull())
             .groupBy(F.col("datname").alias("_cn"))
             .agg(F.count(F.lit(1)).alias("_conns")))
    sizes = catalog.select(F.col("datname").alias("_dn"), "size_bytes")
    t = db.select(F.col("id").alias("database_id"), "database_name", "max_connections")
    return (t.join(sizes, t["database_name"] == sizes["_dn"], "left")
            .join(conns, t["database_name"] == conns["_cn"], "left")
            .select("database_id", "database_name", "size_bytes",
                    S.format_bytes("size_bytes").alias("size_pretty"),
                    F.coalesce("_conns", F.lit(0)).cast("bigint").alias("active_connections"),
                    "max_connections"))


def largest_databases(catalog: DataFrame, n: int | None = None) -> DataFrame:
    """Non-template databases by size, with PostgreSQL size text.
    With ``n`` the sort becomes a distributed top-n (TakeOrderedAndProject)."""
    out = (catalog.filter(~F.col("datistemplate"))
           .select("datname", "size_bytes", S.size_pretty("size_bytes").alias("size"))
           .orderBy(F.col("size_bytes").desc(), F.col("datname")))
    return out.limit(n) if n else out


def apply_defaults(req: DataFrame) -> DataFrame:
    """``maxConnections || 20`` (NULL and 0 become 20) and empty
    descriptions become NULL."""
    out = req
    if "max_connections" in req.columns:
        mc = F.col("max_connections")
        out = out.withColumn("max_connections",
                             F.when(mc.isNull() | (mc == 0), F.lit(DEFAULT_MAX_CONNECTIONS))
                             .otherwise(mc).cast("int"))
    if "description" in req.columns:
        out = out.withColumn("description", F.nullif(F.col("description"), F.lit("")))
    return out


def split_required(req: DataFrame, cols: list[str],
                   message: str = REQUIRED_MESSAGE) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field present and non-empty, and the
    rest with a reason. Both outputs are filters over one input plan."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    ok = req.filter(~missing)
    bad = req.filter(missing).withColumn("reason", F.lit(message))
    return ok, bad


def tenant_names(req: DataFrame, key_cols: list[str]) -> DataFrame:
    """``tenant_<key>`` / ``user_<key>`` from an 8-hex key over the
    request's fields (deterministic, so a retried batch gets the same names)."""
    k = S.tenant_key(*key_cols)
    return (req.withColumn("_key", k)
            .withColumn("database_name", F.concat(F.lit("tenant_"), F.col("_key")))
            .withColumn("username", F.concat(F.lit("user_"), F.col("_key")))
            .drop("_key"))


def connection_strings(db: DataFrame, host) -> DataFrame:
    """The three connection strings per tenant, password masked."""
    h = F.lit(host) if isinstance(host, str) else host
    return db.select(
        F.col("id").alias("database_id"), "database_name", "username",
        S.connection_string("username", "database_name", h, "pooled").alias("DATABASE_URL"),
        S.connection_string("username", "database_name", h, "direct").alias("DIRECT_URL"),
        S.connection_string("username", "database_name", h, "shadow").alias("SHADOW_DATABASE_URL"))


def parse_connection(df: DataFrame, c: str) -> DataFrame:
    """Connection string to user, host, port, database and flags."""
    url = F.col(c)
    return df.select(
        "*",
        F.regexp_extract(url, r"^[a-z]+://([^:@/]+)", 1).alias("url_user"),
        F.regexp_extract(url, r"@([^:/?]+)", 1).alias("url_host"),
        F.regexp_extract(url, r"@[^:/?]+:([0-9]+)", 1).try_cast("int").alias("url_port"),
        F.regexp_extract(url, r"@[^/]*/([^?]*)", 1).alias("url_database"),
        F.regexp_extract(url, r"[?&]sslmode=([^&]*)", 1).alias("sslmode"),
        (F.regexp_extract(url, r"[?&]pgbouncer=([^&]*)", 1) == "true").alias("pooled"),
    )


def _new_ids(db: DataFrame, order_col: str, *key: str):
    """Ids of new rows. Number keys: highest existing id (a scalar subquery,
    run once) plus the request number, unique and increasing without a global
    window. UUID keys (the stored registry): a UUID made from ``key``, so a
    retried batch gets the same ids."""
    if db.schema["id"].dataType.simpleString() != "string":
        return db.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() + F.col(order_col)
    h = F.sha2(F.concat_ws("|", *key, F.col(order_col).cast("string")), 256)
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)),
           F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *cut)


def mark_duplicates(r: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Add ``_dup``: a row with ``_ok`` whose keys an earlier ``_ok`` row (by
    ``order_col``) holds too. The first number per key is a partial aggregate, so
    a key repeated a million times is merged map-side; only rows that repeat
    both key and number are ranked in a window."""
    first = r.filter("_ok").groupBy(*keys).agg(F.min(order_col).alias("_first"))
    same = Window.partitionBy(*keys, order_col, "_ok").orderBy(order_col)
    return (r.join(first, keys, "left").withColumn("_same", F.row_number().over(same))
            .withColumn("_dup", F.col("_ok") & ((F.col(order_col) != F.col("_first")) | (F.col("_same") > 1))))


def register(req: DataFrame, db: DataFrame, as_of: str,
             order_col: str = "request_no") -> dict[str, DataFrame]:
    """Register a batch of tenants.

    Required check (R13) -> defaults (R12) -> names (R53) -> uniqueness of
    names against the registry and inside the batch (first request wins)
    -> new registry rows and their ``database_created`` audit rows (R51).
    Returns ``accepted``, ``audit`` and ``rejected``; every request is in
    exactly one of accepted and rejected. Rejects carry the request as it
    came. ``password_hash`` is the request's, NULL if it brings none.
    """
    missing = F.lit(False)
    for c in ("friendly_name", "owner_email"):
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    named = tenant_names(apply_defaults(req.withColumn("_raw", F.struct(*req.columns))),
                         ["owner_email", "friendly_name", order_col])
    # Names and user names come from the same key, so one check covers both.
    taken = db.select(F.col("database_name").alias("_dn")).distinct()
    r = named.join(taken, named["database_name"] == taken["_dn"], "left")
    reason = (F.when(missing, REQUIRED_MESSAGE).when(F.col(order_col).isNull(), f"{order_col} is required")
              .when(F.col("_dn").isNotNull(), "name_taken"))
    r = mark_duplicates(r.withColumn("_why", reason).withColumn("_ok", F.col("_why").isNull()),
                        ["database_name"], order_col)
    r = r.withColumn("reason", F.when(F.col("_dup"), "duplicate_in_batch").otherwise(F.col("_why")))
    ts = F.lit(as_of).cast("timestamp_ntz")
    given = F.col("password_hash") if "password_hash" in req.columns else F.lit(None).cast("string")
    accepted = (r.filter(F.col("reason").isNull())
                .select(_new_ids(db, order_col, "database_name").alias("id"), "database_name",
                        "username", given.alias("password_hash"),
                        "owner_email", "friendly_name", "max_connections",
                        F.lit("active").alias("status"), ts.alias("created_at"),
                        ts.alias("updated_at")))
    from tenantscope.operators.audit import audit_rows
    audit = audit_rows(accepted, "database_created", "id",
                       {"database_name": "database_name", "username": "username"}, as_of)
    rejected = r.filter(F.col("reason").isNotNull()).select("_raw.*", "reason")
    return {"accepted": accepted, "audit": audit, "rejected": rejected}
