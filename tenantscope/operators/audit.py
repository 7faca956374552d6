"""Audit trail jobs: summaries, retention, enrichment, new audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantscope.functions import scalars as S

# The actions the API writes, in the order it defines them.
ACTIONS = ["database_created", "database_deleted", "ip_whitelist_added",
           "ip_whitelist_removed"]
RETENTION_DAYS = 90
BACKUP_KEEP_DAYS = 7


def _ts(as_of) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def audit_summary(audit: DataFrame) -> DataFrame:
    """Events per day and action, newest day first, biggest count
    first, action as the tie-break."""
    return (audit.groupBy(F.to_date("created_at").alias("date"), "action")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("date").desc(), F.col("count").desc(), F.col("action")))


def audit_crosstab(audit: DataFrame, actions: list[str] = ACTIONS) -> DataFrame:
    """Day x action counts. The pivot values are given, so Spark does
    not run an extra job to find them; absent combinations are 0."""
    p = (audit.groupBy(F.to_date("created_at").alias("date"))
         .pivot("action", actions).agg(F.count(F.lit(1))))
    return p.select("date", *[F.coalesce(F.col(a), F.lit(0)).cast("bigint").alias(a)
                              for a in actions])


def retention_split(df: DataFrame, as_of, ts_col: str = "created_at",
                    days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """Rows older than ``as_of - days`` are expired; rows with a NULL
    timestamp are kept (a NULL comparison deletes nothing)."""
    cutoff = _ts(as_of) - F.make_interval(days=F.lit(days))
    expired_c = F.col(ts_col) < cutoff
    return df.filter(~F.coalesce(expired_c, F.lit(False))), df.filter(expired_c)


def retention_counts(df: DataFrame, as_of, ts_col: str = "created_at",
                     days: int = RETENTION_DAYS) -> DataFrame:
    """Rows expired and kept, in one aggregate pass (the function's
    ``deleted_count``)."""
    cutoff = _ts(as_of) - F.make_interval(days=F.lit(days))
    exp = F.coalesce(F.col(ts_col) < cutoff, F.lit(False))
    return df.agg(F.count_if(exp).alias("expired"), F.count_if(~exp).alias("kept"),
                  F.count(F.lit(1)).alias("total"))


def expired_files(files: DataFrame, as_of, days: int = BACKUP_KEEP_DAYS,
                  mtime_col: str = "mtime") -> DataFrame:
    """Files whose age in whole days is greater than ``days``
    (``find -mtime +7``: at least 8 full days)."""
    age = S.whole_days_between(F.col(mtime_col), _ts(as_of))
    return files.withColumn("age_days", age).filter(F.col("age_days") > F.lit(days))


def audit_rows(df: DataFrame, action: str, id_col: str, details: dict,
               as_of=None, resource_type: str = "database") -> DataFrame:
    """One audit row per changed row, JSON details built in the JVM."""
    created = _ts(as_of) if as_of is not None else F.current_timestamp().cast("timestamp_ntz")
    return df.select(F.lit(action).alias("action"), F.lit(resource_type).alias("resource_type"),
                     F.col(id_col).cast("string").alias("resource_id"),
                     S.json_details(**details).alias("details"),
                     created.alias("created_at"))


def audit_with_tenant(audit: DataFrame, db: DataFrame) -> DataFrame:
    """Audit events with their tenant. ``resource_id`` has no foreign
    key, so deleted tenants find no row and fall back to the name kept in
    the event's details."""
    t = db.select(F.col("id").cast("string").alias("_rid"),
                  F.col("database_name").alias("_dn"), F.col("status").alias("tenant_status"))
    return (audit.join(t, audit["resource_id"] == t["_rid"], "left")
            .select("id", "action", "resource_id",
                    F.coalesce(F.col("_dn"),
                               F.get_json_object("details", "$.database_name")).alias("database_name"),
                    "tenant_status", "created_at"))


def audit_by_key(audit: DataFrame, keys: DataFrame) -> DataFrame:
    """Audit events with the API key used and whether the key had
    already expired when the event happened."""
    k = keys.select(F.col("id").alias("_kid"), F.col("name").alias("key_name"), "expires_at")
    return (audit.join(k, audit["api_key_id"] == k["_kid"], "left")
            .select("id", "api_key_id", "key_name", "action", "created_at",
                    (F.col("expires_at").isNotNull()
                     & (F.col("created_at") >= F.col("expires_at"))).alias("key_expired")))


def key_permissions(keys: DataFrame, resource: str = "databases",
                    verbs=("create", "read", "update", "delete")) -> DataFrame:
    """Permission flags read from the keys' JSON."""
    return keys.select("id", "name", *[S.has_permission("permissions", resource, v)
                                      .alias(f"can_{v}") for v in verbs])


def key_permissions_variant(keys: DataFrame, resource: str = "databases",
                            verbs=("create", "read", "update", "delete")) -> tuple[DataFrame, DataFrame]:
    """R58 over VARIANT: the JSON of a key is parsed once, all flags read the
    typed value. Returns the flags of every key and, apart, the keys whose
    permissions are no JSON (their flags are false)."""
    parsed = keys.withColumn("_v", F.try_parse_json("permissions"))
    bad = parsed.filter(F.col("permissions").isNotNull() & F.col("_v").isNull()).drop("_v")
    held = parsed.select("id", "name", F.try_variant_get("_v", f"$['{resource}']", "array<string>").alias("_h"))
    return held.select("id", "name", *[F.coalesce(F.array_contains("_h", v), F.lit(False)).alias(f"can_{v}") for v in verbs]), bad
