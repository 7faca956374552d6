"""Operational feeds: cache, pool, statistics and slow-entry reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantscope.functions import scalars as S

# Slow thresholds of the server log (ms) and the cache slow
# log (microseconds); cache slow-log read size.
SLOW_STATEMENT_MS = 1000
SLOW_CACHE_US = 10000
SLOWLOG_READ = 5
# README cost example: price per LLM request in dollars.
PRICE_PER_REQUEST = 0.03


def slow(df: DataFrame, col: str, threshold, inclusive: bool = True) -> DataFrame:
    """Entries at or above (``inclusive``) / above the threshold."""
    c = F.col(col)
    return df.filter(c >= threshold if inclusive else c > threshold)


def with_key_parts(df: DataFrame, col: str = "cache_key") -> DataFrame:
    """Split ``site:{site}:{type}:{rest}`` into columns."""
    p = S.cache_key_parts(col)
    return df.withColumn("_p", p).select("*", F.col("_p.site").alias("site"),
                                         F.col("_p.type").alias("type"),
                                         F.col("_p.rest").alias("rest")).drop("_p")


def hit_rate(df: DataFrame, keys: list[str], hit_col: str = "hit") -> DataFrame:
    """Hits, misses and hit rate in percent (two decimals) per group;
    groups with no requests produce no row."""
    h = F.col(hit_col)
    return (df.groupBy(*keys)
            .agg(F.count_if(h).alias("hits"), F.count_if(~h).alias("misses"))
            .filter((F.col("hits") + F.col("misses")) > 0)
            .withColumn("hit_rate", F.round(F.lit(100.0) * F.col("hits")
                                            / (F.col("hits") + F.col("misses")), 2)))


def keys_per_db(df: DataFrame, db_col: str = "db", key_col: str = "cache_key") -> DataFrame:
    """Distinct keys per cache database; empty ones are absent."""
    return (df.filter(F.col(key_col).isNotNull())
            .groupBy(db_col).agg(F.count_distinct(key_col).alias("keys")))


def cache_by_site(df: DataFrame) -> DataFrame:
    """Keys, requests and hits by site and key type."""
    p = with_key_parts(df)
    return (p.groupBy("site", "type")
            .agg(F.count_distinct("cache_key").alias("keys"),
                 F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits")))


def cache_savings(df: DataFrame, price: float = PRICE_PER_REQUEST,
                  keys: list[str] | None = None) -> DataFrame:
    """What requests would cost without the cache and with it (only
    misses reach the model), per group (default: per day)."""
    keys = keys or [F.to_date("ts").alias("date")]
    return (df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("hit")).alias("misses"))
            .withColumn("cost_all", F.round(F.col("requests") * F.lit(price), 4))
            .withColumn("cost_miss", F.round(F.col("misses") * F.lit(price), 4))
            .withColumn("saved", F.round((F.col("requests") - F.col("misses")) * F.lit(price), 4))
            .withColumn("saved_pct", F.round(F.lit(100.0) * (F.col("requests") - F.col("misses"))
                                             / F.col("requests"), 2)))


def pool_usage(pools: DataFrame) -> DataFrame:
    """Pool use per database: client and server connections summed
    over snapshots, peaks, and the multiplexing ratio ``1 - server/client``
    (NULL when there were no clients)."""
    cl = F.col("cl_active") + F.col("cl_waiting")
    sv = F.col("sv_active") + F.col("sv_idle") + F.col("sv_used")
    g = pools.groupBy("pool_database").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.sum(cl).cast("bigint").alias("clients"), F.sum(sv).cast("bigint").alias("servers"),
        F.max("cl_active").alias("peak_cl_active"), F.max("sv_active").alias("peak_sv_active"),
        F.sum("cl_waiting").cast("bigint").alias("waiting"))
    return g.withColumn("multiplex_ratio",
                        F.when(F.col("clients") > 0,
                               F.round(F.lit(1.0) - F.col("servers") / F.col("clients"), 4)))


STATS_ORDER = ["recorded_at", "total_queries", "seq", "size_bytes"]


def stats_rollup(stats: DataFrame, order_cols: list[str] = STATS_ORDER) -> DataFrame:
    """Latest size (by the full tie-break order), peak size and mean
    connections per tenant; ``max_by`` over a struct is one aggregate with
    map-side partial results, so a hot tenant is fine."""
    order = F.struct(*[F.col(c) for c in order_cols if c in stats.columns])
    return stats.groupBy("database_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.max_by("size_bytes", order).alias("latest_size"),
        F.max("recorded_at").alias("latest_at"),
        F.max("size_bytes").alias("peak_size"),
        F.round(F.avg("active_connections"), 4).alias("avg_connections"))


def last_slow(df: DataFrame, part: str = "db", n: int = SLOWLOG_READ,
              threshold: int = SLOW_CACHE_US, ts_col: str = "ts",
              tie_col: str = "request_id", dur_col: str = "duration_us") -> DataFrame:
    """The last ``n`` slow entries per host/database. ``row_number <= n``
    lets Catalyst put a partial group limit before the shuffle, so each
    group ships at most ``n`` rows per map task."""
    w = Window.partitionBy(part).orderBy(F.col(ts_col).desc(), F.col(tie_col).desc())
    return (slow(df, dur_col, threshold, inclusive=False)
            .withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n))
