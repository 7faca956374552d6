"""Structured Streaming jobs over the append-only feeds (R79-R85) and their
batch twins.

Event-time columns of the control plane are TIMESTAMP_NTZ; watermarks need
TIMESTAMP, so every stream first derives ``event_time`` (session time zone
UTC makes the cast an identity). Checkpoints go under the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenantscope.operators import access
from tenantscope.sources import logs
from tenantscope.sources.sinks import write_rules

# Our figures (the control plane defines no stream parameters): late rows
# are dropped after one hour; rates over 10-minute windows every 5 minutes;
# sessions end after 30 idle minutes; cache entries live 3600 s.
LATE_AFTER = "1 hour"
RATE_WINDOW, RATE_SLIDE = "10 minutes", "5 minutes"
SESSION_GAP = "30 minutes"
CACHE_TTL_SECONDS = 3600


def event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("event_time", F.col(ts).cast("timestamp"))


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# R79 audit summary by day
# ---------------------------------------------------------------------------
def audit_summary_windows(audit: DataFrame, late: str | None = LATE_AFTER) -> DataFrame:
    """Events per (day window, action). On a stream the watermark drops rows
    more than ``late`` behind the newest event and append mode emits each
    day once it is closed; on a batch it is the plain aggregate."""
    e = event_time(audit, "created_at")
    if audit.isStreaming and late:
        e = e.withWatermark("event_time", late)
    g = e.groupBy(F.window("event_time", "1 day").alias("w"), "action") \
         .agg(F.count(F.lit(1)).alias("count"))
    return g.select(F.to_date(_ntz(F.col("w.start"))).alias("date"), "action", "count")


# ---------------------------------------------------------------------------
# R80 sliding connection rate per tenant
# ---------------------------------------------------------------------------
def connection_rate(conns: DataFrame, window: str = RATE_WINDOW, slide: str = RATE_SLIDE,
                    key: str = "database_id", late: str | None = LATE_AFTER) -> DataFrame:
    e = event_time(conns, "ts")
    if conns.isStreaming and late:
        e = e.withWatermark("event_time", late)
    g = e.groupBy(F.window("event_time", window, slide).alias("w"), key) \
         .agg(F.count(F.lit(1)).alias("connections"))
    return g.select(_ntz(F.col("w.start")).alias("window_start"),
                    _ntz(F.col("w.end")).alias("window_end"), key, "connections")


# ---------------------------------------------------------------------------
# R81 client sessions by inactivity gap
# ---------------------------------------------------------------------------
def sessions(conns: DataFrame, gap: str = SESSION_GAP, key: str = "database_id",
             late: str | None = LATE_AFTER) -> DataFrame:
    e = event_time(conns, "ts")
    if conns.isStreaming and late:
        e = e.withWatermark("event_time", late)
    g = e.groupBy(F.session_window("event_time", gap).alias("s"), key) \
         .agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, _ntz(F.col("s.start")).alias("session_start"),
                    _ntz(F.col("s.end")).alias("session_end"), "events")


# ---------------------------------------------------------------------------
# R82 cache expiry: was the key written within its TTL before the read?
# ---------------------------------------------------------------------------
def ttl_hits_stream(reads: DataFrame, writes: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS,
                    key: str = "cache_key", late: str = LATE_AFTER) -> DataFrame:
    """Stream-stream left-semi join: reads for which a write of the same key
    happened within ``ttl_seconds`` before. Both sides are watermarked and
    the band bounds the join state."""
    r = event_time(reads, "ts").withWatermark("event_time", late).alias("r")
    w = (event_time(writes, "ts").withWatermark("event_time", late)
         .select(F.col(key).alias("_wk"), F.col("event_time").alias("_wt")).alias("w"))
    cond = ((F.col(f"r.{key}") == F.col("_wk")) & (F.col("_wt") < F.col("r.event_time"))
            & (F.col("_wt") >= F.col("r.event_time") - F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
    return r.join(w, cond, "left_semi").drop("event_time")


def ttl_hits(reads: DataFrame, writes: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS,
             key: str = "cache_key", ts: str = "ts", splits: int = 12) -> DataFrame:
    """Batch twin of ``ttl_hits_stream`` as an as-of lookup, linear and
    skew-safe: time is cut into chunks of ``ttl_seconds / splits``; a
    read's latest earlier write is either earlier in its own (key, chunk)
    (a running max over a bounded window) or the latest write of one of
    the ``splits`` chunks before (a per-chunk aggregate shipped forward).
    A read hits when that write is at most ``ttl_seconds`` old. A NULL key
    equals no key, so its reads never hit."""
    reads, writes = (t.filter(F.col(key).isNotNull()) for t in (reads, writes))
    width = ttl_seconds // splits
    if width * splits != ttl_seconds:
        raise ValueError("splits must divide ttl_seconds")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    both = (reads.select("*", F.lit(True).alias("_read"), us.alias("_us"))
            .unionByName(writes.select(F.col(key), us.alias("_us"))
                         .withColumn("_read", F.lit(False)), allowMissingColumns=True)
            .withColumn("_c", F.floor(F.col("_us") / F.lit(width * 1_000_000))))
    w = (Window.partitionBy(key, "_c").orderBy("_us")
         .rangeBetween(Window.unboundedPreceding, -1))
    own = both.withColumn("_lw", F.max(F.when(~F.col("_read"), F.col("_us"))).over(w))
    chunk_max = (both.filter(~F.col("_read")).groupBy(key, "_c").agg(F.max("_us").alias("_m"))
                 .withColumn("_to", F.explode(F.sequence(F.col("_c") + 1, F.col("_c") + splits)))
                 .groupBy(F.col(key).alias("_k"), "_to").agg(F.max("_m").alias("_pm")))
    reads_only = own.filter(F.col("_read"))
    r = reads_only.join(chunk_max, (reads_only[key] == chunk_max["_k"])
                        & (reads_only["_c"] == chunk_max["_to"]), "left")
    last = F.greatest(F.col("_lw"), F.col("_pm"))
    hit = last.isNotNull() & (last >= F.col("_us") - F.lit(ttl_seconds * 1_000_000))
    return r.filter(hit).select(*reads.columns)


def cache_fills(cache_requests: DataFrame) -> DataFrame:
    """Writes to the cache: every missed request fills its key."""
    return cache_requests.filter(~F.col("hit")).select("cache_key", "ts")


# ---------------------------------------------------------------------------
# R83 slow statement alerts, R85 dedupe
# ---------------------------------------------------------------------------
def slow_stream(spark, path: str, threshold_ms: float = 1000.0) -> DataFrame:
    lines = spark.readStream.text(path)
    good, _ = logs.parse_server_log(lines)
    return good.filter(F.col("duration_ms") >= threshold_ms)


def dedupe_stream(s: DataFrame, keys: list[str], ts: str = "ts",
                  within: str = f"{CACHE_TTL_SECONDS} seconds") -> DataFrame:
    """Drop repeats of the same keys while the first one is within the
    watermark delay (state is bounded by the delay)."""
    e = event_time(s, ts).withWatermark("event_time", within)
    return e.dropDuplicatesWithinWatermark(keys).drop("event_time")


# ---------------------------------------------------------------------------
# R84 rules rebuilt on each whitelist change
# ---------------------------------------------------------------------------
def rules_stream(changes: DataFrame, load_tables: Callable[[], tuple[DataFrame, DataFrame]],
                 out_dir: str, checkpoint: str) -> StreamingQuery:
    """On every micro-batch of whitelist changes, recompute the full rule
    set from the current table version (as the API does on each change)
    and write it to ``{out_dir}/batch={id}``; an empty batch writes
    nothing. A batch id is stable across retries, so a retried batch
    overwrites its own directory: the output is idempotent."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        db, wl = load_tables()
        write_rules(access.generate_rules(db, wl), f"{out_dir.rstrip('/')}/batch={batch_id}",
                    mode="overwrite")

    return (changes.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


RULE_BUCKETS = 256


def refresh_rules(db: DataFrame, wl: DataFrame, changed: DataFrame, out_dir: str, buckets: int = RULE_BUCKETS) -> None:
    """R84 for what changed: rules are kept in ``buckets`` directories by tenant
    id, and only the buckets that hold a tenant of ``changed`` (database_id) are
    computed and written anew (dynamic partition overwrite); the files of the
    others are not touched. A bucket that is left without rules keeps a row without a name,
    which ``read_rules`` leaves out."""
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(buckets)).cast("int")
    touched = changed.where("database_id is not null").select(bucket("database_id").alias("bucket")).distinct()
    touched = db.sparkSession.createDataFrame([(r["bucket"],) for r in touched.collect()], "bucket int")  # at most ``buckets``
    own = db.withColumn("bucket", bucket("id")).join(F.broadcast(touched), "bucket", "left_semi")
    entries = wl.withColumn("bucket", bucket("database_id")).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
    rules = access.generate_rules(own.drop("bucket"), entries).join(own.select("database_name", "bucket"), "database_name")
    rows = rules.select("database_name", "rule_no", "line", "bucket").unionByName(touched, allowMissingColumns=True)
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "database_name", "rule_no")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out_dir))


def read_rules(spark, out_dir: str) -> DataFrame:
    schema = "database_name string, rule_no int, line string, bucket int"
    return spark.read.schema(schema).parquet(out_dir).where("database_name is not null").drop("bucket")


def rules_stream_incremental(changes: DataFrame, load_tables: Callable[[], tuple[DataFrame, DataFrame]], out_dir: str,
                             checkpoint: str, buckets: int = RULE_BUCKETS) -> StreamingQuery:
    """On every micro-batch of whitelist changes, ``refresh_rules`` of its
    tenants. A retried batch writes the same buckets again."""
    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh_rules(*load_tables(), batch, out_dir, buckets)

    return (changes.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a streaming DataFrame over everything available into an
    in-memory table ``name`` (tests and local checks)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_available_to(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Run a streaming DataFrame over everything available into a file sink
    (append, exactly-once through the sink's commit log; restartable from
    ``checkpoint``)."""
    q = (df.writeStream.format(fmt).outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_complete_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregating stream over everything available and keep its whole
    result as a table: each micro-batch overwrites it (idempotent on retry).
    Windows that are still open count too."""
    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = (df.writeStream.outputMode("complete").foreachBatch(keep)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
