"""Text feeds: server log, API access log, cache INFO counters.

Every parser takes a DataFrame of lines (``value``) so the same code serves
``spark.read.text`` batches and ``spark.readStream.text`` streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The server's log line prefix ``%t [%p]: [%l-1]
# user=%u,db=%d,app=%a,client=%h `` followed by ``LEVEL:  message``.
SERVER_LOG_PATTERN = (r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) (\S+) \[(\d+)\]: "
                      r"\[(\d+)-\d+\] user=([^,]*),db=([^,]*),app=([^,]*),client=(\S*) "
                      r"([A-Z]+[0-9]?):\s+(.*)$")
DURATION_PATTERN = r"duration: ([0-9]+(?:\.[0-9]+)?) ms"
# API access log: ``<ISO-8601 time> <METHOD> <path>``.
ACCESS_LOG_PATTERN = r"^(\S+) ([A-Z]+) (\S+)$"
# Path segments that are ids (UUIDs or numbers) become ``:id``.
ID_SEGMENT = r"/([0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]+)(?=/|$)"
# Between the fields of a matched line (a control character no log line holds).
SEP = "\u001f"
# Cache INFO counters read by the monitor.
CACHE_COUNTERS = ["keyspace_hits", "keyspace_misses", "total_commands_processed",
                  "instantaneous_ops_per_sec", "evicted_keys", "connected_clients",
                  "blocked_clients", "used_memory"]


def _fields(line, pattern: str, n: int):
    """The ``n`` groups of ``pattern`` as an array, empty where the line does
    not match: one match a line, its groups set apart by a control character
    that ends the text a group may hold."""
    parts = F.split(F.regexp_replace(line, pattern, SEP.join(f"${i}" for i in range(1, n + 1)) + SEP), SEP, n + 1)
    return F.when(F.size(parts) == n + 1, parts).otherwise(F.array().cast("array<string>"))


def _with_fields(lines: DataFrame, col: str, pattern: str, n: int) -> DataFrame:
    # A line that holds the separator itself cannot be told apart: it is bad.
    fields = F.when(F.instr(F.coalesce("_line", F.lit("")), SEP) == 0, _fields(F.col("_line"), pattern, n))
    # The generator keeps the match in one place: no filter above can copy it.
    return lines.select(F.col(col).alias("_line")).select("_line", F.explode(F.array(fields)).alias("_f"))


def _ntz(text, *formats: str):
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def parse_server_log(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split log lines into fields. Lines that do not match the prefix, or
    whose time, process or line number is no such value, go to the second
    output (``_bad``) instead of being dropped or ending the job."""
    f = lambda i: F.get(F.col("_f"), F.lit(i - 1))
    parsed = _with_fields(lines, col, SERVER_LOG_PATTERN, 10).select(
        "_line", _ntz(f(1), "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"),
        f(2).alias("tz"), f(3).try_cast("bigint").alias("pid"), f(4).try_cast("bigint").alias("line_no"),
        f(5).alias("usr"), f(6).alias("db"), f(7).alias("app"), f(8).alias("client"),
        f(9).alias("level"), f(10).alias("message"),
        F.regexp_extract(f(10), DURATION_PATTERN, 1).try_cast("double").alias("duration_ms"))
    ok = F.col("ts").isNotNull() & F.col("pid").isNotNull() & F.col("line_no").isNotNull()
    return parsed.filter(ok).drop("_line"), parsed.filter(~ok).select(F.col("_line").alias("_bad"))


def read_server_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_server_log(spark.read.text(path))


def parse_access_log(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``ISO METHOD path`` lines to ts, method, path and route (ids in
    the path replaced by ``:id``); other lines, and lines whose first word is
    no time, go to the second output (``_bad``)."""
    f = lambda i: F.get(F.col("_f"), F.lit(i - 1))
    parsed = _with_fields(lines, col, ACCESS_LOG_PATTERN, 3).select(
        "_line", _ntz(f(1), "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX").alias("ts"),
        f(2).alias("method"), f(3).alias("path"), F.regexp_replace(f(3), ID_SEGMENT, "/:id").alias("route"))
    ok = F.col("ts").isNotNull()
    return parsed.filter(ok).drop("_line"), parsed.filter(~ok).select(F.col("_line").alias("_bad"))


def read_access_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_access_log(spark.read.text(path))


def parse_cache_info(lines: DataFrame, host_col: str = "host", col: str = "value",
                     names: list[str] = CACHE_COUNTERS) -> DataFrame:
    """``name:value`` counter lines per host to one row per host with a
    column per counter. The pivot values are given, so no extra pass."""
    kv = F.split(F.col(col), ":", 2)
    pairs = (lines.filter(F.instr(F.col(col), ":") > 0)
             .select(host_col, F.trim(kv[0]).alias("name"), F.trim(kv[1]).alias("v"))
             .filter(F.col("name").isin(names)))
    wide = pairs.groupBy(host_col).pivot("name", names).agg(F.first("v"))
    return wide.select(host_col, *[F.col(n).try_cast("double").alias(n) for n in names])


def read_cache_info(spark: SparkSession, path: str) -> DataFrame:
    """One INFO dump per file; the host is the file name."""
    lines = spark.read.text(path).withColumn(
        "host", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1))
    return parse_cache_info(lines)
