"""Ordered per-tenant windows (R66-R68), skew-safe.

``Window.partitionBy(tenant)`` puts a whole tenant in one task. Here the rows
of a tenant with more than ``TENANT_ROWS`` are cut into time chunks; those of a
smaller one into years. A row's predecessors are those of its own (tenant, chunk), from a plain window, and the last rows of the
chunks before, which travel as one short array per chunk: first along the
chunks of a month, then along the months of a tenant, so that no window holds
more than a small tenant's year, a month's chunks or a tenant's months (years).
All tenants take this one path, and NULL keys or times are a group or chunk like any other,
so the result is that of the plain per-tenant window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS_ORDER = ["recorded_at", "total_queries", "seq", "size_bytes"]
# The stored statistics table has a serial id instead of ``seq``.
STORED_ORDER = ["recorded_at", "id"]


def stats_order(stats: DataFrame, order_cols: list[str] | None) -> list[str]:
    return order_cols or (STATS_ORDER if "seq" in stats.columns else STORED_ORDER)


# Rows of a tenant that may share one window. Chunks of few rows each cost more
# than they save: their tails are nearly as many as the rows.
TENANT_ROWS = 1 << 18
# Second key values that share a chunk when their times are equal.
CHUNK_KEYS = 1 << 20


def time_chunk(order_cols: list[str]) -> Column:
    """Default chunk: the hour of the first order column. Times that stand
    exactly on the hour (daily samples) may be many, so they are cut further
    by ranges of the second order column (an integer). The struct sorts as
    the rows do."""
    at = F.col(order_cols[0])
    hour = F.date_trunc("HOUR", at)
    exact = at.cast("timestamp") == hour
    key = F.when(exact, F.floor(F.col(order_cols[1]) / F.lit(CHUNK_KEYS))) if len(order_cols) > 1 \
        else F.lit(None).cast("long")
    return F.struct(hour.alias("h"), (~exact).alias("late"), key.alias("k"))


def _large(df: DataFrame, part: str) -> Column:
    """Whether a row's tenant has more than ``TENANT_ROWS`` rows. Of these
    tenants there is at most one per ``TENANT_ROWS`` rows of the table; they
    are counted when this is called."""
    n = df.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    large = [r[0] for r in n.filter(F.col("_n") > TENANT_ROWS).collect()]
    known = F.coalesce(F.col(part).isin([k for k in large if k is not None]), F.lit(False))
    return known | F.col(part).isNull() if None in large else known


def _last(a: Column, k: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - F.lit(k - 1), F.lit(1)), F.lit(k))


# Preceding rows that are read one by one; more are collected anew for each row.
LAGS = 16


def _preceding(w, k: int) -> Column:
    """The ``_v`` of up to ``k`` rows before, oldest first."""
    if k > LAGS:
        return F.collect_list("_v").over(w.rowsBetween(-k, -1))
    n = F.least(F.row_number().over(w) - 1, F.lit(k))
    return F.slice(F.array(*[F.lag("_v", i).over(w) for i in range(k, 0, -1)]), k + 1 - n, n)


def with_preceding(df: DataFrame, part: str, order_cols: list[str], values: list[str], k: int,
                   chunk: Column | None = None, out: str = "_prev") -> DataFrame:
    """Add ``out``: the ``values`` (an array of structs) of up to ``k`` rows
    that precede the row in its group's order, oldest first. ``chunk`` must
    sort as ``order_cols`` do; the default chunks of a large tenant lie within
    months, and a year of any other tenant is one chunk."""
    coarse = F.lit(0)
    if chunk is None:
        large, year = _large(df, part), F.date_trunc("YEAR", order_cols[0])
        coarse = F.when(large, F.date_trunc("MONTH", order_cols[0])).otherwise(year)
        chunk = F.when(large, time_chunk(order_cols)).otherwise(
            F.struct(year.alias("h"), F.lit(False).alias("late"), F.lit(None).cast("long").alias("k")))
    t = (df.withColumn("_g", F.struct(part)).withColumn("_m", F.struct(coarse.alias("m")))
         .withColumn("_c", F.struct(chunk.alias("c")))
         .withColumn("_v", F.struct(*values)))
    w = Window.partitionBy("_g", "_c").orderBy(*order_cols)
    own = t.withColumn("_own", _preceding(w, k))
    # The last k rows of each chunk, oldest first; a task ships no more of a chunk.
    back = F.row_number().over(Window.partitionBy("_g", "_c").orderBy(*[F.desc(c) for c in order_cols]))
    tails = (t.withColumn("_back", back).filter(F.col("_back") <= k).groupBy("_g", "_m", "_c")
             .agg(F.sort_array(F.collect_list(F.struct("_back", "_v")), asc=False).alias("_t"))
             .select("_g", "_m", "_c", F.col("_t")["_v"].alias("_t")))
    before = lambda w: _last(F.flatten(F.collect_list("_t").over(w.rowsBetween(-k, -1))), k)
    month = Window.partitionBy("_g", "_m").orderBy("_c")
    inner = tails.select("_g", "_m", "_c", "_t", before(month).alias("_in"), F.lead(F.lit(True)).over(month).alias("_more"))
    months = inner.filter(F.col("_more").isNull()).select("_g", "_m", _last(F.concat("_in", "_t"), k).alias("_t"))
    above = months.select("_g", "_m", before(Window.partitionBy("_g").orderBy("_m")).alias("_before"))
    halo = inner.join(above, ["_g", "_m"]).select("_g", "_c", _last(F.concat("_before", "_in"), k).alias("_halo"))
    return (own.join(halo, ["_g", "_c"])
            .withColumn(out, _last(F.concat("_halo", "_own"), k))
            .drop("_g", "_m", "_c", "_v", "_own", "_halo"))


def size_growth(stats: DataFrame, order_cols: list[str] | None = None,
                chunk: Column | None = None) -> DataFrame:
    """For each sample, the previous sample of the same tenant and the
    change, whole days between them and bytes per day (NULL on the same
    day)."""
    order_cols = stats_order(stats, order_cols)
    t = with_preceding(stats, "database_id", order_cols, ["size_bytes", "recorded_at"], 1, chunk)
    prev = F.try_element_at("_prev", F.lit(1))
    t = t.withColumn("prev_size", prev["size_bytes"]).withColumn("prev_at", prev["recorded_at"])
    days = F.datediff(F.to_date("recorded_at"), F.to_date("prev_at"))
    keep = list(dict.fromkeys([*(c for c in order_cols if c != "database_id"), "size_bytes", "recorded_at"]))
    return t.select(
        "database_id", *keep, "prev_size", "prev_at",
        (F.col("size_bytes") - F.col("prev_size")).alias("size_change"),
        days.alias("days"),
        F.when(days > 0, F.round((F.col("size_bytes") - F.col("prev_size")) / days, 4))
         .alias("bytes_per_day"))


def rolling_connections(stats: DataFrame, rows: int = 7, order_cols: list[str] | None = None,
                        chunk: Column | None = None) -> DataFrame:
    """Mean and peak of active connections over the last ``rows``
    samples of the tenant (the current one included; NULLs are samples
    without a value)."""
    if rows < 2:
        raise ValueError("rows must be at least 2")
    order_cols = stats_order(stats, order_cols)
    t = with_preceding(stats, "database_id", order_cols, ["active_connections"], rows - 1, chunk)
    t = t.withColumn("_all", F.concat(F.col("_prev")["active_connections"], F.array("active_connections")))
    known = F.filter("_all", lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select("database_id", *[c for c in order_cols if c != "database_id"], "active_connections",
                    F.round(F.try_divide(total.cast("double"), F.size(known)), 4).alias("rolling_avg"),
                    F.array_max("_all").alias("rolling_max"),
                    F.size("_all").cast("long").alias("window_rows"))


def chat_history(turns: DataFrame, n: int, session: str = "conv_id",
                 order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation, one row per turn.
    ``row_number() <= n`` gets a partial group limit before the shuffle, so
    a huge conversation ships at most ``n`` rows per map task."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return (turns.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= n).drop("_r"))


def chat_history_arrays(turns: DataFrame, n: int, session: str = "conv_id",
                        order: str = "turn") -> DataFrame:
    """R68, collected form: per conversation an array of its last ``n``
    turns in turn order (bounded by ``n``)."""
    last = chat_history(turns, n, session, order)
    fields = [c for c in turns.columns if c != session]
    return (last.groupBy(session)
            .agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order])))
                 .alias("history")))
