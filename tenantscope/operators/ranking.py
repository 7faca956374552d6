"""Skew-safe positions within groups.

A plain ``row_number().over(Window.partitionBy(tenant))`` sends every row of
a tenant to one task; a tenant that owns a third of all rows then sorts a
third of the data alone. Here every group is split into chunks of an integer
order key: rows are numbered inside ``(group, chunk)`` (bounded by the
chunk width), and each chunk's offset comes from a prefix sum over the
per-chunk counts. Where the keys are spread so widely that a group may have
more than ``FAN`` chunks, that sum is a tree: counts of ``FAN`` neighbouring
chunks are added up, level by level, and the offsets go down again, so no
window holds more than ``FAN`` rows. The result is exactly the plain row
number, for every group and whatever its size.

Group and chunk are kept as structs: a struct is never NULL itself, so NULL
keys stay a group (or a chunk) of their own through the equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1 << 16
#: Neighbouring chunks (or nodes of the tree) that one window adds up.
FAN = 1 << 12


def _levels(chunks: int) -> int:
    """Levels of the tree above ``chunks`` consecutive chunks."""
    n = 0
    while chunks > FAN:
        chunks, n = chunks // FAN + 2, n + 1
    return n


def _offsets(sizes: DataFrame, levels: int) -> DataFrame:
    """``_g, _c, _off, _total`` of ``sizes`` (_g, _c, _n): the sum of ``_n`` over
    the group's earlier chunks, and over all."""
    if not levels:
        group = Window.partitionBy("_g").orderBy("_c")
        return sizes.select(
            "_g", "_c", F.coalesce(F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
            F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    below = sizes.withColumn("_p", F.struct("_c.n", F.floor(F.col("_c.c") / F.lit(FAN)).alias("c")))
    above = _offsets(below.groupBy("_g", "_p").agg(F.sum("_n").alias("_n")).withColumnRenamed("_p", "_c"), levels - 1)
    inner = Window.partitionBy("_g", "_p").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    return (below.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
            .join(above.select("_g", F.col("_c").alias("_p"), F.col("_off").alias("_base"), "_total"), ["_g", "_p"])
            .select("_g", "_c", (F.col("_base") + F.col("_in")).alias("_off"), "_total"))


def row_number_within(df: DataFrame, part_cols: list[str], order_col: str,
                      out: str = "rn", chunk_width: int = DEFAULT_CHUNK,
                      descending: bool = False, total: str | None = None,
                      span: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of the row inside ``part_cols`` ordered
    by the integer column ``order_col`` (unique within a group; NULLs first,
    last when ``descending``), and, if named, ``total`` = rows of the group.
    ``span``: a cheaper table and column of that name that covers the keys, from
    which their range is read (two numbers)."""
    b = (span if span is not None else df).agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    levels = _levels(((b["hi"] or 0) - (b["lo"] or 0)) // chunk_width + 2)
    key = F.col(order_col)
    chunk = F.floor(key / F.lit(chunk_width))
    chunk = F.struct(key.isNull().cast("int").alias("n"), (-chunk).alias("c")) if descending \
        else F.struct(key.isNotNull().cast("int").alias("n"), chunk.alias("c"))
    w = Window.partitionBy("_g", "_c").orderBy(key.desc() if descending else key)
    local = (df.withColumn("_g", F.struct(*part_cols)).withColumn("_c", chunk)
             .withColumn("_local", F.row_number().over(w)))
    # Sizes come from the numbered rows: the aggregate and the join below
    # reuse the window's (group, chunk) partitioning, so the input is
    # computed and shuffled once.
    sizes = local.groupBy("_g", "_c").agg(F.max("_local").alias("_n"))
    offsets = _offsets(sizes, levels)
    res = local.join(offsets, ["_g", "_c"], "inner").withColumn(out, (F.col("_off") + F.col("_local")).cast("int"))
    if total:
        res = res.withColumn(total, F.col("_total").cast("int"))
    return res.drop("_g", "_c", "_local", "_off", "_total")

