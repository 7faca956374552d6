"""Connected components of an edge table, by alternating stars in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u long, v long)``: the smallest
    node of its component.

    Each round hangs every node's larger neighbours, then all its smaller ones,
    under the smallest node it knows, which shortens any path by a constant
    factor; it ends when the edges no longer change. A round is checkpointed, so
    a lost executor repeats one round at most. Minima are partial aggregates,
    and a hub's edges are joined by a key that Spark can split.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    while True:
        n = both(e)
        least = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = n.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
