"""Totals over the subtrees of a forest, by centroid decomposition.

A forest is a table of parent edges. Each round takes every component apart at
its centroid, the deepest node whose subtree holds more than half of it: the
subtrees of the centroid's children and what is left above it are components of
at most half the size. What hangs under the centroid is added up to one
*component total*, and this total is added to each node on the path from the
centroid to the component's top. A node's total is what it received that way and
the component total of the round in which it is the centroid itself. So a chain
of n nodes takes log n rounds, not n, and a node gets at most log n additions.

No path is walked: the nodes whose subtree holds more than half of a component
are exactly the path from its centroid to its top.

Components of up to ``local_nodes`` nodes are finished inside a task, by the
same recursion on arrays, many at a time. Larger ones go round by round as
tables in the shared folder, where a hot component is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope.session import shared_path

#: Nodes of a component that one task finishes.
LOCAL_NODES = 1024
#: Nodes that a task works on at a time.
BATCH_NODES = 1 << 18


class _Tables:
    """Numbered tables of one job in the shared folder."""

    def __init__(self, spark, name: str):
        self.spark, self.path, self.n = spark, shared_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n:03d}")
        return self.spark.read.parquet(f"{self.path}/{self.n:03d}")


def _sized(forest: DataFrame, values: list[str], tables: _Tables) -> DataFrame:
    """``node, parent, top, size, total`` and the values: the root of each node,
    the nodes in its subtree and in its tree. Ancestors are found by doubling: after k
    rounds ``size`` counts the descendants less than 2**k edges below."""
    s = forest.select("node", F.col("parent").alias("up"), F.col("node").alias("top"), F.lit(1).cast("long").alias("size"))
    while True:
        s = tables.keep(s)
        if s.where("up is not null").isEmpty():
            break
        add = s.where("up is not null").groupBy("up").agg(F.sum("size").alias("more")).withColumnRenamed("up", "node")
        s = s.join(add, "node", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        above = tables.keep(s)
        jump = above.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("top").alias("above"))
        s = above.where("up is not null").join(jump, "up").select("node", F.col("next").alias("up"), F.col("above").alias("top"), "size") \
            .unionByName(above.where("up is null"))
    total = s.where("node = top").select("top", F.col("size").alias("total"))
    return forest.select("node", "parent", *values).join(s.select("node", "top", "size"), "node").join(total, "top")


def _round(parts: DataFrame, values: list[str], tables: _Tables) -> tuple[DataFrame, DataFrame]:
    """Split every component at its centroid: the components that are left, and
    the centroids with their totals."""
    path = F.expr("2 * size > total")
    centroid = parts.where(path).groupBy("top").agg(F.min_by("node", "size").alias("c"), F.min("size").alias("c_size"))
    b = parts.join(centroid, "top")
    # The nearest of top, centroid and centroid's children at or above a node is
    # the top of the component that it goes to.
    mark = F.col("node").eqNullSafe(F.col("top")) | (F.col("node") == F.col("c")) | F.col("parent").eqNullSafe(F.col("c"))
    b = tables.keep(b.withColumn("to", F.when(mark, F.col("node"))).withColumn("to_size", F.when(mark, F.col("size")))
                    .withColumn("up", F.when(~mark, F.col("parent"))))
    known = b.select("node", "to", "to_size", "up")
    while not known.where("to is null").isEmpty():
        there = known.select(F.col("node").alias("up"), F.col("to").alias("t"), F.col("to_size").alias("t_size"), F.col("up").alias("next"))
        known = tables.keep(known.where("to is null").join(there, "up").select("node", F.col("t").alias("to"), F.col("t_size").alias("to_size"), F.col("next").alias("up"))
                            .unionByName(known.where("to is not null")))
    b = b.drop("to", "to_size", "up").join(known.select("node", "to", "to_size"), "node")
    under = (F.col("to") != F.col("top")) | (F.col("c") == F.col("top"))
    b = tables.keep(b.withColumn("under", under))
    totals = b.where("under").groupBy("top").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    b = b.join(totals, "top").withColumn("gets", path & ~F.col("under"))
    b = tables.keep(b.select(
        "node", "parent", "c", "to", F.when(F.col("under"), F.col("to_size")).otherwise(F.col("total") - F.col("c_size")).alias("total"),
        F.when(F.col("gets"), F.col("size") - F.col("c_size")).otherwise(F.col("size")).alias("size"), *values,
        *[F.when(F.col("gets") | (F.col("node") == F.col("c")), F.col(f"got_{v}") + F.col(f"t_{v}")).otherwise(F.col(f"got_{v}")).alias(f"got_{v}")
          for v in values]))
    done = b.where("node = c").select("node", *[F.col(f"got_{v}").alias(v) for v in values])
    rest = b.where("node <> c").select("node", "parent", F.col("to").alias("top"), "size", "total", *values, *[f"got_{v}" for v in values])
    return rest, done


def decompose(parent: np.ndarray, top: np.ndarray, size: np.ndarray, values: np.ndarray, got: np.ndarray) -> np.ndarray:
    """Totals of the nodes of whole components: ``parent`` and ``top`` are row
    numbers (a top's parent does not matter), ``values`` and ``got`` (what came
    from below already) have a column for each value."""
    size, top, out = size.copy(), top.copy(), got.copy()
    rows = np.arange(len(parent))
    while len(rows):
        total = size[top[rows]]
        path = rows[2 * size[rows] > total]
        c = np.full(len(parent), -1)
        path = path[np.argsort(-size[path], kind="stable")]
        c[top[path]] = path                   # the smallest comes last
        own = c[top[rows]]
        if (own < 0).any():
            raise ValueError("no forest, or sizes that are not those of its subtrees")
        jump = np.full(len(parent), -1)
        jump[rows] = np.where((rows == top[rows]) | (rows == own) | (parent[rows] == own), rows, parent[rows])
        while True:
            step = jump[jump[rows]]
            if (step == jump[rows]).all():
                break
            jump[rows] = step
        to = jump[rows]
        under = (to != top[rows]) | (own == top[rows])
        t = np.zeros_like(values)
        np.add.at(t, top[rows[under]], values[rows[under]])
        gets = path[path != c[top[path]]]
        out[gets] += t[top[gets]]
        size[gets] -= size[c[top[gets]]]
        centre = np.unique(own)
        out[centre] += t[top[centre]]
        top[rows] = to
        rows = rows[rows != own]
    return out


def _finish(parts: DataFrame, values: list[str], batch_nodes: int) -> DataFrame:
    """``decompose`` for components that fit a task."""
    columns = ["node", "parent", "top", "size", *values, *[f"got_{v}" for v in values]]

    def solve(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_numpy()
        order = np.argsort(node)
        row = lambda ids: order[np.searchsorted(node[order], ids)]
        parent, top = t.column("parent").to_numpy(), t.column("top").to_numpy()
        parent = np.where(node == top, node, parent).astype(np.int64)
        matrix = lambda names: np.stack([t.column(c).to_numpy() for c in names], 1)
        out = decompose(row(parent), row(top), t.column("size").to_numpy(), matrix(values), matrix([f"got_{v}" for v in values]))
        return pa.record_batch([node, *out.T], names=["node", *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            held = pa.concat_tables([held, b]) if held else b
            if held.num_rows >= batch_nodes:
                tops = held.column("top").to_numpy()
                cut = int(np.searchsorted(tops, tops[-1]))  # the last component may go on
                if cut:
                    yield solve(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut).combine_chunks()
        if held:
            yield solve(held.combine_chunks())

    src = parts.select(*columns).repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "top").sortWithinPartitions("top")
    return src.mapInArrow(run, "node long, " + ", ".join(f"{v} long" for v in values))


def subtree_totals(forest: DataFrame, values: list[str], *, local_nodes: int = LOCAL_NODES,
                   batch_nodes: int = BATCH_NODES) -> DataFrame:
    """``node`` and, for each of ``values`` (long columns without nulls), its sum
    over the node's subtree, the node included.

    ``forest``: a stored table (it is read several times) with one row per node,
    ``node long`` (unique) and ``parent long`` (null for a root; any other
    parent is a node of the table). An empty forest gives no row.
    """
    tables = _Tables(forest.sparkSession, "centroid")
    parts = tables.keep(_sized(forest, values, tables).withColumns({f"got_{v}": F.lit(0).cast("long") for v in values}))
    small, done = [], []
    while True:
        small.append(parts.where(F.col("total") <= local_nodes))
        parts = parts.where(F.col("total") > local_nodes)
        if parts.isEmpty():
            break
        parts, totals = _round(parts, values, tables)
        done.append(totals)
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s, allowMissingColumns=True)
    out = _finish(rest, values, batch_nodes)
    for d in done:
        out = out.unionByName(d.select("node", *[F.col(v).cast("long") for v in values]))
    return out
