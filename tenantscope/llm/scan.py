"""Running numbers within the groups of a sorted table.

A table is sorted over all partitions by group and order, so that a group of any
size is spread over as many partitions as it needs. Each task numbers the rows of
its groups and carries running sums; only a group that is cut by the bound of a
partition needs an offset, which is at most one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenantscope.session import shared_path

#: Running sums are modulo 2**61: two of them, and an offset, fit a long.
MASK = (1 << 61) - 1


def running(df: DataFrame, key: str, order: list[str], sums: list[str] = (), place: str = "place") -> DataFrame:
    """``df`` with ``place`` (1-based, within the rows of one ``key``, a long
    that is not null, ordered by ``order``, nulls first) and, in place of each
    column of ``sums`` (longs from 0 to ``MASK``), its running sum modulo 2**61,
    the row's own value included. Rows that tie in ``order`` are numbered in any
    order. The result is a table in the shared folder."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    src = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    names = [*df.columns, "_part", place]
    schema = T.StructType([*df.schema, T.StructField("_part", T.LongType()), T.StructField(place, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seen, carry = TaskContext.get().partitionId(), None, 0, np.zeros(len(sums), np.uint64)
        for b in batches:
            if not len(b):
                continue
            keys = b.column(b.schema.get_field_index(key)).to_numpy()
            first = np.append(keys[0] != held, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(b)), -1))  # -1: the group came before
            at = np.arange(len(b)) - start + np.where(start < 0, seen - 1, 0) + 1
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for k, c in enumerate(sums):
                own = columns[c].to_numpy().astype(np.uint64)
                total = np.append(np.uint64(0), np.cumsum(own, dtype=np.uint64))
                total = total[1:] - np.where(start < 0, np.uint64(0) - carry[k], total[np.maximum(start, 0)])
                total &= np.uint64(MASK)
                columns[c], carry[k] = pa.array(total.astype(np.int64)), total[-1]
            held, seen = keys[-1], int(at[-1])
            yield pa.record_batch([*columns.values(), pa.array(np.full(len(b), part, np.int64)), pa.array(at.astype(np.int64))], names=names)

    path = shared_path(spark, "running")
    src.mapInArrow(number, schema).write.parquet(f"{path}-parts")
    rows = spark.read.parquet(f"{path}-parts")
    ends = rows.groupBy(key, "_part").agg(F.max(place).alias("n"), *[F.max_by(c, place).alias(c) for c in sums])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).over(before)
    cut = ends.select(key, "_part", F.sum("n").over(before).alias("_off"),
                      *[F.pmod(total(c), F.lit(MASK + 1)).cast("long").alias(f"_off_{i}") for i, c in enumerate(sums)]).where("_off is not null")
    cut.write.parquet(f"{path}-cut")
    # At most one row a partition: the group that the one before it began.
    cut = F.broadcast(spark.read.parquet(f"{path}-cut"))
    whole = rows.join(cut, [key, "_part"], "left")
    added = {c: (F.col(c) + F.coalesce(F.col(f"_off_{i}"), F.lit(0))).bitwiseAND(F.lit(MASK)) for i, c in enumerate(sums)}
    return whole.select(*[added.get(c, F.col(c)).alias(c) for c in df.columns], (F.col(place) + F.coalesce("_off", F.lit(0))).alias(place))
