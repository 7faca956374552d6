"""Constraint checks, drift reports and cascading deletes as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str = "id") -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row."""
    p = parent.select(F.col(pk).alias("_pk"))
    c = child.filter(F.col(fk).isNotNull())
    return c.join(p, c[fk] == p["_pk"], "left_anti")


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key values held by more than one row. NULLs never clash, as in
    SQL UNIQUE. Partial aggregation merges a hot key before the shuffle."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return (df.filter(cond).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1))


def column_violations(df: DataFrame, table: str, not_null: list[str],
                      max_len: dict[str, int]) -> DataFrame:
    """NOT NULL and VARCHAR(n) violations per column in one aggregate
    pass, returned in long form (table, column, rule, violations)."""
    aggs, keys = [], []
    for c in not_null:
        if c in df.columns:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"nn__{c}"))
            keys.append((c, "not_null", f"nn__{c}"))
    for c, n in max_len.items():
        if c in df.columns:
            aggs.append(F.count_if(F.char_length(F.col(c).cast("string")) > n).alias(f"len__{c}"))
            keys.append((c, f"max_length_{n}", f"len__{c}"))
    if not aggs:
        raise ValueError("no checked column present")
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"),
                                           F.col(k).cast("bigint").alias("violations"))
                                  for c, r, k in keys])).alias("v")
    return wide.select(stacked).select(F.lit(table).alias("table"), "v.column", "v.rule",
                                       "v.violations")


def registry_drift(db: DataFrame, catalog: DataFrame) -> DataFrame:
    """Registry rows with no server database and server databases with
    no registry row (templates excluded), via one full outer join on name."""
    r = db.select(F.col("database_name").alias("_r"), F.col("id").alias("database_id"))
    c = catalog.filter(~F.coalesce(F.col("datistemplate"), F.lit(False))) \
               .select(F.col("datname").alias("_c"), "size_bytes")
    j = r.join(c, r["_r"] == c["_c"], "full_outer")
    return (j.filter(F.col("_r").isNull() | F.col("_c").isNull())
            .select(F.coalesce("_r", "_c").alias("database_name"), "database_id", "size_bytes",
                    F.when(F.col("_c").isNull(), "missing_on_server")
                     .otherwise("missing_in_registry").alias("drift")))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame,
                   id_col: str = "id", as_of: str | None = None,
                   registry: str = "databases") -> dict[str, DataFrame]:
    """Delete the given tenants and cascade to the child tables.

    ``tables`` maps a name to (DataFrame, key column referencing the
    tenant id); the registry itself is one of them with key ``id``. Audit
    rows are not in the cascade (their ``resource_id`` has no foreign key).
    Returns the remaining rows per table and ``counts`` (table, deleted,
    remaining), each count one aggregate over a left join with a flag, and,
    where the ``registry`` table is among them, ``audit``: one
    ``database_deleted`` row per tenant deleted (R51).
    """
    from tenantscope.operators.audit import audit_rows
    keys = ids.select(F.col(id_col).alias("_del_id")).distinct().withColumn("_del", F.lit(True))
    out, counts = {}, []
    for name, (df, fk) in tables.items():
        flagged = df.join(keys, df[fk] == keys["_del_id"], "left")
        gone = F.coalesce(F.col("_del"), F.lit(False))
        out[name] = flagged.filter(~gone).drop("_del_id", "_del")
        if name == registry:
            out["audit"] = audit_rows(flagged.filter(gone), "database_deleted", "id",
                                      {"database_name": "database_name", "username": "username"}, as_of)
        counts.append(flagged.agg(F.lit(name).alias("table"),
                                  F.count_if(gone).alias("deleted"),
                                  F.count_if(~gone).alias("remaining")))
    out["counts"] = reduce(DataFrame.unionByName, counts)
    return out
