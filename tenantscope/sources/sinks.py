"""Sinks: dated backups, ordered rule files, JSON exports.

Every writer fails rather than overwrite (``errorifexists``) unless told
otherwise, and writes through Spark's committer, so a lost executor only
re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tenantscope.operators.access import rules_text


def backup_snapshot(dfs: dict[str, DataFrame], out_dir: str, as_of: str,
                    compression: str = "gzip") -> str:
    """Write each table under ``{out_dir}/{yyyyMMdd_HHmmss}/{table}``,
    compressed; an existing snapshot directory is an error."""
    stamp = as_of.replace("-", "").replace(":", "").replace(" ", "_")[:15]
    base = f"{out_dir.rstrip('/')}/{stamp}"
    for name, df in dfs.items():
        df.write.mode("errorifexists").option("compression", compression).parquet(f"{base}/{name}")
    return base


def write_rules(rules: DataFrame, out_dir: str, num_files: int | None = None,
                mode: str = "errorifexists") -> None:
    """The access rules as text in file order (database_name, rule_no)
    with per-tenant header lines. Range partitioning keeps the part files
    in global order and splits a tenant with very many rules over several
    files; each file is sorted within itself."""
    lines = rules_text(rules)
    n = num_files or max(1, lines.sparkSession.sparkContext.defaultParallelism)
    (lines.repartitionByRange(n, "database_name", "rule_no")
     .sortWithinPartitions("database_name", "rule_no")
     .select("line").write.mode(mode).text(out_dir))


def export_json(df: DataFrame, out_dir: str, mode: str = "errorifexists") -> int:
    """Write a listing as JSON lines and return its row count, counted
    by an ``Observation`` during the same write (no second pass)."""
    obs = Observation("export")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(out_dir)
    return int(obs.get["rows"])
