"""Versioned tables: several tables change together, or not at all.

Parquet has no row-level transaction, so a change writes its rows to new
directories and then publishes one small pointer file that names, for every
table, the directories that make up the new version:

    {root}/data/{job}-{attempt}/{table}/...     rows, never changed afterwards
    {root}/_versions/000000000007.json          version 7: base, job, tables

A version number is taken by creating its file where none may exist yet, so of
two writers that started from one version a single one wins; the other is
refused (``StaleVersion``) and starts again from the winner's state. Whatever a
failed writer left under ``data`` is named by no pointer and seen by no reader.
A pointer names its job: running a job again returns the version that it made.

A table may be dealt by day. Its parts then list their days, so that old days
are dropped by not naming them any more: nothing of them is read or deleted.

Local folders take a version with a hard link, other stores with Hadoop's
rename that refuses to overwrite (atomic on HDFS; object stores without an
atomic rename need a committer that brings one).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's name of a null partition value
DAY = "day"


class StaleVersion(Exception):
    """The version that a change started from is no longer the newest."""


class VersionedTables:
    """The tables under ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: fs.Path(f"{self.root}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"

    # --- pointers ------------------------------------------------------------
    def version(self) -> int:
        """The newest version; 0 before the first."""
        folder = self._path("_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def pointer(self, version: int) -> dict:
        if not version:
            return {"version": 0, "base": None, "job": None, "tables": {}}
        stream = self._fs.open(self._path(f"_versions/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def made_by(self, job: str) -> int | None:
        """The version that a job made, newest first."""
        for v in range(self.version(), 0, -1):
            if self.pointer(v)["job"] == job:
                return v
        return None

    def _publish(self, pointer: dict) -> None:
        name = f"_versions/{pointer['version']:012d}.json"
        draft = self._path(f"_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        try:
            if self._local:
                os.link(draft.toUri().getPath(), self._path(name).toUri().getPath())
            else:
                jvm = self.spark._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri()).rename(draft, self._path(name), none)
        except Exception as e:
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e):
                raise StaleVersion(f"version {pointer['version']} was taken by another job") from None
            raise
        finally:
            self._fs.delete(draft, False)

    # --- reading -------------------------------------------------------------
    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest if not given)."""
        entry = self.pointer(self.version() if version is None else version)["tables"][table]
        return self._read(entry).drop(*([DAY] if entry["by_day"] else []))

    def between(self, table: str, first: str, last: str, version: int | None = None) -> DataFrame:
        """The rows of a table dealt by day whose time lies in [first, last):
        other days are not read."""
        entry = self.pointer(self.version() if version is None else version)["tables"][table]
        lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (first, last))
        ts = F.col(entry["by_day"])
        return self._read(entry).where(F.col(DAY).between(F.to_date(lo), F.to_date(hi))).where((ts >= lo) & (ts < hi)).drop(DAY)

    def _read(self, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["by_day"]:
            paths = [f"{self.root}/{p['path']}" for p in entry["parts"]]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        schema = T.StructType([*schema, T.StructField(DAY, T.DateType())])
        out = self.spark.createDataFrame([], schema)
        for p in entry["parts"]:
            if p["days"]:
                base = f"{self.root}/{p['path']}"
                part = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{DAY}={d}" for d in p["days"]])
                out = out.unionByName(part)
        return out

    # --- writing -------------------------------------------------------------
    def _write(self, df: DataFrame, path: str, by_day: str | None) -> dict:
        if not by_day:
            df.write.parquet(f"{self.root}/{path}")
            return {"path": path}
        # A day with very many rows is split over tasks, small days share one.
        df.withColumn(DAY, F.to_date(by_day)).hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{self.root}/{path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
        return {"path": path, "days": sorted(n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}="))}

    def commit(self, job: str, base: int, replace: dict[str, DataFrame] | None = None,
               append: dict[str, DataFrame] | None = None, by_day: dict[str, str] | None = None) -> int:
        """Publish version ``base + 1``: the tables of ``base`` with those of
        ``replace`` written anew and the rows of ``append`` added (in the table's
        columns; missing ones are null). ``by_day`` names the time column of
        tables to deal by day; a table keeps its layout. Raises ``StaleVersion``
        if ``base`` is not the newest version, before or after the rows are written; a job that
        has made a version before only returns it."""
        if (made := self.made_by(job)) is not None:
            return made
        if self.version() != base:
            raise StaleVersion(f"{job} started from version {base}; the newest is {self.version()}")
        tables, folder = dict(self.pointer(base)["tables"]), f"data/{job}-{uuid.uuid4().hex[:12]}"
        for name, df in (replace or {}).items():
            day = (by_day or {}).get(name) or tables.get(name, {}).get("by_day")
            part = self._write(df, f"{folder}/{name}", day)
            tables[name] = {"schema": _nullable(df.schema).jsonValue(), "by_day": day, "parts": [part]}
        for name, df in (append or {}).items():
            entry = tables[name]
            schema = T.StructType.fromJson(entry["schema"])
            rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
            part = self._write(rows, f"{folder}/{name}-more", entry["by_day"])
            tables[name] = {**entry, "parts": [*entry["parts"], part]}
        return self._next(job, base, tables)

    def _next(self, job: str, base: int, tables: dict) -> int:
        self._fs.mkdirs(self._path("_versions"))
        if self.version() != base:
            raise StaleVersion(f"{job} started from version {base}; the newest is {self.version()}")
        self._publish({"version": base + 1, "base": base, "job": job, "tables": tables})
        return base + 1

    def change(self, job: str, make: Callable[[Callable[[str], DataFrame]], dict], tries: int = 5) -> int:
        """Commit what ``make(read)`` returns (``replace`` and ``append``), made
        anew from the newest version if another job came first."""
        for left in reversed(range(tries)):
            base = self.version()
            try:
                if (made := self.made_by(job)) is not None:
                    return made
                return self.commit(job, base, **make(lambda name, v=base: self.read(name, v)))
            except StaleVersion:
                if not left:
                    raise
        raise ValueError("tries must be at least 1")

    def expire(self, job: str, table: str, cutoff: str) -> int:
        """R18 for a table dealt by day: drop rows before ``cutoff`` (rows
        without a time stay). Whole days before it are no longer named, unread;
        the day that it falls into is rewritten; later days stay as they are."""
        if (made := self.made_by(job)) is not None:
            return made
        base = self.version()
        tables = dict(self.pointer(base)["tables"])
        entry = tables[table]
        if not entry["by_day"]:
            raise ValueError(f"{table} is not dealt by day")
        boundary = cutoff[:10]
        keep = lambda test: [{"path": p["path"], "days": [d for d in p["days"] if test(d)]} for p in entry["parts"]]
        parts = keep(lambda d: d == NULL_DAY or d > boundary)
        edge = [p for p in keep(lambda d: d == boundary) if p["days"]]
        if edge:
            rows = self._read({**entry, "parts": edge}).where(F.col(entry["by_day"]) >= F.lit(cutoff).cast("timestamp_ntz")).drop(DAY)
            parts.append(self._write(rows, f"data/{job}-{uuid.uuid4().hex[:12]}/{table}", entry["by_day"]))
        tables[table] = {**entry, "parts": [p for p in parts if p["days"]]}
        return self._next(job, base, tables)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
