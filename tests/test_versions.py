"""Versioned tables: commit, failure, retry, competing writers, days."""

import glob
import json
import os
import threading

import pytest
from conftest import SF_SMALL, plan_text
from pyspark.sql import functions as F
from tenantscope.operators import changes
from tenantscope.sources.fixtures import AS_OF, Fleet
from tenantscope.sources.versions import StaleVersion, VersionedTables


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string")


@pytest.fixture
def store(spark, tmp_path):
    s = VersionedTables(spark, str(tmp_path / "store"))
    assert s.version() == 0
    assert s.commit("load", 0, {"a": table(spark, [(1, "x"), (2, "y")]), "log": table(spark, [(1, "loaded")])}) == 1
    return s


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables_change_together_and_old_versions_stay(spark, store):
    assert store.commit("second", 1, {"a": store.read("a").where("id > 1")}, {"log": table(spark, [(2, "removed")])}) == 2
    assert rows(store.read("a")) == [(2, "y")] and rows(store.read("log")) == [(1, "loaded"), (2, "removed")]
    assert rows(store.read("a", 1)) == [(1, "x"), (2, "y")] and rows(store.read("log", 1)) == [(1, "loaded")]
    # Appended rows take the table's columns.
    store.commit("third", 2, append={"log": spark.createDataFrame([("wide", 5)], "name string, id int").withColumn("more", F.lit(1))})
    store.commit("fourth", 3, append={"log": spark.createDataFrame([(9,)], "id long")})
    assert rows(store.read("log").where("id in (5, 9)")) == [(5, "wide"), (9, None)]


def test_failed_write_is_seen_by_nobody(spark, store):
    bad = store.read("a").withColumn("name", F.raise_error(F.lit("lost executor")).cast("string"))
    for kw in ({"replace": {"log": table(spark, []), "a": bad}}, {"append": {"log": table(spark, [(7, "half")]), "a": bad}}):
        with pytest.raises(Exception, match="lost executor"):
            store.commit("broken", 1, **kw)
    assert store.version() == 1 and rows(store.read("a")) == [(1, "x"), (2, "y")] and rows(store.read("log")) == [(1, "loaded")]
    assert store.commit("broken", 1, append={"log": table(spark, [(7, "whole")])}) == 2
    assert rows(store.read("log")) == [(1, "loaded"), (7, "whole")]


def test_a_job_that_runs_again_changes_nothing(spark, store):
    more = lambda read: {"append": {"a": table(spark, [(3, "z")])}}
    assert store.change("once", more) == 2 and store.change("other", more) == 3
    assert store.change("once", more) == 2 and store.commit("once", 1, {"a": table(spark, [])}) == 2
    assert store.version() == 3 and len(rows(store.read("a"))) == 4


def test_a_writer_whose_base_has_moved_is_refused(spark, store):
    store.commit("first", 1, append={"a": table(spark, [(3, "z")])})
    with pytest.raises(StaleVersion):
        store.commit("late", 1, {"a": table(spark, [])})
    # Moved while the rows were written: the version's file is there already.
    with pytest.raises(StaleVersion):
        store._publish({"version": 2, "base": 1, "job": "late", "tables": {}})
    assert store.pointer(2)["job"] == "first" and len(rows(store.read("a"))) == 3
    left = [n for n in os.listdir(f"{store.root}/_versions") if n.startswith(".") and not n.endswith(".crc")]
    assert not left


def test_competing_writers_both_get_through_in_turn(spark, store):
    done, gate = {}, threading.Barrier(2)

    def run(job):
        def make(read):
            seen = read("a").agg(F.max("id")).first()[0]
            if job not in done:
                done[job] = None
                gate.wait(60)  # both have read version 1
            return {"append": {"a": table(spark, [(seen + 1, job)])}}
        done[job] = store.change(job, make)

    threads = [threading.Thread(target=run, args=(j,)) for j in ("p", "q")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(done.values()) == [2, 3]
    assert [r[0] for r in rows(store.read("a"))] == [1, 2, 3, 4]  # nobody's row is lost or doubled


def test_days(spark, tmp_path):
    s = VersionedTables(spark, str(tmp_path / "s"))
    ts = ["2024-01-01 05:00:00", "2024-01-02 23:59:59", "2024-01-03 11:59:59", "2024-01-03 12:00:00", "2024-01-04 00:00:00", None]
    df = spark.createDataFrame(list(enumerate(ts)), "id long, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    s.commit("load", 0, {"e": df}, by_day={"e": "at"})
    s.commit("more", 1, append={"e": df.withColumn("id", F.col("id") + 10)})
    assert s.read("e").columns == ["id", "at"] and s.read("e").count() == 12
    part = s.between("e", "2024-01-03 00:00:00", "2024-01-03 12:00:00")
    assert sorted(r.id for r in part.collect()) == [2, 12]
    assert "PartitionFilters: [isnotnull(day" in plan_text(part)
    old = sorted(glob.glob(f"{s.root}/data/*/*/day=2024-01-0[12]/*.parquet"))
    kept = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{s.root}/data/*/*/day=2024-01-04/*.parquet")}
    assert len(old) == 4 and len(kept) == 2
    for p in old:  # whole days before the cutoff are never opened
        with open(p, "wb") as f:
            f.write(b"unreadable")
    assert s.expire("retention", "e", "2024-01-03 12:00:00") == 3 == s.expire("retention", "e", "2024-01-03 12:00:00")
    assert sorted(r.id for r in s.read("e").collect()) == [3, 4, 5, 13, 14, 15]
    assert {p: os.stat(p).st_mtime_ns for p in kept} == kept
    rewritten = [p for p in json.loads(json.dumps(s.pointer(3)))["tables"]["e"]["parts"] if "retention" in p["path"]]
    assert [p["days"] for p in rewritten] == [["2024-01-03"]]
    assert s.expire("midnight", "e", "2025-01-01 00:00:00") == 4 and [r.id for r in s.read("e").collect() if r.at] == []
    s.commit("empty", 4, {"e": df.limit(0)})
    assert s.read("e").count() == 0 and s.expire("none", "e", AS_OF) == 6
    with pytest.raises(ValueError, match="not dealt by day"):
        s.commit("plain", 6, {"p": df})
        s.expire("x", "p", AS_OF)


def test_change_jobs_commit_rows_and_audit_together(spark, tmp_path):
    f, s = Fleet(spark, SF_SMALL), VersionedTables(spark, str(tmp_path / "s"))
    s.commit("load", 0, {n: getattr(f, n) for n in ("databases", "ip_whitelist", "audit_logs")}, by_day={"audit_logs": "created_at"})
    trail = s.read("audit_logs").count()
    gone = f.databases.where("status = 'suspended'").select("id")
    n = gone.count()
    for _ in range(2):  # a retried job
        assert changes.remove_tenants(s, gone, AS_OF, "gone") == 2
    assert n and s.read("databases").count() == f.databases.count() - n
    audit = s.read("audit_logs")
    assert audit.count() == trail + n == audit.select("id").distinct().count()
    assert s.read("ip_whitelist").join(gone.withColumnRenamed("id", "database_id"), "database_id", "left_semi").isEmpty()
    assert s.read("ip_whitelist", 1).count() == f.ip_whitelist.count()
