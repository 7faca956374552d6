"""Registry, audit and constraint jobs: properties from SURVEY §5."""

from pyspark.sql import functions as F

from tenantscope.operators import audit, checks, registry
from tenantscope.sources.fixtures import AS_OF


def test_active_databases_zero_not_null(fleet):
    out = registry.active_databases(fleet.databases, fleet.ip_whitelist, fleet.db_catalog)
    assert out.filter(F.col("whitelisted_ips").isNull()).count() == 0
    assert out.filter(F.col("whitelisted_ips") == 0).count() > 0
    assert out.count() == fleet.databases.filter("status = 'active'").count()


def test_list_order_has_tie_break_g17(spark):
    db = spark.createDataFrame([(2, "b", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"),
                                (3, "c", "2024-02-01 00:00:00")], "id long, database_name string, c string") \
        .withColumn("created_at", F.col("c").cast("timestamp_ntz")).drop("c")
    assert [r["id"] for r in registry.list_databases(db).collect()] == [3, 1, 2]


def test_defaults_g16_and_required(spark):
    req = spark.createDataFrame([("n", "e", None, 1), ("n", "e", 0, 2), ("n", "e", 7, 3),
                                 ("", "e", 5, 4), ("n", None, 5, 5)],
                                "friendly_name string, owner_email string, max_connections int, request_no long")
    d = {r["request_no"]: r["max_connections"] for r in registry.apply_defaults(req).collect()}
    assert d == {1: 20, 2: 20, 3: 7, 4: 5, 5: 5}
    ok, bad = registry.split_required(req, ["friendly_name", "owner_email"])
    assert sorted(r["request_no"] for r in bad.collect()) == [4, 5]
    assert ok.count() + bad.count() == req.count()


def test_register_names_stable_and_unique(fleet):
    a = registry.register(fleet.tenant_requests, fleet.databases, AS_OF)
    b = registry.register(fleet.tenant_requests, fleet.databases, AS_OF)
    ra = sorted((r["id"], r["database_name"]) for r in a["accepted"].collect())
    assert ra == sorted((r["id"], r["database_name"]) for r in b["accepted"].collect())
    assert len({n for _, n in ra}) == len(ra)
    assert a["accepted"].count() + a["rejected"].count() == fleet.tenant_requests.count()
    assert a["audit"].count() == a["accepted"].count()


def test_retention_keep_plus_expired_is_input(spark, fleet):
    keep, exp = audit.retention_split(fleet.audit_logs, AS_OF)
    assert keep.count() + exp.count() == fleet.audit_logs.count()
    df = spark.createDataFrame([(1, None), (2, "2020-01-01 00:00:00")], "id long, c string") \
        .withColumn("created_at", F.col("c").cast("timestamp_ntz"))
    k, e = audit.retention_split(df, AS_OF)
    assert [r["id"] for r in k.collect()] == [1] and [r["id"] for r in e.collect()] == [2]


def test_cascade_deleted_plus_left_is_input(fleet):
    ids = fleet.databases.filter("status = 'suspended'").select("id")
    out = checks.cascade_delete({"databases": (fleet.databases, "id"),
                                 "ip_whitelist": (fleet.ip_whitelist, "database_id")}, ids)
    counts = {r["table"]: (r["deleted"], r["remaining"]) for r in out["counts"].collect()}
    assert sum(counts["databases"]) == fleet.databases.count()
    assert sum(counts["ip_whitelist"]) == fleet.ip_whitelist.count()
    assert out["ip_whitelist"].count() == counts["ip_whitelist"][1]


def test_unique_nulls_never_clash(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), ("a", "x"), ("a", "x"), ("b", "y")],
                               "k string, v string")
    assert [tuple(r) for r in checks.unique_violations(df, ["k"]).collect()] == [("a", 2)]


def test_orphans_and_drift(fleet):
    o = checks.orphans(fleet.shadow_databases, "parent_database_id", fleet.databases)
    assert o.count() > 0
    d = {r["drift"] for r in checks.registry_drift(fleet.databases, fleet.db_catalog).collect()}
    assert d == {"missing_on_server", "missing_in_registry"}
