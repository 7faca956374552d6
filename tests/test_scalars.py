"""Scalar Column functions, with the G-cases of SURVEY §0.1 as named cases."""

import pytest
from pyspark.sql import functions as F

from tenantscope.functions import scalars as S


def one(spark, expr, value, schema):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("b,want", [
    (0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"),
    (1152, "1.13 KB"), (8388608, "8 MB"), (2 ** 30, "1 GB"), (2 ** 40, "1 TB"), (2 ** 50, "1 PB"),
    (None, None)])
def test_format_bytes_g1_g2(spark, b, want):
    # G1: exact powers land in the right unit (no duplicated MB); G2: 0 and NULL.
    assert one(spark, S.format_bytes("b"), b, "b bigint") == want


@pytest.mark.parametrize("b,want", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (8388608, "8192 kB"),
    (123456789, "118 MB"), (2 ** 40, "1024 GB"), (-20000, "-20 kB"), (-5, "-5 bytes"), (None, None)])
def test_size_pretty(spark, b, want):
    assert one(spark, S.size_pretty("b"), b, "b bigint") == want


@pytest.mark.parametrize("ip,valid,prefix_ok", [
    ("1.2.3.4", True, True), ("256.1.1.1", False, True), ("1.2.3.4/99", True, False),
    ("::1", False, True), ("1.2.3.4\n", False, True), ("", False, True), (None, False, True),
    ("203.0.113.5/32", True, True), ("189.0.0.0/8", True, True), ("192.168.1.0/24", True, True)])
def test_cidr_validation_g5(spark, ip, valid, prefix_ok):
    df = spark.createDataFrame([(ip,)], "ip string")
    r = df.select(S.cidr_valid("ip").alias("v"), S.cidr_prefix_ok("ip").alias("p")).first()
    assert r["v"] is valid
    if ip is not None:
        assert r["p"] is prefix_ok


def test_cidr_bounds_and_bare_ip_g6(spark):
    df = spark.createDataFrame([("192.168.1.77/24",), ("203.0.113.5",), ("0.0.0.0/0",)], "ip string")
    rows = df.select(S.cidr_lo("ip").alias("lo"), S.cidr_hi("ip").alias("hi"),
                     S.cidr_normalized("ip").alias("n")).collect()
    assert (rows[0]["lo"], rows[0]["hi"]) == (3232235776, 3232236031)
    assert rows[1]["lo"] == rows[1]["hi"] == 3405803781 and rows[1]["n"] == "203.0.113.5/32"
    assert (rows[2]["lo"], rows[2]["hi"]) == (0, 2 ** 32 - 1)


def test_whole_days_g18(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00", "2024-01-09 00:00:00"),
                                ("2024-01-01 00:00:00", "2024-01-09 00:00:00")], "a string, b string")
    r = df.select(S.whole_days_between(F.col("a").cast("timestamp_ntz"),
                                       F.col("b").cast("timestamp_ntz")).alias("d")).collect()
    assert [x["d"] for x in r] == [7, 8]  # 7 d 23 h is not "+7"; 8 d is


def test_cache_key_parts(spark):
    df = spark.createDataFrame([("site:store_a:products:123",),
                                ("site:store_b:ai:embeddings:doc_456",),
                                ("site:store_c:session:user_789",), ("plain",)], "k string")
    r = [tuple(x["p"]) for x in df.select(S.cache_key_parts("k").alias("p")).collect()]
    assert r == [("store_a", "products", "123"), ("store_b", "ai", "embeddings:doc_456"),
                 ("store_c", "session", "user_789"), (None, None, None)]


def test_has_permission_and_json(spark):
    df = spark.createDataFrame([('{"databases": ["create", "read"]}',), ('{"databases": ["read"]}',),
                                (None,)], "p string")
    assert [r[0] for r in df.select(S.has_permission("p", "databases", "create")).collect()] \
        == [True, False, False]
    d = spark.range(1).select(S.json_details(database_name=F.lit("tenant_x"),
                                             username=F.lit("user_x")).alias("j")).first()["j"]
    assert d == '{"database_name":"tenant_x","username":"user_x"}'


def test_unaccent_and_digest(spark):
    assert one(spark, S.unaccent("t"), "Crème Brûlée Straße Œuvre", "t string") \
        == "Creme Brulee Strasse OEuvre"
    assert one(spark, S.digest("t"), "a", "t string") == \
        "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"


def test_tenant_key_is_stable(spark):
    df = spark.createDataFrame([("a@x", "A", 1), ("a@x", "A", 1), ("a@x", "A", 2)], "o string, n string, r int")
    k = [r[0] for r in df.select(S.tenant_key("o", "n", "r")).collect()]
    assert k[0] == k[1] != k[2] and len(k[0]) == 8


def test_connection_strings_mask_password(spark):
    df = spark.createDataFrame([("user_ab", "tenant_ab")], "u string, d string")
    r = df.select(S.connection_string("u", "d", F.lit("h"), "pooled").alias("p"),
                  S.connection_string("u", "d", F.lit("h"), "direct").alias("d1"),
                  S.connection_string("u", "d", F.lit("h"), "shadow").alias("s")).first()
    assert r["p"] == "postgresql://user_ab:***@h:6432/tenant_ab?sslmode=disable&pgbouncer=true&connect_timeout=15"
    assert r["d1"] == "postgresql://user_ab:***@h:5432/tenant_ab?sslmode=require"
    assert r["s"] == "postgresql://user_ab:***@h:5432/tenant_ab?sslmode=require&schema=public"
