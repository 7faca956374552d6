"""Access rules and admission: properties, exact line format, brute force."""

import ipaddress

from pyspark.sql import functions as F

from conftest import plan_text
from tenantscope.functions import scalars as S
from tenantscope.operators import access


def _conns(fleet):
    c = fleet.conn_log
    return c.withColumn("database_name",
                        F.concat(F.lit("tenant_"), F.lpad(F.col("database_id").cast("string"), 8, "0")))


def test_rules_per_tenant_is_ips_plus_two(fleet):
    db, wl = fleet.databases, fleet.ip_whitelist
    rules = access.generate_rules(db, wl)
    got = {r["database_name"]: r["n"] for r in rules.groupBy("database_name")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    ok = wl.filter(S.cidr_valid("ip_address") & S.cidr_prefix_ok("ip_address"))
    act = db.filter(F.col("status") == "active")
    want = {r["database_name"]: r["n"] + 2 for r in ok.join(act, ok.database_id == act.id)
            .groupBy("database_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and len(got) > 0
    # rule numbers are 1..n per tenant, allows first, then the two rejects
    for r in rules.groupBy("database_name").agg(
            F.sort_array(F.collect_list(F.struct("rule_no", "kind"))).alias("s")).collect():
        kinds = [x["kind"] for x in r["s"]]
        assert [x["rule_no"] for x in r["s"]] == list(range(1, len(kinds) + 1))
        assert kinds[-2:] == ["reject", "reject"] and set(kinds[:-2]) == {"allow"}


def test_rule_lines_exact(spark):
    db = spark.createDataFrame([(1, "tenant_ab", "user_ab", "active"), (2, "tenant_cd", "user_cd", "active")],
                               "id long, database_name string, username string, status string")
    wl = spark.createDataFrame([(10, 1, "203.0.113.5/32"), (5, 1, "10.0.0.0/8"), (7, 1, "1.2.3.4/99"),
                                (8, 1, "203.0.113.9")], "id long, database_id long, ip_address string")
    lines = [r["line"] for r in access.generate_rules(db, wl).orderBy("database_name", "rule_no").collect()]
    assert lines == [
        "hostssl tenant_ab             user_ab             10.0.0.0/8                    scram-sha-256",
        "hostssl tenant_ab             user_ab             203.0.113.9/32                    scram-sha-256",
        "hostssl tenant_ab             user_ab             203.0.113.5/32                    scram-sha-256",
        "host    tenant_ab             user_ab             0.0.0.0/0               reject",
        "host    tenant_ab             user_ab             ::/0                    reject",
    ]  # tenant_cd has no IP -> no rules; /99 is left out (G5); bare IP -> /32 (G6)


def test_admit_matches_brute_force(fleet):
    rules = access.generate_rules(fleet.databases, fleet.ip_whitelist)
    conns = _conns(fleet)
    got = {r["conn_id"]: (r["decision"], r["rule_no"])
           for r in access.admit(conns, rules, "intended").collect()}
    allow = {}
    rejects = {}
    for r in rules.collect():
        if r["kind"] == "allow":
            allow.setdefault(r["database_name"], []).append(
                (r["rule_no"], ipaddress.ip_network(r["cidr"], strict=False)))
        elif r["cidr"] == "0.0.0.0/0":
            rejects[r["database_name"]] = r["rule_no"]
    for c in conns.collect():
        ip = ipaddress.ip_address(c["client_ip"])
        name = c["database_name"]
        if name in rejects:
            hits = sorted(n for n, net in allow[name] if c["is_ssl"] and ip in net)
            want = ("allow", hits[0]) if hits else ("reject", rejects[name])
        else:
            want = ("allow_default", None) if c["is_ssl"] else ("reject", None)
        assert got[c["conn_id"]] == want, c


def test_admit_plan_has_no_cartesian(fleet):
    rules = access.generate_rules(fleet.databases, fleet.ip_whitelist)
    p = plan_text(access.admit(_conns(fleet), rules, "intended"))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_file_order_blanket_ssl_g7(spark):
    rules = spark.createDataFrame(
        [("tenant_a", "user_a", 1, "allow", "10.0.0.0/8", 8, 167772160, 184549375),
         ("tenant_a", "user_a", 2, "reject", "0.0.0.0/0", None, None, None),
         ("tenant_a", "user_a", 3, "reject", "::/0", None, None, None)],
        "database_name string, username string, rule_no int, kind string, cidr string, "
        "prefix_len int, lo long, hi long")
    conns = spark.createDataFrame(
        [(1, "tenant_a", "8.8.8.8", True), (2, "tenant_a", "8.8.8.8", False),
         (3, "tenant_a", "127.0.0.1", False), (4, "tenant_b", "8.8.8.8", False),
         (5, "tenant_a", "10.1.1.1", True)],
        "conn_id long, database_name string, client_ip string, is_ssl boolean")
    fo = {r["conn_id"]: (r["decision"], r["matched"]) for r in access.admit(conns, rules, "file_order").collect()}
    assert fo == {1: ("allow", "blanket_ssl"), 2: ("reject", "tenant_reject"), 3: ("allow", "localhost"),
                  4: ("reject", "no_rule"), 5: ("allow", "blanket_ssl")}
    it = {r["conn_id"]: (r["decision"], r["rule_no"]) for r in access.admit(conns, rules, "intended").collect()}
    assert it == {1: ("reject", 2), 2: ("reject", 2), 3: ("reject", 2), 4: ("reject", None), 5: ("allow", 1)}


def test_remove_and_add_ips(spark):
    wl = spark.createDataFrame([(1, 1, "1.1.1.1/32", None, None), (2, 1, "2.2.2.2/32", None, None)],
                               "id long, database_id long, ip_address string, description string, added_at timestamp_ntz")
    db = spark.createDataFrame([(1, "tenant_a")], "id long, database_name string")
    out = access.remove_ips(wl, spark.createDataFrame([(1, 1), (9, 1)], "id long, database_id long"))
    assert [r["id"] for r in out["kept"].collect()] == [2]
    assert [tuple(r) for r in out["missing"].collect()] == [(9, 1)]
    req = spark.createDataFrame(
        [(1, "3.3.3.3/32", "a", 1), (1, "3.3.3.3/32", "b", 2), (1, "2.2.2.2/32", "", 3),
         (2, "4.4.4.4/32", None, 4), (1, "999.1.1.1", None, 5)],
        "database_id long, ip_address string, description string, request_no long")
    res = access.add_ips(req, wl, db, "2024-04-15 00:00:00")
    assert [(r["id"], r["ip_address"], r["description"]) for r in res["added"].collect()] == [(3, "3.3.3.3/32", "a")]
    reasons = {r["request_no"]: r["reason"] for r in res["rejected"].collect()}
    assert reasons == {2: "duplicate_in_batch", 3: "already_listed", 4: "database_not_found", 5: "invalid_ip"}
    assert res["table"].count() == 3


def test_ipv6_clients(spark):
    rules = spark.createDataFrame(
        [("tenant_a", "user_a", 1, "allow", "10.0.0.0/8", 8, 167772160, 184549375),
         ("tenant_a", "user_a", 2, "reject", "0.0.0.0/0", None, None, None),
         ("tenant_a", "user_a", 3, "reject", "::/0", None, None, None)],
        "database_name string, username string, rule_no int, kind string, cidr string, "
        "prefix_len int, lo long, hi long")
    conns = spark.createDataFrame(
        [(1, "tenant_a", "2001:db8::1", True), (2, "tenant_a", "2001:db8::1", False),
         (3, "tenant_a", "::1", False), (4, "tenant_b", "2001:db8::1", True)],
        "conn_id long, database_name string, client_ip string, is_ssl boolean")
    fo = {r["conn_id"]: (r["decision"], r["rule_no"], r["matched"])
          for r in access.admit(conns, rules, "file_order").collect()}
    assert fo == {1: ("allow", None, "blanket_ssl"), 2: ("reject", 3, "tenant_reject"),
                  3: ("allow", None, "localhost"), 4: ("allow", None, "blanket_ssl")}
    it = {r["conn_id"]: (r["decision"], r["rule_no"]) for r in access.admit(conns, rules, "intended").collect()}
    assert it == {1: ("reject", 3), 2: ("reject", 3), 3: ("reject", 3), 4: ("allow_default", None)}
