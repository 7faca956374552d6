"""IP allow lists, access-rule generation and connection admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope.functions import scalars as S
from tenantscope.operators.ranking import row_number_within

# ---------------------------------------------------------------------------
# The access-file line layout written per tenant (field
# separators are runs of spaces of these exact widths).
# ---------------------------------------------------------------------------
ALLOW_LINE = "hostssl {db}             {user}             {cidr}                    scram-sha-256"
REJECT_V4_LINE = "host    {db}             {user}             0.0.0.0/0               reject"
REJECT_V6_LINE = "host    {db}             {user}             ::/0                    reject"
HEADER_LINE = "# Rules for {db}"
REJECT_CIDRS = ["0.0.0.0/0", "::/0"]
# Server-wide rules that stand before the managed section (file order).
LOCALHOST_CIDR = "127.0.0.1/32"
LOCALHOST_V6 = "::1"
PRIVATE_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]


def _line(template: str):
    """Render a template over the ``database_name``/``username``/``cidr``
    columns with ``concat`` (JVM-side)."""
    parts, rest = [], template
    for name, col in (("{db}", "database_name"), ("{user}", "username"), ("{cidr}", "cidr")):
        if name in rest:
            a, rest = rest.split(name, 1)
            parts += [F.lit(a), F.col(col)]
    parts.append(F.lit(rest))
    return F.concat(*parts)


# ---------------------------------------------------------------------------
# Lookups and validation
# ---------------------------------------------------------------------------
def validate_cidr(df: DataFrame, col: str = "ip_address") -> DataFrame:
    """Validity, prefix check and numeric bounds of a CIDR column."""
    return df.select("*", S.cidr_valid(col).alias("valid"),
                     S.cidr_prefix_ok(col).alias("prefix_ok"),
                     F.when(S.cidr_valid(col), S.cidr_lo(col)).alias("lo"),
                     F.when(S.cidr_valid(col), S.cidr_hi(col)).alias("hi"))


def list_ips(wl: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Whitelist entries of the given tenants, newest first."""
    k = ids.select(F.col(id_col).alias("_tid"))
    return (wl.join(k, wl["database_id"] == k["_tid"], "left_semi")
            .orderBy("database_id", F.col("added_at").desc(), F.col("id")))


def get_ips(wl: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries matching (id AND database_id) pairs."""
    k = keys.select(F.col("id").alias("_id"), F.col("database_id").alias("_db"))
    cond = (wl["id"] == k["_id"]) & (wl["database_id"] == k["_db"])
    return wl.join(k, cond, "left_semi")


def remove_ips(wl: DataFrame, keys: DataFrame, as_of: str | None = None) -> dict[str, DataFrame]:
    """Delete entries by (id, database_id). Returns the remaining table,
    the removed rows, their ``ip_whitelist_removed`` audit rows (R51) and the
    keys that matched nothing."""
    from tenantscope.operators.audit import audit_rows
    k = keys.select(F.col("id").alias("_id"), F.col("database_id").alias("_db")).distinct()
    cond = (wl["id"] == k["_id"]) & (wl["database_id"] == k["_db"])
    kept = wl.join(k, cond, "left_anti")
    removed = wl.join(k, cond, "left_semi")
    w2 = wl.select(F.col("id").alias("_wid"), F.col("database_id").alias("_wdb"))
    missing = (k.join(w2, (k["_id"] == w2["_wid"]) & (k["_db"] == w2["_wdb"]), "left_anti")
               .select(F.col("_id").alias("id"), F.col("_db").alias("database_id")))
    audit = audit_rows(removed, "ip_whitelist_removed", "database_id", {"ip_address": "ip_address"}, as_of)
    return {"kept": kept, "removed": removed, "audit": audit, "missing": missing}


def require_parent(child: DataFrame, fk: str, parent: DataFrame,
                   pk: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and rows whose parent is missing."""
    p = parent.select(F.col(pk).alias("_pk"))
    cond = child[fk] == p["_pk"]
    return child.join(p, cond, "left_semi"), child.join(p, cond, "left_anti")


# ---------------------------------------------------------------------------
# Rule generation
# ---------------------------------------------------------------------------
def generate_rules(db: DataFrame, wl: DataFrame) -> DataFrame:
    """Access rules per active tenant with at least one IP: one ``hostssl``
    allow per IP in whitelist-id order, then the IPv4 and IPv6 rejects.
    Tenants without IPs get no rules. Entries that fail validation or have
    a prefix outside 0-32 are left out; a bare address is written as /32.

    ``rule_no`` restarts at 1 per tenant; the file order is
    (database_name, rule_no). Numbering is skew-safe (see ``ranking``).
    """
    tenants = db.filter(F.col("status") == "active").select(
        F.col("id").alias("_tid"), "database_name", "username")
    ips = (wl.filter(S.cidr_valid("ip_address") & S.cidr_prefix_ok("ip_address"))
           .select(F.col("id").alias("wl_id"), F.col("database_id").alias("_wdb"),
                   S.cidr_normalized("ip_address").alias("cidr"),
                   S.cidr_prefix("ip_address").alias("prefix_len"),
                   S.cidr_lo("ip_address").alias("lo"), S.cidr_hi("ip_address").alias("hi")))
    allowed = ips.join(tenants, ips["_wdb"] == tenants["_tid"], "inner").drop("_wdb", "_tid")
    allowed = row_number_within(allowed, ["database_name", "username"], "wl_id",
                                out="rule_no", total="n_allow", span=wl.select(F.col("id").alias("wl_id")))
    # A tenant's last allow row also gives its two rejects, so the rejects
    # cost no second pass over the whitelist.
    no_len, no_bound = F.lit(None).cast("int").alias("prefix_len"), F.lit(None).cast("bigint")

    def reject(i: int, cidr: str, template: str):
        return F.struct((F.col("n_allow") + i).cast("int").alias("rule_no"), F.lit("reject").alias("kind"),
                        F.lit(cidr).alias("cidr"), F.lit("reject").alias("method"), no_len,
                        no_bound.alias("lo"), no_bound.alias("hi"), _line(template).alias("line"))

    allow = F.struct("rule_no", F.lit("allow").alias("kind"), "cidr", F.lit("scram-sha-256").alias("method"),
                     "prefix_len", "lo", "hi", _line(ALLOW_LINE).alias("line"))
    rows = F.when(F.col("rule_no") == F.col("n_allow"),
                  F.array(allow, reject(1, REJECT_CIDRS[0], REJECT_V4_LINE),
                          reject(2, REJECT_CIDRS[1], REJECT_V6_LINE))).otherwise(F.array(allow))
    return allowed.select("database_name", "username", F.inline(rows))


def rules_text(rules: DataFrame) -> DataFrame:
    """Rules plus the per-tenant header lines, keyed for ordered output:
    (database_name, rule_no) with -1 = blank line, 0 = comment."""
    head = F.struct(F.lit(-1).alias("rule_no"), F.lit("").alias("line"))
    title = F.struct(F.lit(0).alias("rule_no"), _line(HEADER_LINE).alias("line"))
    own = F.struct("rule_no", "line")
    lines = F.when(F.col("rule_no") == 1, F.array(head, title, own)).otherwise(F.array(own))
    return rules.select("database_name", F.inline(lines))


def rule_drift(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rule lines present on one side only, with multiplicity (the
    rows of ``exceptAll`` both ways). Each side is counted once per line
    (partial aggregates) and the counts meet in one full outer join, so
    each input is computed once."""
    cols = ["database_name", "rule_no", "line"]
    c = current.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    w = wanted.groupBy(*cols).agg(F.count(F.lit(1)).alias("_w"))
    diff = (c.join(w, cols, "full_outer")
            .withColumn("_d", F.coalesce("_c", F.lit(0)) - F.coalesce("_w", F.lit(0)))
            .filter(F.col("_d") != 0))
    out = diff.select(*cols, F.when(F.col("_d") > 0, "only_current").otherwise("only_wanted")
                      .alias("side"),
                      F.explode(F.array_repeat(F.lit(1), F.abs(F.col("_d")).cast("int"))).alias("_x"))
    return out.drop("_x")


# ---------------------------------------------------------------------------
# Admission
# ---------------------------------------------------------------------------
def admit(conn: DataFrame, rules: DataFrame, mode: str = "intended",
          private_networks: bool = False) -> DataFrame:
    """Does each connection get in?

    ``conn`` has conn_id, database_name, client_ip, is_ssl; ``rules`` is the
    output of ``generate_rules``.

    intended: tenants with rules admit SSL clients inside one of their
    CIDRs (lowest matching rule_no) and reject everything else with their
    IPv4 reject rule; tenants without rules admit any SSL client.
    file_order: the server's first matching line decides: localhost, the
    private networks (variant, off by default), then the blanket SSL rule,
    then the tenant rejects.

    The CIDR match is an equi-join, not a range join: CIDR blocks are
    aligned, so an address is inside ``lo/n`` exactly when its address with
    the low ``32-n`` bits cleared equals ``lo``. Each SSL connection is
    expanded once per prefix length its tenant uses (at most 33, through an
    equi-join with the small (tenant, prefix length) table) and joined on
    (tenant, prefix, masked address); a tenant with many connections and
    many CIDRs is a large equi-join that AQE can split, never a band join.
    """
    ip = S.ipv4_to_long("client_ip")
    ip_ok = S.cidr_valid("client_ip")
    c = (conn.withColumn("_row", F.monotonically_increasing_id()).withColumn("_ip", F.when(ip_ok, ip))
         .withColumn("_v6", F.coalesce(F.instr(F.col("client_ip"), ":") > 0, F.lit(False))))
    # One row per tenant: its IPv4 reject and, as an array of at most 33, the
    # prefix lengths it uses. The rules are read once for it.
    tenants = (rules.groupBy(F.col("database_name").alias("_tn"))
               .agg(F.min(F.when(F.col("kind") == "reject", F.col("rule_no"))).cast("int").alias("_reject_no"),
                    F.collect_set(F.when(F.col("kind") == "allow", F.col("prefix_len"))).alias("_lens"))
               .filter(F.col("_reject_no").isNotNull()))
    c = c.join(tenants, c["database_name"] == tenants["_tn"], "left").drop("_tn")
    has_rules = F.col("_reject_no").isNotNull()
    # An IPv6 client meets the tenant's ``::/0`` reject, the rule after the
    # IPv4 one.
    reject_no = F.col("_reject_no") + F.when(F.col("_v6"), F.lit(1)).otherwise(F.lit(0))

    if mode == "file_order":
        local = F.col("client_ip").isin(LOCALHOST_CIDR.split("/")[0], LOCALHOST_V6)
        private = F.lit(False)
        if private_networks:
            for net in PRIVATE_NETWORKS:
                private = private | ((F.col("_ip") >= S.cidr_lo(F.lit(net)))
                                     & (F.col("_ip") <= S.cidr_hi(F.lit(net))))
        matched = (F.when(local, "localhost").when(private, "private_network")
                   .when(F.col("is_ssl") & (F.col("_ip").isNotNull() | F.col("_v6")), "blanket_ssl")
                   .when(has_rules, "tenant_reject").otherwise("no_rule"))
        out = c.withColumn("matched", matched)
        return out.select(
            "conn_id", "database_name", "client_ip", "is_ssl",
            F.when(F.col("matched").isin("localhost", "private_network", "blanket_ssl"), "allow")
             .otherwise("reject").alias("decision"),
            F.when(F.col("matched") == "tenant_reject", reject_no).cast("int").alias("rule_no"),
            "matched")

    if mode != "intended":
        raise ValueError(f"unknown mode {mode!r}")
    # Equal blocks of a tenant differ in their rule number only: the lowest
    # decides, so a connection meets each block once.
    allow = (rules.filter(F.col("kind") == "allow")
             .groupBy(F.col("database_name").alias("_rt"), F.col("prefix_len").alias("_rl"), F.col("lo").alias("_lo"))
             .agg(F.min("rule_no").alias("_no")))
    # Each connection is expanded to its masked addresses; one that asks for
    # no block (no rules, no SSL, no IPv4 address) keeps one row without. The
    # best block is the minimum per connection, so nothing is joined back.
    ask = F.when(has_rules & F.col("is_ssl") & F.col("_ip").isNotNull(), F.col("_lens"))
    cand = c.withColumn("_l", F.explode_outer(ask)).withColumn(
        "_m", F.col("_ip") - F.pmod(F.col("_ip"), F.pow(F.lit(2), F.lit(32) - F.col("_l")).cast("bigint")))
    hit = cand.join(allow, (cand["database_name"] == allow["_rt"]) & (cand["_l"] == allow["_rl"])
                    & (cand["_m"] == allow["_lo"]), "left")
    keys = ["conn_id", "database_name", "client_ip", "is_ssl", "_v6", "_reject_no"]
    # ``_row`` tells rows apart that share all of these.
    c = hit.groupBy(*keys, "_row").agg(F.min("_no").alias("_allow_no"))
    matched = (F.when(has_rules & F.col("_allow_no").isNotNull(), "tenant_allow")
               .when(has_rules, "tenant_reject")
               .when(F.col("is_ssl"), "default_ssl").otherwise("no_rule"))
    out = c.withColumn("matched", matched)
    return out.select(
        "conn_id", "database_name", "client_ip", "is_ssl",
        F.when(F.col("matched") == "tenant_allow", "allow")
         .when(F.col("matched") == "default_ssl", "allow_default")
         .otherwise("reject").alias("decision"),
        F.when(F.col("matched") == "tenant_allow", F.col("_allow_no"))
         .when(F.col("matched") == "tenant_reject", reject_no).cast("int").alias("rule_no"),
        "matched")


# ---------------------------------------------------------------------------
# Whitelist additions
# ---------------------------------------------------------------------------
def add_ips(req: DataFrame, wl: DataFrame, db: DataFrame, as_of: str,
            order_col: str = "request_no") -> dict[str, DataFrame]:
    """Validate (R17), check the tenant exists (R24), drop pairs already in
    the table or earlier in the batch (first request wins), then return the
    new table rows, their audit rows and the rejects with a reason.

    Every request is in exactly one of added and rejected; rejects carry the
    request as it came. One pass: the parent and the listed pair are left joins
    with a flag, duplicates an aggregate (min request number per pair), so a
    pair repeated a million times is merged map-side, not in one task.
    New ids are ``max(id) + request number`` (unique, increasing)."""
    from tenantscope.operators.audit import audit_rows
    from tenantscope.operators.registry import apply_defaults, mark_duplicates
    r = apply_defaults(req.withColumn("_raw", F.struct(*req.columns)))
    parent = db.select(F.col("id").alias("_p")).distinct()
    listed = wl.select(F.col("database_id").alias("_d"), F.col("ip_address").alias("_a")).distinct()
    r = r.join(parent, r["database_id"] == parent["_p"], "left")
    r = r.join(listed, (r["database_id"] == listed["_d"]) & (r["ip_address"] == listed["_a"]), "left")
    reason = (F.when(~F.coalesce(S.cidr_valid("ip_address"), F.lit(False)), "invalid_ip")
              .when(F.col("_p").isNull(), "database_not_found")
              .when(F.col("_d").isNotNull(), "already_listed")
              .when(F.col(order_col).isNull(), f"{order_col} is required"))
    r = mark_duplicates(r.withColumn("_why", reason).withColumn("_ok", F.col("_why").isNull()),
                        ["database_id", "ip_address"], order_col)
    r = r.withColumn("reason", F.when(F.col("_dup"), "duplicate_in_batch").otherwise(F.col("_why")))
    # Highest existing id as a scalar subquery (runs once; no join).
    base = wl.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ts = F.lit(as_of).cast("timestamp_ntz")
    added = (r.filter(F.col("reason").isNull())
             .select((base + F.col(order_col)).alias("id"), "database_id",
                     "ip_address", "description", ts.alias("added_at")))
    audit = audit_rows(added, "ip_whitelist_added", "database_id",
                       {"ip_address": "ip_address"}, as_of)
    rejected = r.filter(F.col("reason").isNotNull()).select("_raw.*", "reason")
    return {"added": added, "table": wl.unionByName(added), "audit": audit,
            "rejected": rejected}
