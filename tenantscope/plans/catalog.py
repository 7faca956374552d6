"""Named queries: each reads one scale-factor directory of driver tables,
derives the fixture views and runs one operator over the whole data.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
The oracle SQL is DuckDB SQL over the driver tables; the fixture views are
prefixed by ``with_views``. Column names match between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantscope.operators import access, audit, checks, ops, registry
from tenantscope.plans import oracle_sql as Q
from tenantscope.plans.oracle_views import with_views
from tenantscope.sources.fixtures import AS_OF, Fleet

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[QueryFn, str | None]] = {}

# Fixed parameters of the registered queries (ours; the reference has none).
BACKUP_AS_OF = "1998-08-02 00:00:00"
PUBLIC_HOST = "db.example.com"


def query(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = (fn, with_views(sql) if sql else None)
        return fn
    return deco


def conns_with_names(f: Fleet) -> DataFrame:
    c = f.conn_log
    return c.withColumn("database_name",
                        F.concat(F.lit("tenant_"), F.lpad(F.col("database_id").cast("string"), 8, "0")))


# ---------------------------------------------------------------------------
# Registry (R11, R14, R21, R23, R34, R36, R52, R61, R62, R63)
# ---------------------------------------------------------------------------
@query("active_databases", """
SELECT d.id, d.database_name, d.friendly_name, d.owner_email, d.max_connections, d.status,
  d.created_at, COUNT(DISTINCT iw.id) AS whitelisted_ips, c.size_bytes
FROM databases d
LEFT JOIN ip_whitelist iw ON d.id = iw.database_id
LEFT JOIN db_catalog c ON c.datname = d.database_name
WHERE d.status = 'active'
GROUP BY d.id, d.database_name, d.friendly_name, d.owner_email, d.max_connections, d.status,
  d.created_at, c.size_bytes
""")
def q_active_databases(spark, d):
    f = Fleet(spark, d)
    return registry.active_databases(f.databases, f.ip_whitelist, f.db_catalog) \
                   .orderBy(F.col("created_at").desc(), "id")


@query("list_databases", """
SELECT id, database_name, username, owner_email, friendly_name, max_connections, status,
  created_at, updated_at
FROM databases ORDER BY created_at DESC, id
""")
def q_list_databases(spark, d):
    return registry.list_databases(Fleet(spark, d).databases)


@query("get_databases", """
SELECT id, database_name, username, owner_email, friendly_name, max_connections, status,
  created_at, updated_at
FROM databases WHERE id IN (SELECT database_id FROM conn_log)
""")
def q_get_databases(spark, d):
    f = Fleet(spark, d)
    return registry.get_databases(f.databases, f.conn_log, "database_id")


@query("database_stats_now", f"""
SELECT d.id AS database_id, d.database_name, c.size_bytes,
  {Q.format_bytes('c.size_bytes')} AS size_pretty,
  CAST(COALESCE(a.n, 0) AS BIGINT) AS active_connections, d.max_connections
FROM databases d
LEFT JOIN db_catalog c ON c.datname = d.database_name
LEFT JOIN (SELECT datname, COUNT(*) AS n FROM activity WHERE datname IS NOT NULL
           GROUP BY datname) a ON a.datname = d.database_name
""")
def q_database_stats_now(spark, d):
    f = Fleet(spark, d)
    return registry.database_stats_now(f.databases, f.db_catalog, f.activity)


@query("connections_by_db", """
SELECT datname, COUNT(*) AS connections FROM activity GROUP BY datname
""")
def q_connections_by_db(spark, d):
    return registry.connections_by_db(Fleet(spark, d).activity)


@query("largest_databases", f"""
SELECT datname, size_bytes, {Q.size_pretty('size_bytes')} AS size
FROM db_catalog WHERE NOT datistemplate ORDER BY size_bytes DESC, datname
""")
def q_largest_databases(spark, d):
    return registry.largest_databases(Fleet(spark, d).db_catalog)


@query("largest_databases_top10", f"""
SELECT datname, size_bytes, {Q.size_pretty('size_bytes')} AS size
FROM db_catalog WHERE NOT datistemplate ORDER BY size_bytes DESC, datname LIMIT 10
""")
def q_largest_databases_top10(spark, d):
    return registry.largest_databases(Fleet(spark, d).db_catalog, n=10)


@query("connection_strings", f"""
SELECT id AS database_id, database_name, username,
  'postgresql://' || username || ':***@{PUBLIC_HOST}:6432/' || database_name
    || '?sslmode=disable&pgbouncer=true&connect_timeout=15' AS DATABASE_URL,
  'postgresql://' || username || ':***@{PUBLIC_HOST}:5432/' || database_name
    || '?sslmode=require' AS DIRECT_URL,
  'postgresql://' || username || ':***@{PUBLIC_HOST}:5432/' || database_name
    || '?sslmode=require&schema=public' AS SHADOW_DATABASE_URL
FROM databases
""")
def q_connection_strings(spark, d):
    return registry.connection_strings(Fleet(spark, d).databases, PUBLIC_HOST)


@query("parse_connection", f"""
SELECT database_id, 'DATABASE_URL' AS kind, username AS url_user, '{PUBLIC_HOST}' AS url_host,
  6432 AS url_port, database_name AS url_database, 'disable' AS sslmode, true AS pooled
FROM (SELECT id AS database_id, database_name, username FROM databases)
UNION ALL
SELECT id, 'DIRECT_URL', username, '{PUBLIC_HOST}', 5432, database_name, 'require', false
FROM databases
UNION ALL
SELECT id, 'SHADOW_DATABASE_URL', username, '{PUBLIC_HOST}', 5432, database_name, 'require', false
FROM databases
""")
def q_parse_connection(spark, d):
    cs = registry.connection_strings(Fleet(spark, d).databases, PUBLIC_HOST)
    long = cs.select("database_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("url"))
        for k in ("DATABASE_URL", "DIRECT_URL", "SHADOW_DATABASE_URL")])).alias("u"))
    p = registry.parse_connection(long.select("database_id", "u.kind", "u.url"), "url")
    return p.select("database_id", "kind", "url_user", "url_host", "url_port", "url_database",
                    "sslmode", "pooled")


# ---------------------------------------------------------------------------
# Requests and registration
# ---------------------------------------------------------------------------
_TR_OK = "(friendly_name IS NOT NULL AND friendly_name <> '' AND owner_email IS NOT NULL AND owner_email <> '')"


@query("apply_defaults", """
SELECT friendly_name, owner_email,
  CAST(CASE WHEN max_connections IS NULL OR max_connections = 0 THEN 20 ELSE max_connections END AS INT)
    AS max_connections, request_no
FROM tenant_requests
""")
def q_apply_defaults(spark, d):
    return registry.apply_defaults(Fleet(spark, d).tenant_requests)


@query("required_rejected", f"""
SELECT friendly_name, owner_email, max_connections, request_no,
  'friendlyName and ownerEmail are required' AS reason
FROM tenant_requests WHERE NOT {_TR_OK}
""")
def q_required_rejected(spark, d):
    return registry.split_required(Fleet(spark, d).tenant_requests,
                                   ["friendly_name", "owner_email"])[1]


_REG_NAME = "substring(sha256(concat_ws('|', owner_email, friendly_name, CAST(request_no AS VARCHAR))), 1, 8)"


@query("register_accepted", f"""
WITH ok AS (
  SELECT *, 'tenant_' || {_REG_NAME} AS database_name, 'user_' || {_REG_NAME} AS username
  FROM tenant_requests WHERE {_TR_OK}
), fresh AS (
  SELECT * FROM ok WHERE database_name NOT IN (SELECT database_name FROM databases)
), first_req AS (
  SELECT * FROM fresh WHERE request_no = (SELECT MIN(request_no) FROM fresh f2
                                          WHERE f2.database_name = fresh.database_name)
)
SELECT (SELECT COALESCE(MAX(id), 0) FROM databases) + request_no AS id, database_name, username,
  CAST(NULL AS VARCHAR) AS password_hash, owner_email, friendly_name,
  CAST(CASE WHEN max_connections IS NULL OR max_connections = 0 THEN 20 ELSE max_connections END AS INT)
    AS max_connections,
  'active' AS status, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM first_req
""")
def q_register_accepted(spark, d):
    f = Fleet(spark, d)
    return registry.register(f.tenant_requests, f.databases, AS_OF)["accepted"]


@query("register_audit", f"""
WITH ok AS (
  SELECT *, 'tenant_' || {_REG_NAME} AS database_name, 'user_' || {_REG_NAME} AS username
  FROM tenant_requests WHERE {_TR_OK}
), fresh AS (
  SELECT * FROM ok WHERE database_name NOT IN (SELECT database_name FROM databases)
), first_req AS (
  SELECT * FROM fresh WHERE request_no = (SELECT MIN(request_no) FROM fresh f2
                                          WHERE f2.database_name = fresh.database_name)
)
SELECT 'database_created' AS action, 'database' AS resource_type,
  CAST((SELECT COALESCE(MAX(id), 0) FROM databases) + request_no AS VARCHAR) AS resource_id,
  '{{"database_name":"' || database_name || '","username":"' || username || '"}}' AS details,
  TIMESTAMP '{AS_OF}' AS created_at
FROM first_req
""")
def q_register_audit(spark, d):
    f = Fleet(spark, d)
    return registry.register(f.tenant_requests, f.databases, AS_OF)["audit"]


# A batch as it may arrive: some requests once more without their number, some
# sent twice.
_MESSY_SQL = """(SELECT friendly_name, owner_email, max_connections, request_no FROM tenant_requests
  UNION ALL SELECT friendly_name, owner_email, max_connections, CAST(NULL AS BIGINT) FROM tenant_requests
    WHERE request_no % 19 = 0
  UNION ALL SELECT friendly_name, owner_email, max_connections, request_no FROM tenant_requests
    WHERE request_no % 23 = 0)"""


def _messy_requests(f: Fleet) -> DataFrame:
    r = f.tenant_requests
    return (r.unionByName(r.filter(r.request_no % 19 == 0).withColumn("request_no", F.lit(None).cast("bigint")))
            .unionByName(r.filter(r.request_no % 23 == 0)))


@query("register_rejected", f"""
SELECT friendly_name, owner_email, max_connections, request_no,
  CASE WHEN NOT {_TR_OK} THEN 'friendlyName and ownerEmail are required'
       WHEN request_no IS NULL THEN 'request_no is required' ELSE 'duplicate_in_batch' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY friendly_name, owner_email, request_no) AS copy
      FROM {_MESSY_SQL})
WHERE NOT {_TR_OK} OR request_no IS NULL OR copy > 1
""")
def q_register_rejected(spark, d):
    f = Fleet(spark, d)
    return registry.register(_messy_requests(f), f.databases, AS_OF)["rejected"]


# ---------------------------------------------------------------------------
# Audit (R18, R19, R29, R33, R35, R58, R65, R76)
# ---------------------------------------------------------------------------
@query("audit_summary", """
SELECT CAST(created_at AS DATE) AS date, action, COUNT(*) AS count
FROM audit_logs GROUP BY 1, 2 ORDER BY date DESC, count DESC, action
""")
def q_audit_summary(spark, d):
    return audit.audit_summary(Fleet(spark, d).audit_logs)


@query("audit_crosstab", """
SELECT CAST(created_at AS DATE) AS date,
  COUNT(*) FILTER (WHERE action = 'database_created') AS database_created,
  COUNT(*) FILTER (WHERE action = 'database_deleted') AS database_deleted,
  COUNT(*) FILTER (WHERE action = 'ip_whitelist_added') AS ip_whitelist_added,
  COUNT(*) FILTER (WHERE action = 'ip_whitelist_removed') AS ip_whitelist_removed
FROM audit_logs GROUP BY 1
""")
def q_audit_crosstab(spark, d):
    return audit.audit_crosstab(Fleet(spark, d).audit_logs)


@query("retention_expired", f"""
SELECT * FROM audit_logs WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY
""")
def q_retention_expired(spark, d):
    return audit.retention_split(Fleet(spark, d).audit_logs, AS_OF)[1]


@query("retention_kept", f"""
SELECT * FROM audit_logs
WHERE NOT COALESCE(created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY, false)
""")
def q_retention_kept(spark, d):
    return audit.retention_split(Fleet(spark, d).audit_logs, AS_OF)[0]


@query("retention_counts", f"""
SELECT CAST(count_if(COALESCE(created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY, false)) AS BIGINT) AS expired,
  CAST(count_if(NOT COALESCE(created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY, false)) AS BIGINT) AS kept,
  COUNT(*) AS total
FROM audit_logs
""")
def q_retention_counts(spark, d):
    return audit.retention_counts(Fleet(spark, d).audit_logs, AS_OF)


@query("expired_backups", f"""
SELECT name, mtime,
  CAST(floor((epoch(TIMESTAMP '{BACKUP_AS_OF}') - epoch(mtime)) / 86400) AS BIGINT) AS age_days
FROM backups
WHERE floor((epoch(TIMESTAMP '{BACKUP_AS_OF}') - epoch(mtime)) / 86400) > 7
""")
def q_expired_backups(spark, d):
    return audit.expired_files(Fleet(spark, d).backups, BACKUP_AS_OF)


@query("audit_with_tenant", """
SELECT a.id, a.action, a.resource_id,
  COALESCE(d.database_name, json_extract_string(a.details, '$.database_name')) AS database_name,
  d.status AS tenant_status, a.created_at
FROM audit_logs a LEFT JOIN databases d ON a.resource_id = CAST(d.id AS VARCHAR)
""")
def q_audit_with_tenant(spark, d):
    f = Fleet(spark, d)
    return audit.audit_with_tenant(f.audit_logs, f.databases)


@query("audit_by_key", """
SELECT a.id, a.api_key_id, k.name AS key_name, a.action, a.created_at,
  (k.expires_at IS NOT NULL AND a.created_at >= k.expires_at) AS key_expired
FROM audit_logs a LEFT JOIN api_keys k ON a.api_key_id = k.id
""")
def q_audit_by_key(spark, d):
    f = Fleet(spark, d)
    return audit.audit_by_key(f.audit_logs, f.api_keys)


@query("key_permissions", """
SELECT id, name,
  COALESCE(list_contains(CAST(json_extract(permissions, '$.databases') AS VARCHAR[]), 'create'), false) AS can_create,
  COALESCE(list_contains(CAST(json_extract(permissions, '$.databases') AS VARCHAR[]), 'read'), false) AS can_read,
  COALESCE(list_contains(CAST(json_extract(permissions, '$.databases') AS VARCHAR[]), 'update'), false) AS can_update,
  COALESCE(list_contains(CAST(json_extract(permissions, '$.databases') AS VARCHAR[]), 'delete'), false) AS can_delete
FROM api_keys
""")
def q_key_permissions(spark, d):
    return audit.key_permissions(Fleet(spark, d).api_keys)


# ---------------------------------------------------------------------------
# Access rules and admission (R09, R15-R17, R22, R24, R26, R28, R39, R45,
# R46, R50, R60)
# ---------------------------------------------------------------------------
@query("validate_cidr", f"""
SELECT id, database_id, ip_address, {Q.cidr_valid('ip_address')} AS valid,
  {Q.cidr_prefix_ok('ip_address')} AS prefix_ok,
  CASE WHEN {Q.cidr_valid('ip_address')} THEN {Q.cidr_lo('ip_address')} END AS lo,
  CASE WHEN {Q.cidr_valid('ip_address')} THEN {Q.cidr_hi('ip_address')} END AS hi
FROM ip_whitelist
""")
def q_validate_cidr(spark, d):
    wl = Fleet(spark, d).ip_whitelist
    return access.validate_cidr(wl).select("id", "database_id", "ip_address", "valid",
                                           "prefix_ok", "lo", "hi")


@query("access_rules", f"""
SELECT * FROM ({Q.ACCESS_RULES}) rules ORDER BY database_name, rule_no
""")
def q_access_rules(spark, d):
    f = Fleet(spark, d)
    return access.generate_rules(f.databases, f.ip_whitelist).orderBy("database_name", "rule_no")


_CONN = f"""conn AS (
  SELECT conn_id, {Q.tenant_name('database_id')} AS database_name, client_ip, is_ssl,
    {Q.ipv4_num('client_ip')} AS ip
  FROM conn_log
), rules AS ({Q.ACCESS_RULES}),
rejects AS (SELECT database_name, MIN(rule_no) AS reject_no FROM rules WHERE kind = 'reject'
            GROUP BY database_name)"""


@query("admit_intended", f"""
WITH {_CONN},
allow_hit AS (
  SELECT c.conn_id, MIN(r.rule_no) AS allow_no
  FROM conn c JOIN rules r ON r.kind = 'allow' AND r.database_name = c.database_name
    AND c.is_ssl AND c.ip BETWEEN r.lo AND r.hi
  GROUP BY c.conn_id
), m AS (
  SELECT c.*, x.reject_no, h.allow_no,
    CASE WHEN x.reject_no IS NOT NULL AND h.allow_no IS NOT NULL THEN 'tenant_allow'
         WHEN x.reject_no IS NOT NULL THEN 'tenant_reject'
         WHEN c.is_ssl THEN 'default_ssl' ELSE 'no_rule' END AS matched
  FROM conn c LEFT JOIN rejects x ON x.database_name = c.database_name
  LEFT JOIN allow_hit h ON h.conn_id = c.conn_id
)
SELECT conn_id, database_name, client_ip, is_ssl,
  CASE matched WHEN 'tenant_allow' THEN 'allow' WHEN 'default_ssl' THEN 'allow_default'
       ELSE 'reject' END AS decision,
  CAST(CASE matched WHEN 'tenant_allow' THEN allow_no
       WHEN 'tenant_reject' THEN reject_no + CASE WHEN contains(client_ip, ':') THEN 1 ELSE 0 END END AS INT)
    AS rule_no,
  matched
FROM m
""")
def q_admit_intended(spark, d):
    f = Fleet(spark, d)
    rules = access.generate_rules(f.databases, f.ip_whitelist)
    return access.admit(conns_with_names(f), rules, "intended")


@query("admit_file_order", f"""
WITH {_CONN},
m AS (
  SELECT c.*, x.reject_no,
    CASE WHEN c.client_ip IN ('127.0.0.1', '::1') THEN 'localhost'
         WHEN c.is_ssl AND (c.ip IS NOT NULL OR contains(c.client_ip, ':')) THEN 'blanket_ssl'
         WHEN x.reject_no IS NOT NULL THEN 'tenant_reject' ELSE 'no_rule' END AS matched
  FROM conn c LEFT JOIN rejects x ON x.database_name = c.database_name
)
SELECT conn_id, database_name, client_ip, is_ssl,
  CASE WHEN matched IN ('localhost', 'blanket_ssl') THEN 'allow' ELSE 'reject' END AS decision,
  CAST(CASE WHEN matched = 'tenant_reject'
            THEN reject_no + CASE WHEN contains(client_ip, ':') THEN 1 ELSE 0 END END AS INT) AS rule_no,
  matched
FROM m
""")
def q_admit_file_order(spark, d):
    f = Fleet(spark, d)
    rules = access.generate_rules(f.databases, f.ip_whitelist)
    return access.admit(conns_with_names(f), rules, "file_order")


@query("admit_file_order_private", f"""
WITH {_CONN},
m AS (
  SELECT c.*, x.reject_no,
    CASE WHEN c.client_ip IN ('127.0.0.1', '::1') THEN 'localhost'
         WHEN (c.ip BETWEEN 167772160 AND 184549375) OR (c.ip BETWEEN 2886729728 AND 2887778303)
              OR (c.ip BETWEEN 3232235520 AND 3232301055) THEN 'private_network'
         WHEN c.is_ssl AND (c.ip IS NOT NULL OR contains(c.client_ip, ':')) THEN 'blanket_ssl'
         WHEN x.reject_no IS NOT NULL THEN 'tenant_reject' ELSE 'no_rule' END AS matched
  FROM conn c LEFT JOIN rejects x ON x.database_name = c.database_name
)
SELECT conn_id, database_name, client_ip, is_ssl,
  CASE WHEN matched IN ('localhost', 'private_network', 'blanket_ssl') THEN 'allow' ELSE 'reject' END AS decision,
  CAST(CASE WHEN matched = 'tenant_reject'
            THEN reject_no + CASE WHEN contains(client_ip, ':') THEN 1 ELSE 0 END END AS INT) AS rule_no,
  matched
FROM m
""")
def q_admit_file_order_private(spark, d):
    f = Fleet(spark, d)
    rules = access.generate_rules(f.databases, f.ip_whitelist)
    return access.admit(conns_with_names(f), rules, "file_order", private_networks=True)


@query("list_ips_active", """
SELECT w.* FROM ip_whitelist w
WHERE w.database_id IN (SELECT id FROM databases WHERE status = 'active')
ORDER BY database_id, added_at DESC, id
""")
def q_list_ips_active(spark, d):
    f = Fleet(spark, d)
    return access.list_ips(f.ip_whitelist, f.databases.filter(F.col("status") == "active"))


# Removal requests: every (order, customer) pair of a finished order. Most
# are not in the whitelist, so the report has both found and missing keys.
def _removal_keys(f: Fleet) -> DataFrame:
    o = f.raw("orders")
    return o.filter(o.o_orderstatus == "F").select(F.col("o_orderkey").alias("id"),
                                                   F.col("o_custkey").alias("database_id"))


_KEYS_SQL = "(SELECT o_orderkey AS id, o_custkey AS database_id FROM orders WHERE o_orderstatus = 'F')"


@query("get_ips", f"""
SELECT w.* FROM ip_whitelist w
WHERE EXISTS (SELECT 1 FROM {_KEYS_SQL} k WHERE k.id = w.id AND k.database_id = w.database_id)
""")
def q_get_ips(spark, d):
    f = Fleet(spark, d)
    return access.get_ips(f.ip_whitelist, _removal_keys(f))


@query("remove_ips_kept", f"""
SELECT w.* FROM ip_whitelist w
WHERE NOT EXISTS (SELECT 1 FROM {_KEYS_SQL} k WHERE k.id = w.id AND k.database_id = w.database_id)
""")
def q_remove_ips_kept(spark, d):
    f = Fleet(spark, d)
    return access.remove_ips(f.ip_whitelist, _removal_keys(f))["kept"]


@query("remove_ips_missing", f"""
SELECT DISTINCT k.id, k.database_id FROM {_KEYS_SQL} k
WHERE NOT EXISTS (SELECT 1 FROM ip_whitelist w WHERE k.id = w.id AND k.database_id = w.database_id)
""")
def q_remove_ips_missing(spark, d):
    f = Fleet(spark, d)
    return access.remove_ips(f.ip_whitelist, _removal_keys(f))["missing"]


@query("remove_ips_audit", f"""
SELECT 'ip_whitelist_removed' AS action, 'database' AS resource_type,
  CAST(w.database_id AS VARCHAR) AS resource_id,
  '{{"ip_address":"' || w.ip_address || '"}}' AS details, TIMESTAMP '{AS_OF}' AS created_at
FROM ip_whitelist w
WHERE EXISTS (SELECT 1 FROM {_KEYS_SQL} k WHERE k.id = w.id AND k.database_id = w.database_id)
""")
def q_remove_ips_audit(spark, d):
    f = Fleet(spark, d)
    return access.remove_ips(f.ip_whitelist, _removal_keys(f), AS_OF)["audit"]


@query("rule_drift", f"""
WITH cur AS ({Q.ACCESS_RULES}),
kept AS (SELECT w.* FROM ip_whitelist w
         WHERE NOT EXISTS (SELECT 1 FROM {_KEYS_SQL} k WHERE k.id = w.id AND k.database_id = w.database_id)),
want AS ({Q.ACCESS_RULES.replace('ip_whitelist w', 'kept w')}),
c AS (SELECT database_name, rule_no, line FROM cur),
w AS (SELECT database_name, rule_no, line FROM want)
SELECT *, 'only_current' AS side FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM w)
UNION ALL
SELECT *, 'only_wanted' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM c)
""")
def q_rule_drift(spark, d):
    f = Fleet(spark, d)
    current = access.generate_rules(f.databases, f.ip_whitelist)
    kept = access.remove_ips(f.ip_whitelist, _removal_keys(f))["kept"]
    wanted = access.generate_rules(f.databases, kept)
    return access.rule_drift(current, wanted)


def _ip_requests(f: Fleet) -> DataFrame:
    """Requests to allow every client seen in the connection log (/32)."""
    c = f.conn_log
    return c.select(F.col("database_id"), F.concat("client_ip", F.lit("/32")).alias("ip_address"),
                    F.lit("seen in connection log").alias("description"),
                    F.col("conn_id").alias("request_no"))


_REQ_SQL = """(SELECT database_id, client_ip || '/32' AS ip_address,
  'seen in connection log' AS description, conn_id AS request_no FROM conn_log)"""


@query("add_ips_added", f"""
WITH req AS {_REQ_SQL},
ok AS (SELECT * FROM req r WHERE {Q.cidr_valid('r.ip_address')}
       AND r.database_id IN (SELECT id FROM databases)
       AND NOT EXISTS (SELECT 1 FROM ip_whitelist w WHERE w.database_id = r.database_id
                       AND w.ip_address = r.ip_address)),
firsts AS (SELECT database_id, ip_address, MIN(request_no) AS request_no FROM ok GROUP BY 1, 2)
SELECT (SELECT COALESCE(MAX(id), 0) FROM ip_whitelist) + f.request_no AS id, f.database_id,
  f.ip_address, 'seen in connection log' AS description, TIMESTAMP '{AS_OF}' AS added_at
FROM firsts f
""")
def q_add_ips_added(spark, d):
    f = Fleet(spark, d)
    return access.add_ips(_ip_requests(f), f.ip_whitelist, f.databases, AS_OF)["added"]


@query("add_ips_rejected", f"""
WITH req AS {_REQ_SQL},
v AS (SELECT * FROM req r WHERE {Q.cidr_valid('r.ip_address')}),
p AS (SELECT * FROM v WHERE database_id IN (SELECT id FROM databases)),
present AS (SELECT * FROM p WHERE EXISTS (SELECT 1 FROM ip_whitelist w
            WHERE w.database_id = p.database_id AND w.ip_address = p.ip_address)),
fresh AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ip_whitelist w
          WHERE w.database_id = p.database_id AND w.ip_address = p.ip_address)),
firsts AS (SELECT database_id, ip_address, MIN(request_no) AS first_no FROM fresh GROUP BY 1, 2)
SELECT r.*, 'invalid_ip' AS reason FROM req r WHERE NOT {Q.cidr_valid('r.ip_address')}
UNION ALL
SELECT v.*, 'database_not_found' FROM v WHERE database_id NOT IN (SELECT id FROM databases)
UNION ALL
SELECT *, 'already_listed' FROM present
UNION ALL
SELECT fr.*, 'duplicate_in_batch' FROM fresh fr JOIN firsts fi
  ON fr.database_id = fi.database_id AND fr.ip_address = fi.ip_address
WHERE fr.request_no <> fi.first_no
""")
def q_add_ips_rejected(spark, d):
    f = Fleet(spark, d)
    return access.add_ips(_ip_requests(f), f.ip_whitelist, f.databases, AS_OF)["rejected"]


@query("add_ips_audit", f"""
WITH req AS {_REQ_SQL},
ok AS (SELECT * FROM req r WHERE {Q.cidr_valid('r.ip_address')}
       AND r.database_id IN (SELECT id FROM databases)
       AND NOT EXISTS (SELECT 1 FROM ip_whitelist w WHERE w.database_id = r.database_id
                       AND w.ip_address = r.ip_address)),
firsts AS (SELECT database_id, ip_address FROM ok GROUP BY 1, 2)
SELECT 'ip_whitelist_added' AS action, 'database' AS resource_type,
  CAST(database_id AS VARCHAR) AS resource_id,
  '{{"ip_address":"' || ip_address || '"}}' AS details, TIMESTAMP '{AS_OF}' AS created_at
FROM firsts
""")
def q_add_ips_audit(spark, d):
    f = Fleet(spark, d)
    return access.add_ips(_ip_requests(f), f.ip_whitelist, f.databases, AS_OF)["audit"]


# ---------------------------------------------------------------------------
# Checks, drift, deletes
# ---------------------------------------------------------------------------
@query("orphans_shadow", """
SELECT s.* FROM shadow_databases s
WHERE s.parent_database_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM databases d WHERE d.id = s.parent_database_id)
""")
def q_orphans_shadow(spark, d):
    f = Fleet(spark, d)
    return checks.orphans(f.shadow_databases, "parent_database_id", f.databases)


@query("orphans_stats", """
SELECT s.* FROM database_stats s
WHERE s.database_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM databases d WHERE d.id = s.database_id)
""")
def q_orphans_stats(spark, d):
    f = Fleet(spark, d)
    return checks.orphans(f.database_stats, "database_id", f.databases)


@query("orphans_audit_keys", """
SELECT a.* FROM audit_logs a
WHERE a.api_key_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM api_keys k WHERE k.id = a.api_key_id)
""")
def q_orphans_audit_keys(spark, d):
    f = Fleet(spark, d)
    return checks.orphans(f.audit_logs, "api_key_id", f.api_keys)


@query("require_parent_ok", """
SELECT w.* FROM ip_whitelist w WHERE EXISTS (SELECT 1 FROM databases d WHERE d.id = w.database_id)
""")
def q_require_parent_ok(spark, d):
    f = Fleet(spark, d)
    return access.require_parent(f.ip_whitelist, "database_id", f.databases)[0]


@query("unique_shadow_username", """
SELECT shadow_username, COUNT(*) AS rows FROM shadow_databases
WHERE shadow_username IS NOT NULL GROUP BY shadow_username HAVING COUNT(*) > 1
""")
def q_unique_shadow_username(spark, d):
    return checks.unique_violations(Fleet(spark, d).shadow_databases, ["shadow_username"])


@query("unique_whitelist_pair", """
SELECT database_id, ip_address, COUNT(*) AS rows FROM ip_whitelist
WHERE database_id IS NOT NULL AND ip_address IS NOT NULL
GROUP BY database_id, ip_address HAVING COUNT(*) > 1
""")
def q_unique_whitelist_pair(spark, d):
    return checks.unique_violations(Fleet(spark, d).ip_whitelist, ["database_id", "ip_address"])


@query("column_violations", """
SELECT 'databases' AS "table", "column", rule, violations FROM (
  SELECT 'id' AS "column", 'not_null' AS rule, CAST(count_if(id IS NULL) AS BIGINT) AS violations FROM databases
  UNION ALL SELECT 'database_name', 'not_null', CAST(count_if(database_name IS NULL) AS BIGINT) FROM databases
  UNION ALL SELECT 'username', 'not_null', CAST(count_if(username IS NULL) AS BIGINT) FROM databases
  UNION ALL SELECT 'password_hash', 'not_null', CAST(count_if(password_hash IS NULL) AS BIGINT) FROM databases
  UNION ALL SELECT 'database_name', 'max_length_255', CAST(count_if(length(database_name) > 255) AS BIGINT) FROM databases
  UNION ALL SELECT 'username', 'max_length_255', CAST(count_if(length(username) > 255) AS BIGINT) FROM databases
  UNION ALL SELECT 'password_hash', 'max_length_255', CAST(count_if(length(password_hash) > 255) AS BIGINT) FROM databases
  UNION ALL SELECT 'owner_email', 'max_length_255', CAST(count_if(length(owner_email) > 255) AS BIGINT) FROM databases
  UNION ALL SELECT 'friendly_name', 'max_length_255', CAST(count_if(length(friendly_name) > 255) AS BIGINT) FROM databases
  UNION ALL SELECT 'status', 'max_length_50', CAST(count_if(length(status) > 50) AS BIGINT) FROM databases
)
""")
def q_column_violations(spark, d):
    from tenantscope import schemas
    return checks.column_violations(Fleet(spark, d).databases, "databases",
                                    schemas.NOT_NULL["databases"],
                                    schemas.VARCHAR_LIMITS["databases"])


@query("registry_drift", """
SELECT COALESCE(r.database_name, c.datname) AS database_name, r.id AS database_id, c.size_bytes,
  CASE WHEN c.datname IS NULL THEN 'missing_on_server' ELSE 'missing_in_registry' END AS drift
FROM databases r
FULL OUTER JOIN (SELECT * FROM db_catalog WHERE NOT COALESCE(datistemplate, false)) c
  ON r.database_name = c.datname
WHERE r.database_name IS NULL OR c.datname IS NULL
""")
def q_registry_drift(spark, d):
    f = Fleet(spark, d)
    return checks.registry_drift(f.databases, f.db_catalog)


@query("cascade_delete_counts", """
WITH del AS (SELECT id FROM databases WHERE status = 'suspended')
SELECT 'databases' AS "table", CAST(count_if(id IN (SELECT id FROM del)) AS BIGINT) AS deleted,
  CAST(count_if(id NOT IN (SELECT id FROM del)) AS BIGINT) AS remaining FROM databases
UNION ALL
SELECT 'ip_whitelist', CAST(count_if(database_id IN (SELECT id FROM del)) AS BIGINT),
  CAST(count_if(database_id IS NULL OR database_id NOT IN (SELECT id FROM del)) AS BIGINT) FROM ip_whitelist
UNION ALL
SELECT 'database_stats', CAST(count_if(database_id IN (SELECT id FROM del)) AS BIGINT),
  CAST(count_if(database_id IS NULL OR database_id NOT IN (SELECT id FROM del)) AS BIGINT) FROM database_stats
UNION ALL
SELECT 'shadow_databases', CAST(count_if(parent_database_id IN (SELECT id FROM del)) AS BIGINT),
  CAST(count_if(parent_database_id IS NULL OR parent_database_id NOT IN (SELECT id FROM del)) AS BIGINT) FROM shadow_databases
""")
def q_cascade_delete_counts(spark, d):
    f = Fleet(spark, d)
    ids = f.databases.filter(F.col("status") == "suspended").select("id")
    out = checks.cascade_delete({"databases": (f.databases, "id"),
                                 "ip_whitelist": (f.ip_whitelist, "database_id"),
                                 "database_stats": (f.database_stats, "database_id"),
                                 "shadow_databases": (f.shadow_databases, "parent_database_id")},
                                ids)
    return out["counts"]


@query("cascade_delete_audit", f"""
SELECT 'database_deleted' AS action, 'database' AS resource_type, CAST(id AS VARCHAR) AS resource_id,
  '{{"database_name":"' || database_name || '","username":"' || username || '"}}' AS details,
  TIMESTAMP '{AS_OF}' AS created_at
FROM databases WHERE status = 'suspended'
""")
def q_cascade_delete_audit(spark, d):
    f = Fleet(spark, d)
    ids = f.databases.filter(F.col("status") == "suspended").select("id")
    return checks.cascade_delete({"databases": (f.databases, "id")}, ids, as_of=AS_OF)["audit"]


@query("cascade_delete_whitelist", """
SELECT w.* FROM ip_whitelist w
WHERE w.database_id IS NULL
   OR w.database_id NOT IN (SELECT id FROM databases WHERE status = 'suspended')
""")
def q_cascade_delete_whitelist(spark, d):
    f = Fleet(spark, d)
    ids = f.databases.filter(F.col("status") == "suspended").select("id")
    return checks.cascade_delete({"ip_whitelist": (f.ip_whitelist, "database_id")},
                                 ids)["ip_whitelist"]


# ---------------------------------------------------------------------------
# Cache, pool and statistics feeds
# ---------------------------------------------------------------------------
@query("hit_rate_by_site", """
SELECT site, hits, misses, round(CAST(100.0 AS DOUBLE) * hits / (hits + misses), 2) AS hit_rate
FROM (SELECT split_part(cache_key, ':', 2) AS site, CAST(count_if(hit) AS BIGINT) AS hits,
             CAST(count_if(NOT hit) AS BIGINT) AS misses
      FROM cache_requests GROUP BY 1)
WHERE hits + misses > 0
""")
def q_hit_rate_by_site(spark, d):
    return ops.hit_rate(ops.with_key_parts(Fleet(spark, d).cache_requests), ["site"])


@query("hit_rate_by_db", """
SELECT db, hits, misses, round(CAST(100.0 AS DOUBLE) * hits / (hits + misses), 2) AS hit_rate
FROM (SELECT db, CAST(count_if(hit) AS BIGINT) AS hits, CAST(count_if(NOT hit) AS BIGINT) AS misses
      FROM cache_requests GROUP BY 1)
WHERE hits + misses > 0
""")
def q_hit_rate_by_db(spark, d):
    return ops.hit_rate(Fleet(spark, d).cache_requests, ["db"])


@query("keys_per_db", """
SELECT db, COUNT(DISTINCT cache_key) AS keys FROM cache_requests
WHERE cache_key IS NOT NULL GROUP BY db
""")
def q_keys_per_db(spark, d):
    return ops.keys_per_db(Fleet(spark, d).cache_requests)


@query("cache_key_parts", """
SELECT request_id, cache_key, split_part(cache_key, ':', 2) AS site,
  split_part(cache_key, ':', 3) AS type,
  substring(cache_key, length(split_part(cache_key, ':', 1)) + length(split_part(cache_key, ':', 2))
            + length(split_part(cache_key, ':', 3)) + 4) AS rest
FROM cache_requests
""")
def q_cache_key_parts(spark, d):
    return ops.with_key_parts(Fleet(spark, d).cache_requests) \
              .select("request_id", "cache_key", "site", "type", "rest")


@query("cache_by_site", """
SELECT split_part(cache_key, ':', 2) AS site, split_part(cache_key, ':', 3) AS type,
  COUNT(DISTINCT cache_key) AS keys, COUNT(*) AS requests, CAST(count_if(hit) AS BIGINT) AS hits
FROM cache_requests GROUP BY 1, 2
""")
def q_cache_by_site(spark, d):
    return ops.cache_by_site(Fleet(spark, d).cache_requests)


@query("cache_savings", """
SELECT date, requests, misses, round(requests * CAST(0.03 AS DOUBLE), 4) AS cost_all,
  round(misses * CAST(0.03 AS DOUBLE), 4) AS cost_miss,
  round((requests - misses) * CAST(0.03 AS DOUBLE), 4) AS saved,
  round(CAST(100.0 AS DOUBLE) * (requests - misses) / requests, 2) AS saved_pct
FROM (SELECT CAST(ts AS DATE) AS date, COUNT(*) AS requests, CAST(count_if(NOT hit) AS BIGINT) AS misses
      FROM cache_requests GROUP BY 1)
""")
def q_cache_savings(spark, d):
    return ops.cache_savings(Fleet(spark, d).cache_requests)


@query("last_slow_cache", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY db ORDER BY ts DESC, request_id DESC) AS pos
  FROM cache_requests WHERE duration_us > 10000)
WHERE pos <= 5
""")
def q_last_slow_cache(spark, d):
    return ops.last_slow(Fleet(spark, d).cache_requests).withColumn("pos", F.col("pos").cast("bigint"))


@query("pool_usage", """
SELECT pool_database, COUNT(*) AS snapshots,
  CAST(SUM(cl_active + cl_waiting) AS BIGINT) AS clients,
  CAST(SUM(sv_active + sv_idle + sv_used) AS BIGINT) AS servers,
  MAX(cl_active) AS peak_cl_active, MAX(sv_active) AS peak_sv_active,
  CAST(SUM(cl_waiting) AS BIGINT) AS waiting,
  CASE WHEN SUM(cl_active + cl_waiting) > 0
       THEN round(CAST(1.0 AS DOUBLE) - CAST(SUM(sv_active + sv_idle + sv_used) AS DOUBLE)
                  / SUM(cl_active + cl_waiting), 4)
  END AS multiplex_ratio
FROM pool_snapshot GROUP BY pool_database
""")
def q_pool_usage(spark, d):
    return ops.pool_usage(Fleet(spark, d).pool_snapshot)


@query("stats_rollup", """
SELECT database_id, COUNT(*) AS samples,
  arg_max(size_bytes, (recorded_at, total_queries, seq, size_bytes)) AS latest_size,
  MAX(recorded_at) AS latest_at, MAX(size_bytes) AS peak_size,
  round(AVG(active_connections), 4) AS avg_connections
FROM database_stats GROUP BY database_id
""")
def q_stats_rollup(spark, d):
    return ops.stats_rollup(Fleet(spark, d).database_stats)


# ---------------------------------------------------------------------------
# Text feeds
# ---------------------------------------------------------------------------
from tenantscope.operators import text_vector as TV, windows as W  # noqa: E402
from tenantscope.sources import control, logs  # noqa: E402

_SL = logs.SERVER_LOG_PATTERN


def _server_log_sql(where: str = "") -> str:
    names = ", ".join(f"'g{i}'" for i in range(1, 11))
    return f"""
SELECT CAST(m.g1 AS TIMESTAMP) AS ts, m.g2 AS tz, CAST(m.g3 AS BIGINT) AS pid,
  CAST(m.g4 AS BIGINT) AS line_no, m.g5 AS usr, m.g6 AS db, m.g7 AS app,
  m.g8 AS client, m.g9 AS level, m.g10 AS message,
  TRY_CAST(regexp_extract(m.g10, '{logs.DURATION_PATTERN}', 1) AS DOUBLE) AS duration_ms
FROM (SELECT regexp_extract(value, '{_SL}', [{names}]) AS m FROM server_log
      WHERE regexp_matches(value, '{_SL}')) {where}"""


@query("server_log_parsed", _server_log_sql())
def q_server_log_parsed(spark, d):
    return logs.parse_server_log(Fleet(spark, d).server_log)[0]


@query("slow_statements", "SELECT * FROM (" + _server_log_sql() + ") WHERE duration_ms >= 1000")
def q_slow_statements(spark, d):
    return ops.slow(logs.parse_server_log(Fleet(spark, d).server_log)[0], "duration_ms",
                    ops.SLOW_STATEMENT_MS)


def access_log_lines(audit_df: DataFrame) -> DataFrame:
    """The API's access log as it would have been printed for the audit
    trail's requests (one ``ISO METHOD path`` line per event)."""
    a = F.col("action")
    rid = F.col("resource_id")
    method = (F.when(a.isin("database_created", "ip_whitelist_added"), "POST")
              .when(a.isin("database_deleted", "ip_whitelist_removed"), "DELETE").otherwise("GET"))
    path = (F.when(a == "database_created", F.lit("/api/databases"))
            .when(a == "database_deleted", F.concat(F.lit("/api/databases/"), rid))
            .when(a == "ip_whitelist_added", F.concat(F.lit("/api/databases/"), rid, F.lit("/whitelist")))
            .when(a == "ip_whitelist_removed",
                  F.concat(F.lit("/api/databases/"), rid, F.lit("/whitelist/"), F.col("id").cast("string")))
            .otherwise(F.concat(F.lit("/api/databases/"), rid, F.lit("/stats"))))
    ts = F.date_format(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return audit_df.select(F.concat_ws(" ", ts, method, path).alias("value"))


@query("api_routes", """
SELECT CAST(created_at AS DATE) AS date,
  CASE WHEN action IN ('database_created', 'ip_whitelist_added') THEN 'POST'
       WHEN action IN ('database_deleted', 'ip_whitelist_removed') THEN 'DELETE' ELSE 'GET' END AS method,
  CASE action WHEN 'database_created' THEN '/api/databases'
              WHEN 'database_deleted' THEN '/api/databases/:id'
              WHEN 'ip_whitelist_added' THEN '/api/databases/:id/whitelist'
              WHEN 'ip_whitelist_removed' THEN '/api/databases/:id/whitelist/:id'
              ELSE '/api/databases/:id/stats' END AS route,
  COUNT(*) AS requests
FROM audit_logs GROUP BY 1, 2, 3
""")
def q_api_routes(spark, d):
    parsed, _ = logs.parse_access_log(access_log_lines(Fleet(spark, d).audit_logs))
    return parsed.groupBy(F.to_date("ts").alias("date"), "method", "route") \
                 .agg(F.count(F.lit(1)).alias("requests"))


# Logs as they are found: lines cut short, dates that are none, other levels.
_BROKEN_SQL = """(SELECT CASE WHEN value LIKE '%0.000 ms%' THEN substring(value, 5, 30)
    WHEN value LIKE '%1.000 ms%' THEN '2024-02-30' || substring(value, 11)
    WHEN value LIKE '%2.000 ms%' THEN replace(value, ' LOG: ', ' DEBUG1: ') ELSE value END AS value
  FROM server_log)"""


@query("server_log_quality", f"""
SELECT CASE WHEN regexp_matches(value, '{_SL}')
              AND TRY_CAST(regexp_extract(value, '{_SL}', 1) AS TIMESTAMP) IS NOT NULL
            THEN regexp_extract(value, '{_SL}', 9) ELSE '_bad' END AS level, COUNT(*) AS lines
FROM {_BROKEN_SQL} GROUP BY 1
""")
def q_server_log_quality(spark, d):
    v = F.col("value")
    broken = Fleet(spark, d).server_log.select(
        F.when(v.like("%0.000 ms%"), F.substring(v, 5, 30))
        .when(v.like("%1.000 ms%"), F.concat(F.lit("2024-02-30"), F.expr("substring(value, 11)")))
        .when(v.like("%2.000 ms%"), F.replace(v, F.lit(" LOG: "), F.lit(" DEBUG1: "))).otherwise(v).alias("value"))
    good, bad = logs.parse_server_log(broken)
    return (good.select("level").unionByName(bad.select(F.lit("_bad").alias("level")))
            .groupBy("level").agg(F.count(F.lit(1)).alias("lines")))


@query("access_log_quality", """
SELECT CASE WHEN id % 7 < 3 THEN '_bad' WHEN action IN ('database_created', 'ip_whitelist_added') THEN 'POST'
            WHEN action IN ('database_deleted', 'ip_whitelist_removed') THEN 'DELETE' ELSE 'GET' END AS method,
  COUNT(*) AS lines
FROM audit_logs GROUP BY 1
""")
def q_access_log_quality(spark, d):
    a = Fleet(spark, d).audit_logs
    k = a["id"] % 7
    lines = access_log_lines(a.filter(k >= 3)).unionByName(a.filter(k < 3).select(
        F.when(k == 0, "garbage").when(k == 1, "notatime GET /y").otherwise("2024-13-01T00:00:00.000Z GET /z").alias("value")))
    good, bad = logs.parse_access_log(lines)
    return (good.select("method").unionByName(bad.select(F.lit("_bad").alias("method")))
            .groupBy("method").agg(F.count(F.lit(1)).alias("lines")))


@query("pool_table", """
SELECT pool_database, pool_user, cl_active, cl_waiting, sv_active, sv_idle, sv_used
FROM pool_snapshot
""")
def q_pool_table(spark, d):
    lines = control.render_pools(Fleet(spark, d).pool_snapshot)
    head = spark.createDataFrame(
        [(" " + " | ".join(control.POOL_COLUMNS),), ("-" * 20 + "+" + "-" * 10,)], "value string")
    return control.parse_pools(head.unionByName(lines))


def cache_info_lines(cache: DataFrame) -> DataFrame:
    """INFO-style ``name:value`` lines per cache host (one host per cache
    database), as the monitor reads them."""
    agg = cache.groupBy(F.concat(F.lit("cache-"), F.col("db").cast("string")).alias("host")) \
               .agg(F.count_if("hit").alias("h"), F.count_if(~F.col("hit")).alias("m"))
    return agg.select("host", F.explode(F.array(
        F.concat(F.lit("keyspace_hits:"), F.col("h").cast("string")),
        F.concat(F.lit("keyspace_misses:"), F.col("m").cast("string")),
        F.lit("# Stats"))).alias("value"))


@query("cache_info_hit_rate", """
SELECT 'cache-' || CAST(db AS VARCHAR) AS host, CAST(count_if(hit) AS BIGINT) AS keyspace_hits,
  CAST(count_if(NOT hit) AS BIGINT) AS keyspace_misses,
  round(CAST(100.0 AS DOUBLE) * CAST(count_if(hit) AS BIGINT) / COUNT(*), 2) AS hit_rate
FROM cache_requests GROUP BY db
""")
def q_cache_info_hit_rate(spark, d):
    info = logs.parse_cache_info(cache_info_lines(Fleet(spark, d).cache_requests))
    h, m = F.col("keyspace_hits"), F.col("keyspace_misses")
    return info.filter((h + m) > 0).select(
        "host", h.cast("bigint").alias("keyspace_hits"), m.cast("bigint").alias("keyspace_misses"),
        F.round(F.lit(100.0) * h / (h + m), 2).alias("hit_rate"))


@query("rules_file_lines", f"""
WITH rules AS ({Q.ACCESS_RULES}),
heads AS (SELECT DISTINCT database_name FROM rules)
SELECT database_name, rule_no, line FROM rules
UNION ALL SELECT database_name, -1, '' FROM heads
UNION ALL SELECT database_name, 0, '# Rules for ' || database_name FROM heads
""")
def q_rules_file_lines(spark, d):
    f = Fleet(spark, d)
    return access.rules_text(access.generate_rules(f.databases, f.ip_whitelist)) \
                 .orderBy("database_name", "rule_no")


# ---------------------------------------------------------------------------
# Windows (R66-R68)
# ---------------------------------------------------------------------------
_STATS_W = "PARTITION BY database_id ORDER BY recorded_at, total_queries, seq, size_bytes"


@query("size_growth", f"""
SELECT database_id, recorded_at, total_queries, seq, size_bytes, prev_size, prev_at,
  size_bytes - prev_size AS size_change, days,
  CASE WHEN days > 0 THEN round((size_bytes - prev_size) / days, 4) END AS bytes_per_day
FROM (SELECT *, date_diff('day', CAST(prev_at AS DATE), CAST(recorded_at AS DATE)) AS days
      FROM (SELECT *, lag(size_bytes) OVER ({_STATS_W}) AS prev_size,
                   lag(recorded_at) OVER ({_STATS_W}) AS prev_at
            FROM database_stats))
""")
def q_size_growth(spark, d):
    return W.size_growth(Fleet(spark, d).database_stats).withColumn("days", F.col("days").cast("bigint"))


@query("rolling_connections", f"""
SELECT database_id, recorded_at, total_queries, seq, size_bytes, active_connections,
  round(AVG(active_connections) OVER w, 4) AS rolling_avg,
  MAX(active_connections) OVER w AS rolling_max, COUNT(*) OVER w AS window_rows
FROM database_stats
WINDOW w AS ({_STATS_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")
def q_rolling_connections(spark, d):
    return W.rolling_connections(Fleet(spark, d).database_stats)


@query("chat_history_last3", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r <= 3
""")
def q_chat_history_last3(spark, d):
    return W.chat_history(Fleet(spark, d).raw("conversations"), 3)


# ---------------------------------------------------------------------------
# Text and vector
# ---------------------------------------------------------------------------
_CENTROIDS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pos AS (SELECT label, i, AVG(x) AS m FROM (
          SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY label, i),
c AS (SELECT label AS qid, list(m ORDER BY i) AS cv FROM pos GROUP BY label),
s AS (SELECT qid, vec_id, list_dot_product(cv, v) / (sqrt(list_dot_product(cv, cv))
             * sqrt(list_dot_product(v, v))) AS score FROM c, e)"""


def _centroid_queries(spark, d) -> DataFrame:
    return TV.centroids(Fleet(spark, d).raw("embeddings"), "label").withColumnRenamed("label", "qid")


@query("vector_topk_centroids", f"""
WITH {_CENTROIDS}
SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 3
""")
def q_vector_topk_centroids(spark, d):
    r = TV.vector_topk(_centroid_queries(spark, d), Fleet(spark, d).raw("embeddings"), k=3)
    return r.withColumn("score", F.round("score", 6))


@query("semantic_lookup_centroids", f"""
WITH {_CENTROIDS},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r
                     FROM s) WHERE r = 1)
SELECT qid, CASE WHEN score >= 0.5 THEN vec_id END AS vec_id, round(score, 6) AS score,
  COALESCE(score >= 0.5, false) AS hit
FROM b
""")
def q_semantic_lookup_centroids(spark, d):
    r = TV.semantic_lookup(_centroid_queries(spark, d), Fleet(spark, d).raw("embeddings"), 0.5)
    return r.withColumn("score", F.round("score", 6))


@query("ilike_license", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE text ILIKE '%license%'
""")
def q_ilike_license(spark, d):
    return TV.ilike_search(Fleet(spark, d).raw("documents"), "text", "%license%") \
             .select("doc_id", "lang", "source", "n_chars")


def _grams_sql(table: str, id_col: str) -> str:
    return f"""(SELECT DISTINCT {id_col} AS rid, substring(pw, i, 3) AS g FROM (
  SELECT {id_col}, '  ' || word || ' ' AS pw FROM (
    SELECT {id_col}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word
    FROM {table}) WHERE length(word) > 0), range(1, length(pw) - 1) r(i))"""


TRGM_BENCH_T = 0.1


@query("trigram_benchmark_docs", f"""
WITH ga AS {_grams_sql('benchmark', 'item_id')},
gb AS {_grams_sql('documents', 'doc_id')},
na AS (SELECT rid, COUNT(*) AS n FROM ga GROUP BY rid),
nb AS (SELECT rid, COUNT(*) AS n FROM gb GROUP BY rid),
sh AS (SELECT ga.rid AS a, gb.rid AS b, COUNT(*) AS shared FROM ga JOIN gb ON ga.g = gb.g
       GROUP BY 1, 2)
SELECT sh.a AS item_id, sh.b AS doc_id, shared, na.n AS a_grams, nb.n AS b_grams,
  round(shared / (na.n + nb.n - shared), 6) AS similarity
FROM sh JOIN na ON na.rid = sh.a JOIN nb ON nb.rid = sh.b
WHERE shared / (na.n + nb.n - shared) >= {TRGM_BENCH_T}
""")
def q_trigram_benchmark_docs(spark, d):
    f = Fleet(spark, d)
    return TV.trigram_join(f.raw("benchmark"), f.raw("documents"), "item_id", "text",
                           "doc_id", "text", TRGM_BENCH_T)


@query("trigram_benchmark_docs_close", f"""
WITH ga AS {_grams_sql('benchmark', 'item_id')},
gb AS {_grams_sql('documents', 'doc_id')},
na AS (SELECT rid, COUNT(*) AS n FROM ga GROUP BY rid),
nb AS (SELECT rid, COUNT(*) AS n FROM gb GROUP BY rid),
sh AS (SELECT ga.rid AS a, gb.rid AS b, COUNT(*) AS shared FROM ga JOIN gb ON ga.g = gb.g
       GROUP BY 1, 2)
SELECT sh.a AS item_id, sh.b AS doc_id, shared, na.n AS a_grams, nb.n AS b_grams,
  round(shared / (na.n + nb.n - shared), 6) AS similarity
FROM sh JOIN na ON na.rid = sh.a JOIN nb ON nb.rid = sh.b
WHERE 5 * shared >= 2 * (na.n + nb.n - shared)
""")
def q_trigram_benchmark_docs_close(spark, d):
    f = Fleet(spark, d)
    return TV.trigram_join(f.raw("benchmark"), f.raw("documents"), "item_id", "text",
                           "doc_id", "text", 0.4, method="prefix")


@query("trigram_near_duplicates", f"""
WITH t AS MATERIALIZED (SELECT rid, list_sort(list(g)) AS s, COUNT(*) AS n FROM {_grams_sql('documents', 'doc_id')} GROUP BY rid),
p AS (SELECT a.rid AS a_doc_id, b.rid AS b_doc_id, len(list_intersect(a.s, b.s)) AS shared, a.n AS a_grams, b.n AS b_grams
      FROM t a JOIN t b ON a.rid < b.rid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n)
SELECT a_doc_id, b_doc_id, CAST(shared AS BIGINT) AS shared, a_grams, b_grams,
  round(shared / (a_grams + b_grams - shared), 6) AS similarity
FROM p WHERE 5 * shared >= 4 * (a_grams + b_grams - shared)
""")
def q_trigram_near_duplicates(spark, d):
    docs = Fleet(spark, d).raw("documents")
    return TV.trigram_join(docs, docs, "doc_id", "text", "doc_id", "text", 0.8, self_join=True)


_WORDS_SQL = """(SELECT doc_id, word FROM (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents)
  WHERE length(word) > 0)"""


@query("word_counts_ci", f"""
SELECT word, COUNT(*) AS n, COUNT(DISTINCT doc_id) AS records FROM {_WORDS_SQL} GROUP BY word
""")
def q_word_counts_ci(spark, d):
    return TV.word_counts_ci(Fleet(spark, d).raw("documents"), "doc_id", "text")


from tenantscope.functions.scalars import ACCENTED, LIGATURES, UNACCENTED  # noqa: E402

_FOLDED_CHARS = ACCENTED + "".join(a for a, _ in LIGATURES)


def _unaccent_sql(x: str) -> str:
    out = f"translate({x}, '{ACCENTED}', '{UNACCENTED}')"
    for a, b in LIGATURES:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query("unaccent_digest", f"""
SELECT doc_id, sha256({_unaccent_sql('text')}) AS text_key,
  length(text) - length(regexp_replace(text, '[{_FOLDED_CHARS}]', '', 'g')) AS accented_chars
FROM documents
""")
def q_unaccent_digest(spark, d):
    docs = Fleet(spark, d).raw("documents")
    return TV.unaccent(docs, "text", "u").select(
        "doc_id", F.sha2("u", 256).alias("text_key"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{_FOLDED_CHARS}]", ""))).cast("bigint")
        .alias("accented_chars"))


@query("owner_digest", """
SELECT id, sha256(owner_email) AS owner_digest FROM databases
""")
def q_owner_digest(spark, d):
    from tenantscope.functions.scalars import digest
    return Fleet(spark, d).databases.select("id", digest("owner_email").alias("owner_digest"))


@query("owner_groups_ci", """
SELECT lower(owner_email) AS owner_email_ci, COUNT(*) AS n, COUNT(DISTINCT id) AS records
FROM databases GROUP BY 1
""")
def q_owner_groups_ci(spark, d):
    return TV.ci_group(Fleet(spark, d).databases, "owner_email", "id")


@query("kv_metadata", """
SELECT id, json_exists(details, '$.k') AS has_key, key,
  json_extract_string(details, '$."' || key || '"') AS value
FROM audit_logs, unnest(json_keys(details)) t(key)
UNION ALL
SELECT id, json_exists(details, '$.k'), 'source', 'audit' FROM audit_logs
""")
def q_kv_metadata(spark, d):
    return TV.kv_ops(Fleet(spark, d).audit_logs, "id", "details", {"source": "audit"}, key="k")


# Rows whose own ``source`` gives way to the merged one.
@query("kv_metadata_shared_key", """
SELECT id, true AS has_key, unnest(['k', 'source']) AS key, unnest([CAST(id AS VARCHAR), 'audit']) AS value
FROM audit_logs
""")
def q_kv_metadata_shared_key(spark, d):
    a = Fleet(spark, d).audit_logs.withColumn("details", F.to_json(F.struct(
        F.col("id").cast("string").alias("k"), F.lit("feed").alias("source"))))
    return TV.kv_ops(a, "id", "details", {"source": "audit"}, key="k")


@query("path_rollup", """
WITH p AS (SELECT list_filter(string_split(regexp_extract(url,
             '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: length(s) > 0) AS segs
           FROM pages),
d AS (SELECT segs, unnest(range(0, len(segs) + 1)) AS depth FROM p)
SELECT CASE WHEN depth = 0 THEN '/' ELSE '/' || array_to_string(segs[1:depth], '/') END AS prefix,
  depth, COUNT(*) AS records
FROM d GROUP BY 1, 2
""")
def q_path_rollup(spark, d):
    return TV.path_rollup(Fleet(spark, d).raw("pages"), "url").withColumn("depth", F.col("depth").cast("bigint"))


# ---------------------------------------------------------------------------
# Stream batch twins (R79-R82); the streams themselves run in tests
# ---------------------------------------------------------------------------
from tenantscope.streaming import streams as ST  # noqa: E402


@query("audit_summary_windows", """
SELECT CAST(created_at AS DATE) AS date, action, COUNT(*) AS count FROM audit_logs GROUP BY 1, 2
""")
def q_audit_summary_windows(spark, d):
    return ST.audit_summary_windows(Fleet(spark, d).audit_logs)


@query("connection_rate_windows", """
WITH b AS (SELECT database_id,
             make_timestamp(CAST(floor(epoch_us(ts) / 300000000) * 300000000 AS BIGINT)) AS s0
           FROM conn_log),
w AS (SELECT database_id, unnest([s0 - INTERVAL 5 MINUTE, s0]) AS window_start FROM b)
SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, database_id,
  COUNT(*) AS connections
FROM w GROUP BY 1, 2, 3
""")
def q_connection_rate_windows(spark, d):
    return ST.connection_rate(Fleet(spark, d).conn_log)


@query("client_sessions", """
WITH o AS (SELECT database_id, ts,
             CASE WHEN lag(ts) OVER (PARTITION BY database_id ORDER BY ts) IS NULL
                    OR ts >= lag(ts) OVER (PARTITION BY database_id ORDER BY ts) + INTERVAL 30 MINUTE
                  THEN 1 ELSE 0 END AS new_s
           FROM conn_log),
n AS (SELECT *, SUM(new_s) OVER (PARTITION BY database_id ORDER BY ts
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o)
SELECT database_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end,
  COUNT(*) AS events
FROM n GROUP BY database_id, sid
""")
def q_client_sessions(spark, d):
    return ST.sessions(Fleet(spark, d).conn_log)


@query("cache_ttl_hits", """
SELECT r.* FROM cache_requests r
WHERE EXISTS (SELECT 1 FROM cache_requests w
              WHERE NOT w.hit AND w.cache_key = r.cache_key AND w.ts < r.ts
                AND w.ts >= r.ts - INTERVAL 3600 SECOND)
""")
def q_cache_ttl_hits(spark, d):
    c = Fleet(spark, d).cache_requests
    return ST.ttl_hits(c, ST.cache_fills(c))


@query("cache_ttl_hits_split4", """
SELECT r.* FROM cache_requests r
WHERE EXISTS (SELECT 1 FROM cache_requests w
              WHERE NOT w.hit AND w.cache_key = r.cache_key AND w.ts < r.ts
                AND w.ts >= r.ts - INTERVAL 600 SECOND)
""")
def q_cache_ttl_hits_split4(spark, d):
    c = Fleet(spark, d).cache_requests
    return ST.ttl_hits(c, ST.cache_fills(c), ttl_seconds=600, splits=4)


from tenantscope.plans import roundtrips  # noqa: E402, F401
