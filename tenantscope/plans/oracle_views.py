"""The fixture views in DuckDB SQL, for the oracle side of the correctness
check (the Spark side builds the same views in ``sources.fixtures``)."""

from __future__ import annotations

import re

VIEW_SQL = {
    "databases": """
SELECT c_custkey AS id,
  concat('tenant_', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS database_name,
  concat('user_', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS username,
  sha256(concat('user_', lpad(CAST(c_custkey AS VARCHAR), 8, '0'))) AS password_hash,
  concat('owner', CAST(c_custkey % 97 AS VARCHAR), '@example.com') AS owner_email,
  c_name AS friendly_name,
  CAST(10 + 10 * (c_custkey % 5) AS INT) AS max_connections,
  CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'suspended' END AS status,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + c_custkey * INTERVAL '1' HOUR AS created_at,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + c_custkey * INTERVAL '1' HOUR AS updated_at
FROM customer""",
    "ip_whitelist": """
SELECT o_orderkey AS id, o_custkey AS database_id,
  concat('10.', CAST(o_custkey % 256 AS VARCHAR), '.', CAST(o_orderkey % 256 AS VARCHAR), '.',
         CASE WHEN o_orderkey % 13 = 0 THEN '300' ELSE '0' END,
         CASE o_orderkey % 5 WHEN 0 THEN '/8' WHEN 1 THEN '/16' WHEN 2 THEN '/24'
                             WHEN 3 THEN '/32' ELSE '' END) AS ip_address,
  o_orderpriority AS description, o_orderdate AS added_at
FROM orders WHERE o_orderkey % 4 = 0""",
    "api_keys": """
SELECT s_suppkey AS id, concat('hash_', s_name) AS key_hash, s_name AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN '{"databases": ["create", "read"]}'
       ELSE '{"databases": ["read"]}' END AS permissions,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL
       ELSE CAST('2024-01-01 00:00:00' AS TIMESTAMP) + s_suppkey * INTERVAL '12' HOUR END AS expires_at
FROM supplier""",
    "audit_logs": """
SELECT event_id AS id, user_id % 12 AS api_key_id,
  CASE event_type WHEN 'signup' THEN 'database_created' WHEN 'error' THEN 'database_deleted'
       WHEN 'click' THEN 'ip_whitelist_added' WHEN 'view' THEN 'ip_whitelist_removed'
       ELSE 'other' END AS action,
  'database' AS resource_type, CAST(user_id AS VARCHAR) AS resource_id,
  props AS details, ts AS created_at
FROM events""",
    "database_stats": """
SELECT l_orderkey AS total_queries, l_suppkey AS database_id,
  CAST(floor(l_extendedprice * 1024) AS BIGINT) AS size_bytes,
  CAST(l_quantity AS INT) AS active_connections, l_shipdate AS recorded_at,
  l_linenumber AS seq
FROM lineitem""",
    "shadow_databases": """
SELECT p_partkey AS id, p_partkey AS parent_database_id,
  concat('shadow_', CAST(p_partkey AS VARCHAR)) AS shadow_database_name,
  concat('su_', p_brand) AS shadow_username, 'active' AS status
FROM part""",
    "activity": """
SELECT event_id AS pid, concat('tenant_', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS datname
FROM events WHERE event_type = 'click'""",
    "db_catalog": """
SELECT concat('tenant_', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS datname,
  p_partkey % 50 = 0 AS datistemplate,
  CAST(floor(p_retailprice * 1000000) AS BIGINT) AS size_bytes
FROM part WHERE p_partkey % 7 <> 0""",
    "pool_snapshot": """
SELECT concat('tenant_', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) AS pool_database,
  concat('user_', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) AS pool_user,
  CAST(o_orderkey % 50 AS INT) AS cl_active, CAST(o_orderkey % 7 AS INT) AS cl_waiting,
  CAST(o_orderkey % 25 AS INT) AS sv_active, CAST(o_orderkey % 5 AS INT) AS sv_idle,
  CAST(o_orderkey % 3 AS INT) AS sv_used, o_orderdate AS ts
FROM orders""",
    "conn_log": """
SELECT event_id AS conn_id, user_id AS database_id,
  concat('10.', CAST((user_id + event_id % 3) % 256 AS VARCHAR), '.',
         CAST(event_id % 256 AS VARCHAR), '.',
         CAST(CAST(floor(value) AS BIGINT) % 256 AS VARCHAR)) AS client_ip,
  event_id % 2 = 0 AS is_ssl, ts
FROM events""",
    "server_log": """
SELECT concat(substring(CAST(ts AS VARCHAR), 1, 19), ' UTC [', CAST(event_id AS VARCHAR),
  ']: [1-1] user=user_', lpad(CAST(user_id AS VARCHAR), 8, '0'),
  ',db=tenant_', lpad(CAST(user_id AS VARCHAR), 8, '0'),
  ',app=psql,client=10.0.0.', CAST(user_id % 256 AS VARCHAR),
  ' LOG:  duration: ', CAST(CAST(floor(value * 20) AS BIGINT) AS VARCHAR),
  '.000 ms  statement: SELECT ', CAST(user_id AS VARCHAR)) AS value
FROM events""",
    "cache_requests": """
SELECT event_id AS request_id, ts, CAST(user_id % 16 AS INT) AS db,
  concat('site:store_', CAST(user_id % 5 AS VARCHAR), ':',
         CASE event_type WHEN 'view' THEN 'products' WHEN 'click' THEN 'session' ELSE 'ai' END,
         CASE WHEN event_type = 'purchase' THEN ':embeddings:doc_' ELSE ':' END,
         CAST(user_id AS VARCHAR)) AS cache_key,
  value >= 20 AS hit, CAST(floor(value * 1000) AS BIGINT) AS duration_us
FROM events""",
    "backups": """
SELECT concat('postgres_control_', CAST(o_orderkey AS VARCHAR), '.sql.gz') AS name,
  o_orderdate AS mtime
FROM orders WHERE o_orderkey % 10 = 0""",
    "tenant_requests": """
SELECT CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS friendly_name,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat('o', CAST(c_custkey AS VARCHAR), '@example.com') END AS owner_email,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 0
       ELSE CAST(c_custkey % 40 AS INT) END AS max_connections,
  c_custkey AS request_no
FROM customer""",
}



def with_views(body: str) -> str:
    """Prefix ``body`` with ``WITH`` definitions of the fixture views it
    names (word match), in dependency-free order."""
    body = body.strip()
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in used)
    if re.match(r"(?i)^with\s", body):
        return f"WITH {ctes},\n{body[5:].lstrip()}"
    return f"WITH {ctes}\n{body}"
