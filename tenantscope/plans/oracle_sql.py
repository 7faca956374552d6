"""DuckDB SQL fragments mirroring the Column functions, for the oracle."""

from __future__ import annotations


def format_bytes(b: str) -> str:
    idx = "CASE " + " ".join(f"WHEN {b} >= {1024 ** i} THEN {i}" for i in range(5, 0, -1)) + " ELSE 0 END"
    return (f"CASE WHEN {b} IS NULL THEN NULL WHEN {b} = 0 THEN '0 Bytes' ELSE "
            f"regexp_replace(printf('%.2f', round(CAST({b} AS DOUBLE) / pow(1024, {idx}), 2)), '\\.?0+$', '')"
            f" || ' ' || (['Bytes','KB','MB','GB','TB','PB'])[({idx}) + 1] END")


def size_pretty(v: str) -> str:
    a = f"abs(CAST({v} AS BIGINT))"
    sign = f"(CASE WHEN {v} < 0 THEN -1 ELSE 1 END)"
    s1 = f"({a} >> 9)"
    s2 = f"({s1} >> 10)"
    s3 = f"({s2} >> 10)"
    s4 = f"({s3} >> 10)"
    s5 = f"({s4} >> 10)"

    def half(x):
        return f"(({x} + 1) >> 1)"

    def fmt(x, u):
        return f"CAST({sign} * {x} AS VARCHAR) || ' {u}'"

    return (f"CASE WHEN {v} IS NULL THEN NULL "
            f"WHEN {a} < 10240 THEN {fmt(a, 'bytes')} "
            f"WHEN {s1} < 20479 THEN {fmt(half(s1), 'kB')} "
            f"WHEN {s2} < 20479 THEN {fmt(half(s2), 'MB')} "
            f"WHEN {s3} < 20479 THEN {fmt(half(s3), 'GB')} "
            f"WHEN {s4} < 20479 THEN {fmt(half(s4), 'TB')} "
            f"ELSE {fmt(half(s5), 'PB')} END")


def cidr_valid(ip: str) -> str:
    host = f"split_part({ip}, '/', 1)"
    octs = " AND ".join(f"TRY_CAST(split_part({host}, '.', {i}) AS INT) <= 255" for i in range(1, 5))
    return (f"COALESCE(regexp_matches({ip}, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}(/[0-9]{{1,2}})?$') "
            f"AND {octs}, false)")


def cidr_prefix(ip: str) -> str:
    return f"(CASE WHEN contains({ip}, '/') THEN TRY_CAST(split_part({ip}, '/', 2) AS INT) ELSE 32 END)"


def cidr_prefix_ok(ip: str) -> str:
    return f"COALESCE({cidr_prefix(ip)} BETWEEN 0 AND 32, false)"


def ipv4_num(ip: str) -> str:
    host = f"split_part({ip}, '/', 1)"
    p = [f"TRY_CAST(split_part({host}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    return f"({p[0]} * 16777216 + {p[1]} * 65536 + {p[2]} * 256 + {p[3]})"


def cidr_lo(ip: str) -> str:
    n = ipv4_num(ip)
    return f"(CASE WHEN {cidr_prefix_ok(ip)} THEN {n} - {n} % (CAST(1 AS BIGINT) << (32 - {cidr_prefix(ip)})) END)"


def cidr_hi(ip: str) -> str:
    return f"(CASE WHEN {cidr_prefix_ok(ip)} THEN {cidr_lo(ip)} + (CAST(1 AS BIGINT) << (32 - {cidr_prefix(ip)})) - 1 END)"


def cidr_normalized(ip: str) -> str:
    return f"(CASE WHEN contains({ip}, '/') THEN {ip} ELSE {ip} || '/32' END)"


def tenant_name(id_expr: str, prefix: str = "tenant_") -> str:
    return f"concat('{prefix}', lpad(CAST({id_expr} AS VARCHAR), 8, '0'))"


# Access rules (generate_rules) as a CTE body.
ACCESS_RULES = f"""
SELECT * FROM (
  SELECT t.database_name, t.username,
    CAST(row_number() OVER (PARTITION BY t.database_name ORDER BY w.id) AS INT) AS rule_no,
    'allow' AS kind, {cidr_normalized('w.ip_address')} AS cidr, 'scram-sha-256' AS method,
    {cidr_prefix('w.ip_address')} AS prefix_len,
    {cidr_lo('w.ip_address')} AS lo, {cidr_hi('w.ip_address')} AS hi,
    'hostssl ' || t.database_name || '             ' || t.username || '             '
      || {cidr_normalized('w.ip_address')} || '                    scram-sha-256' AS line
  FROM ip_whitelist w JOIN databases t ON w.database_id = t.id
  WHERE t.status = 'active' AND {cidr_valid('w.ip_address')} AND {cidr_prefix_ok('w.ip_address')}
) allow_rows
UNION ALL
SELECT database_name, username, CAST(n + r.i AS INT) AS rule_no, 'reject' AS kind, r.cidr,
  'reject' AS method, CAST(NULL AS INT) AS prefix_len, CAST(NULL AS BIGINT) AS lo,
  CAST(NULL AS BIGINT) AS hi,
  'host    ' || database_name || '             ' || username || '             '
    || CASE WHEN r.i = 1 THEN '0.0.0.0/0               reject' ELSE '::/0                    reject' END AS line
FROM (
  SELECT t.database_name, t.username, COUNT(*) AS n
  FROM ip_whitelist w JOIN databases t ON w.database_id = t.id
  WHERE t.status = 'active' AND {cidr_valid('w.ip_address')} AND {cidr_prefix_ok('w.ip_address')}
  GROUP BY t.database_name, t.username
) c, (VALUES (1, '0.0.0.0/0'), (2, '::/0')) r(i, cidr)
"""
