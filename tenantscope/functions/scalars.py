"""Per-row rules as Column expressions (JVM-side, inside whole-stage codegen).

Nothing here is a Python UDF: every function returns a ``Column`` built from
``pyspark.sql.functions`` so the jobs that use them stay vectorised.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the control plane's formats)
# ---------------------------------------------------------------------------
# Byte-size units of the API's size text, base 1024 (the duplicated "MB" of
# the original list is not reproduced).
BYTE_UNITS = ["Bytes", "KB", "MB", "GB", "TB", "PB"]
# PostgreSQL size text units (pg_size_pretty).
PG_SIZE_UNITS = ["bytes", "kB", "MB", "GB", "TB", "PB"]
# IPv4 with optional /n, anchored at the very end of the string.
CIDR_PATTERN = r"^([0-9]{1,3}\.){3}[0-9]{1,3}(/[0-9]{1,2})?\z"
# Connection string templates; the password is always masked.
POOLED_PORT, DIRECT_PORT = 6432, 5432
POOLED_QUERY = "sslmode=disable&pgbouncer=true&connect_timeout=15"
DIRECT_QUERY = "sslmode=require"
SHADOW_QUERY = "sslmode=require&schema=public"
PASSWORD_MASK = "***"
# Accent folding table (Latin-1 letters); one character in, one out.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿ"
UNACCENTED = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyy"
# Letters that fold to two characters.
LIGATURES = [("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Sizes
# ---------------------------------------------------------------------------
def format_bytes(c) -> Column:
    """Human byte size, base 1024, at most two decimals, trailing zeros
    dropped ("8 MB", "1.5 KB"). 0 -> "0 Bytes"; NULL -> NULL.

    The unit is picked with integer comparisons (no ``log``), so exact
    powers of 1024 never round into the unit below.
    """
    b = _c(c).cast("bigint")
    idx = F.lit(0)
    for i in range(1, len(BYTE_UNITS)):
        idx = F.when(b >= F.lit(1024 ** i), F.lit(i)).otherwise(idx)
    scaled = b.cast("double") / F.pow(F.lit(1024.0), idx)
    num = F.regexp_replace(F.format_string("%.2f", F.round(scaled, 2)), r"\.?0+$", "")
    units = F.array(*[F.lit(u) for u in BYTE_UNITS])
    text = F.concat(num, F.lit(" "), F.element_at(units, idx + 1))
    return F.when(b.isNull(), F.lit(None).cast("string")) \
            .when(b == 0, F.lit("0 Bytes")).otherwise(text)


def size_pretty(c) -> Column:
    """PostgreSQL ``pg_size_pretty(bigint)``: bytes below 10 kB, then each
    unit until the value is below 20 * 1024 - 1, half-rounded; all in
    integer arithmetic."""
    v = _c(c).cast("bigint")
    a = F.abs(v)
    sign = F.when(v < 0, F.lit(-1)).otherwise(F.lit(1))

    def half(x):
        return F.shiftright(x + F.lit(1), 1)

    s1 = F.shiftright(a, 9)            # units of 512 bytes
    s2 = F.shiftright(s1, 10)
    s3 = F.shiftright(s2, 10)
    s4 = F.shiftright(s3, 10)
    s5 = F.shiftright(s4, 10)
    lim = 20 * 1024 - 1

    def fmt(x, unit):
        return F.concat((sign * x).cast("string"), F.lit(" " + unit))

    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(a < 10 * 1024, fmt(a, PG_SIZE_UNITS[0]))
            .when(s1 < lim, fmt(half(s1), PG_SIZE_UNITS[1]))
            .when(s2 < lim, fmt(half(s2), PG_SIZE_UNITS[2]))
            .when(s3 < lim, fmt(half(s3), PG_SIZE_UNITS[3]))
            .when(s4 < lim, fmt(half(s4), PG_SIZE_UNITS[4]))
            .otherwise(fmt(half(s5), PG_SIZE_UNITS[5])))


# ---------------------------------------------------------------------------
# IPv4 / CIDR
# ---------------------------------------------------------------------------
def cidr_valid(c) -> Column:
    """The API's validator: dotted quad with optional /n (one or two digits)
    and every octet 0-255. The prefix value itself is not checked (see
    ``cidr_prefix_ok``). NULL and '' are invalid."""
    s = _c(c)
    octets = F.split(F.substring_index(s, "/", 1), r"\.")
    ok = s.rlike(CIDR_PATTERN) & F.forall(octets, lambda x: x.try_cast("int") <= 255)
    return F.coalesce(ok, F.lit(False))


def cidr_prefix(c) -> Column:
    """Prefix length; a bare address counts as /32."""
    s = _c(c)
    return F.when(F.instr(s, "/") > 0,
                  F.substring_index(s, "/", -1).try_cast("int")).otherwise(F.lit(32))


def cidr_prefix_ok(c) -> Column:
    p = cidr_prefix(c)
    return F.coalesce((p >= 0) & (p <= 32), F.lit(False))


def ipv4_to_long(c) -> Column:
    """Dotted quad (prefix ignored) to a number; NULL when not four octets."""
    parts = F.split(F.substring_index(_c(c), "/", 1), r"\.")
    n = F.lit(0).cast("bigint")
    for i in range(4):
        n = F.shiftleft(n, 8) + F.element_at(parts, i + 1).try_cast("bigint")
    return F.when(F.size(parts) == 4, n)


def _block(c) -> Column:
    return F.pow(F.lit(2), F.lit(32) - cidr_prefix(c)).cast("bigint")


def cidr_lo(c) -> Column:
    """First address of the block; NULL unless the prefix is 0-32."""
    ip = ipv4_to_long(c)
    return F.when(cidr_prefix_ok(c), ip - F.pmod(ip, _block(c)))


def cidr_hi(c) -> Column:
    """Last address of the block; NULL unless the prefix is 0-32."""
    return F.when(cidr_prefix_ok(c), cidr_lo(c) + _block(c) - F.lit(1))


def cidr_normalized(c) -> Column:
    """The CIDR text written into rules: a bare address gets /32."""
    s = _c(c)
    return F.when(F.instr(s, "/") > 0, s).otherwise(F.concat(s, F.lit("/32")))


# ---------------------------------------------------------------------------
# Names, strings, JSON
# ---------------------------------------------------------------------------
def tenant_key(*cols) -> Column:
    """8-hex key from the request's fields: stable on retry, unlike a
    random UUID prefix. Collisions are caught by the uniqueness check."""
    return F.substring(F.sha2(F.concat_ws("|", *[_c(x).cast("string") for x in cols]), 256), 1, 8)


def connection_string(username, database_name, host, kind: str) -> Column:
    """One of the three connection strings (pooled, direct, shadow)."""
    port, query = {"pooled": (POOLED_PORT, POOLED_QUERY),
                   "direct": (DIRECT_PORT, DIRECT_QUERY),
                   "shadow": (DIRECT_PORT, SHADOW_QUERY)}[kind]
    return F.concat(F.lit("postgresql://"), _c(username), F.lit(":" + PASSWORD_MASK + "@"),
                    _c(host), F.lit(f":{port}/"), _c(database_name), F.lit("?" + query))


def cache_key_parts(c) -> Column:
    """``site:{site}:{type}:{rest}`` -> struct(site, type, rest); NULL
    fields when the key has no such part."""
    p = F.split(_c(c), ":", 4)
    is_site = F.element_at(p, 1) == F.lit("site")
    return F.struct(F.when(is_site, F.get(p, 1)).alias("site"),
                    F.when(is_site, F.get(p, 2)).alias("type"),
                    F.when(is_site, F.get(p, 3)).alias("rest"))


def json_details(**cols) -> Column:
    """JSON object text from named columns, keys in the given order."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in cols.items()]))


def has_permission(c, resource: str, verb: str) -> Column:
    """``{"resource": ["verb", ...]}`` grants ``verb`` on ``resource``."""
    m = F.from_json(_c(c), "map<string,array<string>>")
    return F.coalesce(F.array_contains(F.element_at(m, F.lit(resource)), F.lit(verb)),
                      F.lit(False))


def unaccent(c) -> Column:
    out = F.translate(_c(c), ACCENTED, UNACCENTED)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def digest(c) -> Column:
    return F.sha2(_c(c).cast("string"), 256)


def whole_days_between(start, end) -> Column:
    """Whole 24-hour periods from ``start`` to ``end`` (like ``find -mtime``)."""
    secs = F.timestamp_diff("SECOND", _c(start), _c(end))
    return F.floor(secs / F.lit(86400)).cast("bigint")
