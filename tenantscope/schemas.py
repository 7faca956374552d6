"""Explicit schemas for the control tables and feeds (never inferred).

Reference UUID keys are STRING in production schemas; the fixture views
derived from the driver tables use BIGINT keys instead (see ``fixtures``).
"""

from pyspark.sql.types import (BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)


def _s(*fields):
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


S, L, I, B, TS = StringType(), LongType(), IntegerType(), BooleanType(), TimestampNTZType()

DATABASES = _s(("id", S, False), ("database_name", S, False), ("username", S, False),
               ("password_hash", S, False), ("owner_email", S, True),
               ("friendly_name", S, True), ("max_connections", I, True),
               ("status", S, True), ("created_at", TS, True), ("updated_at", TS, True))

IP_WHITELIST = _s(("id", L, False), ("database_id", S, True), ("ip_address", S, False),
                  ("description", S, True), ("added_at", TS, True))

API_KEYS = _s(("id", S, False), ("key_hash", S, False), ("name", S, True),
              ("permissions", S, True), ("created_at", TS, True),
              ("expires_at", TS, True), ("last_used_at", TS, True))

AUDIT_LOGS = _s(("id", L, False), ("api_key_id", S, True), ("action", S, False),
                ("resource_type", S, True), ("resource_id", S, True),
                ("ip_address", S, True), ("details", S, True), ("created_at", TS, True))

DATABASE_STATS = _s(("id", L, False), ("database_id", S, True), ("size_bytes", L, True),
                    ("active_connections", I, True), ("total_queries", L, True),
                    ("recorded_at", TS, True))

SHADOW_DATABASES = _s(("id", S, False), ("parent_database_id", S, True),
                      ("shadow_database_name", S, False), ("shadow_username", S, False),
                      ("shadow_password_hash", S, False), ("status", S, True),
                      ("created_at", TS, True), ("synced_at", TS, True),
                      ("last_sync_status", S, True))

ACTIVITY = _s(("pid", L, True), ("datname", S, True))
DB_CATALOG = _s(("datname", S, True), ("datistemplate", B, True), ("size_bytes", L, True))

POOL_SNAPSHOT = _s(("pool_database", S, True), ("pool_user", S, True),
                   ("cl_active", I, True), ("cl_waiting", I, True), ("sv_active", I, True),
                   ("sv_idle", I, True), ("sv_used", I, True), ("ts", TS, True))

CONN_LOG = _s(("conn_id", L, True), ("database_id", L, True), ("client_ip", S, True),
              ("is_ssl", B, True), ("ts", TS, True))

CACHE_REQUESTS = _s(("request_id", L, True), ("ts", TS, True), ("db", I, True),
                    ("cache_key", S, True), ("hit", B, True), ("duration_us", L, True))

BACKUPS = _s(("name", S, True), ("mtime", TS, True))

TENANT_REQUESTS = _s(("friendly_name", S, True), ("owner_email", S, True),
                     ("max_connections", I, True), ("request_no", L, True))

# Column length limits of the control schema (VARCHAR(n)) and NOT NULL
# columns, per table. Fixed values of the control DDL.
VARCHAR_LIMITS = {
    "databases": {"database_name": 255, "username": 255, "password_hash": 255,
                  "owner_email": 255, "friendly_name": 255, "status": 50},
    "ip_whitelist": {"ip_address": 50},
    "api_keys": {"key_hash": 255, "name": 255},
    "audit_logs": {"action": 100, "resource_type": 50, "resource_id": 255,
                   "ip_address": 50},
    "shadow_databases": {"shadow_database_name": 255, "shadow_username": 255,
                         "shadow_password_hash": 255, "status": 50,
                         "last_sync_status": 50},
}
NOT_NULL = {
    "databases": ["id", "database_name", "username", "password_hash"],
    "ip_whitelist": ["id", "ip_address"],
    "api_keys": ["id", "key_hash"],
    "audit_logs": ["id", "action"],
    "shadow_databases": ["id", "shadow_database_name", "shadow_username",
                         "shadow_password_hash"],
}
