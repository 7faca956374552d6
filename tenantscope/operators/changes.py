"""Change jobs that commit (R25, R26, R49, R50): the registry or allow list and
the audit trail move to a new version together (``sources.versions``). Every job
has an id; running it again, after a crash or twice at once, changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope.operators import access, checks, registry
from tenantscope.sources.versions import VersionedTables

#: Child tables of a tenant and their key column.
CHILDREN = {"ip_whitelist": "database_id", "database_stats": "database_id", "shadow_databases": "parent_database_id"}


def _numbered(audit: DataFrame, trail: DataFrame) -> DataFrame:
    """New audit rows with ids above all that the trail has (unique, with gaps)."""
    top = trail.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return audit.withColumn("id", top + 1 + F.monotonically_increasing_id())


def register_tenants(store: VersionedTables, requests: DataFrame, as_of: str, job: str) -> int:
    """New registry rows and their ``database_created`` audit rows."""
    def make(read):
        r = registry.register(requests, read("databases"), as_of)
        return {"append": {"databases": r["accepted"], "audit_logs": _numbered(r["audit"], read("audit_logs"))}}
    return store.change(job, make)


def remove_tenants(store: VersionedTables, ids: DataFrame, as_of: str, job: str) -> int:
    """The tenants go from the registry and, with their rows, from every
    child table that the store has; ``database_deleted`` rows are added."""
    def make(read):
        have = store.pointer(store.version())["tables"]
        tables = {n: (read(n), k) for n, k in {"databases": "id", **CHILDREN}.items() if n in have}
        out = checks.cascade_delete(tables, ids, as_of=as_of)
        return {"replace": {n: out[n] for n in tables}, "append": {"audit_logs": _numbered(out["audit"], read("audit_logs"))}}
    return store.change(job, make)


def add_whitelist(store: VersionedTables, requests: DataFrame, as_of: str, job: str) -> int:
    """New allow-list rows and their ``ip_whitelist_added`` audit rows."""
    def make(read):
        r = access.add_ips(requests, read("ip_whitelist"), read("databases"), as_of)
        return {"append": {"ip_whitelist": r["added"], "audit_logs": _numbered(r["audit"], read("audit_logs"))}}
    return store.change(job, make)


def remove_whitelist(store: VersionedTables, keys: DataFrame, as_of: str, job: str) -> int:
    """The allow list without the given (id, database_id) pairs and their
    ``ip_whitelist_removed`` audit rows."""
    def make(read):
        r = access.remove_ips(read("ip_whitelist"), keys, as_of)
        return {"replace": {"ip_whitelist": r["kept"]}, "append": {"audit_logs": _numbered(r["audit"], read("audit_logs"))}}
    return store.change(job, make)
