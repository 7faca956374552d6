"""tenantscope: Spark jobs over a hosted-tenant database fleet.

The control plane (tenant registry, IP allow lists, API keys, audit trail,
size statistics) and its operational feeds (activity, catalogue, pool
state, server and access logs, cache counters) are DataFrames; every
operator takes DataFrames and returns DataFrames, and the clock is always
an argument.
"""

__version__ = "0.1.0"
