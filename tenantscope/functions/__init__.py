"""Column-expression functions used by the operators."""
from tenantscope.functions.scalars import *  # noqa: F401,F403
