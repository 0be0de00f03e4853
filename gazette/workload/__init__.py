"""Every operator as a query over the given tables, next to the SQL it must agree with."""

from gazette.workload import evaluate, explore, prepare  # noqa: F401
from gazette.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
