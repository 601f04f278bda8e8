"""Every operator as a query over the benchmark tables, with its SQL check."""

from starloom.workload.checks import CHECKS
from starloom.workload.queries import QUERIES

__all__ = ["CHECKS", "QUERIES"]
