"""Named queries over the test tables and their DuckDB oracle statements."""

from orderlens.plans.oracle import oracle_sql
from orderlens.plans.queries import QUERIES

__all__ = ["QUERIES", "oracle_sql"]
