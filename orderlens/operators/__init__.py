"""Operators: each takes DataFrames and returns a DataFrame, for all scope
groups (sellers, uploads, ...) at once."""

from orderlens.operators import catalog, category, kpis, months, sku

__all__ = ["catalog", "category", "kpis", "months", "sku"]
