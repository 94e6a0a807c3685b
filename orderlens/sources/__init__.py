"""Sources and sinks: CSV order files, folder listing, parquet tables,
and the adapters from the supplied test tables."""

from orderlens.sources.csv_orders import (
    file_row_counts, read_orders_csv, union_orders,
)
from orderlens.sources.files import export_csv, list_files, write_orders, write_table
from orderlens.sources.testdata import (
    orders_from_tpch, sellers_from_supplier, uploads_from_events,
)

__all__ = [
    "export_csv", "file_row_counts", "list_files", "orders_from_tpch", "read_orders_csv",
    "sellers_from_supplier", "union_orders", "uploads_from_events", "write_orders", "write_table",
]
