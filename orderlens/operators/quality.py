"""Validation report of order lines, per scope group.

Where the original turns any failure into an all-zero result, every group
here gets a row saying what is wrong with its data, next to results that
are computed wherever they can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import parse_dmy
from orderlens.operators._common import (
    W_ROWS, n_nonnull,
    ABSENT_COL, DEFAULT_SCOPE, Scope, col_or_null, has, n_rows, n_where, scope_cols,
)
from orderlens.schema import ORDER_COLUMNS, STATUS_CANCELLED, STATUS_DELIVERED, STATUS_RETURNED

KNOWN_STATUSES = [STATUS_DELIVERED, STATUS_CANCELLED, STATUS_RETURNED]


def validate_orders(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """Per group: lines; lines with an unparseable (non-null) order date, no
    order id, no price, an unknown status; lines whose ``order_price`` is
    not ``item_price * quantity`` (all three present); and the columns its
    files lacked (comma-separated, sorted).  One aggregate."""
    keys = scope_cols(scope)
    if has(orders, W_ROWS) and not has(orders, "item_price"):
        raise ValueError("a roll-up keeps sums of prices, not lines; validate the order lines")
    date = col_or_null(orders, "order_date")
    parsed = F.col("order_dt") if has(orders, "order_dt") else parse_dmy(date)
    status = col_or_null(orders, "order_status")
    price, item, qty = (col_or_null(orders, c) for c in ("order_price", "item_price", "quantity"))
    mismatch = price.isNotNull() & item.isNotNull() & qty.isNotNull() & (price != item * qty)
    if has(orders, ABSENT_COL):
        absent = F.array_sort(F.array_distinct(F.flatten(F.collect_set(ABSENT_COL))))
    else:
        lacking = [n for n, _ in ORDER_COLUMNS if not has(orders, n)]
        absent = F.array(*[F.lit(n) for n in sorted(lacking)]).cast("array<string>")
    g = orders.groupBy(*keys).agg(
        n_rows(orders).alias("lines"),
        n_where(orders, date.isNotNull() & parsed.isNull()).alias("bad_dates"),
        (n_rows(orders) - n_nonnull(orders, "order_id")).alias("missing_order_ids"),
        (n_rows(orders) - n_nonnull(orders, "order_price")).alias("missing_prices"),
        n_where(orders, status.isNotNull() & ~status.isin(KNOWN_STATUSES)).alias("unknown_statuses"),
        n_where(orders, F.coalesce(mismatch, F.lit(False))).alias("price_mismatches"),
        absent.alias("_absent_cols"),
    )
    return g.select(*keys, "lines", "bad_dates", "missing_order_ids", "missing_prices",
                    "unknown_statuses", "price_mismatches",
                    F.array_join("_absent_cols", ",").alias("absent_columns"))
