"""Month views: month KPIs, day-of-month revenue, month return reasons,
two-month and month-over-month comparisons, available years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import guarded_percent, month_index, month_label, parse_dmy, ratio, sum0
from orderlens.operators._common import (
    DEFAULT_SCOPE, Scope, col_or_null, has, is_returned, key_join, money, n_rows, n_where, scope_cols,
    status_is,
)
from orderlens.schema import FALLBACK_YEARS, STATUS_CANCELLED, STATUS_DELIVERED

Month = tuple[int, int]  # (year, month)


def with_order_dt(orders: DataFrame) -> DataFrame:
    """Ensure a parsed ``order_dt`` DATE column (kept if already present,
    e.g. written at ingest) and drop rows whose date does not parse."""
    if not has(orders, "order_dt"):
        orders = orders.withColumn("order_dt", parse_dmy(col_or_null(orders, "order_date")))
    return orders.filter(F.col("order_dt").isNotNull())


def _month_filter(months: Sequence[Month]) -> Column:
    """Date-range predicate for the given months (prunes partitions/row
    groups on a date-partitioned layout, unlike year()/month() tests)."""
    cond = None
    for y, m in months:
        lo = F.make_date(F.lit(y), F.lit(m), F.lit(1))
        c = (F.col("order_dt") >= lo) & (F.col("order_dt") < F.add_months(lo, 1))
        cond = c if cond is None else (cond | c)
    return cond


def dated(orders: DataFrame, months: Sequence[Month] | None = None) -> DataFrame:
    d = with_order_dt(orders)
    if months:
        if has(d, "order_month"):
            # the stored order table is partitioned by this text: prune folders
            d = d.filter(F.col("order_month").isin([f"{y:04d}-{m:02d}" for y, m in months]))
        d = d.filter(_month_filter(months))
    return d.withColumns({
        "year": F.year("order_dt"),
        "month": F.month("order_dt"),
        "day": F.dayofmonth("order_dt"),
    })


def month_kpis(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE,
               months: Sequence[Month] | None = None) -> DataFrame:
    """Per scope and calendar month: lines, quantity, revenue, average order
    value (unrounded), delivered/cancelled/returned lines, return cost,
    return rate (2 decimals), label 'March 2025' and has_data."""
    keys = scope_cols(scope)
    d = dated(orders, months)
    g = d.groupBy(*keys, "year", "month").agg(
        n_rows(d).alias("total_orders"),
        sum0(col_or_null(d, "quantity")).alias("_qty"),
        sum0(col_or_null(d, "order_price")).alias("_rev"),
        n_where(d, status_is(d, STATUS_DELIVERED)).alias("delivered_count"),
        n_where(d, status_is(d, STATUS_CANCELLED)).alias("cancelled_count"),
        n_where(d, is_returned(d)).alias("returned_count"),
        sum0(col_or_null(d, "return_cost")).alias("_rc"),
    )
    return g.select(
        *keys, "year", "month",
        month_label("year", "month").alias("month_year"),
        "total_orders",
        F.col("_qty").cast("bigint").alias("total_quantity"),
        money("_rev").alias("total_revenue"),
        ratio("_rev", "total_orders").alias("avg_order_value"),
        "delivered_count", "cancelled_count", "returned_count",
        money("_rc").alias("return_cost"),
        guarded_percent("returned_count", "total_orders", 2).alias("return_rate"),
        F.lit(True).alias("has_data"),
    )


def month_daily_revenue(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE,
                        months: Sequence[Month] | None = None) -> DataFrame:
    """Revenue per day of month."""
    keys = scope_cols(scope)
    d = dated(orders, months)
    return (d.groupBy(*keys, "year", "month", "day")
            .agg(money(sum0(col_or_null(d, "order_price"))).alias("revenue")))


def month_return_reasons(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE,
                         months: Sequence[Month] | None = None) -> DataFrame:
    """Returned lines per month and non-null reason."""
    keys = scope_cols(scope)
    d = dated(orders, months)
    reason = col_or_null(d, "return_reason")
    return (d.filter(is_returned(d) & reason.isNotNull())
            .groupBy(*keys, "year", "month", reason.alias("return_reason"))
            .agg(n_rows(d).alias("cnt")))


_MEASURES = ["total_orders", "total_quantity", "total_revenue", "avg_order_value",
             "delivered_count", "cancelled_count", "returned_count", "return_cost", "return_rate"]
_INT_MEASURES = {"total_orders", "total_quantity", "delivered_count", "cancelled_count", "returned_count"}


def _compare(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """``tagged(keys, _ym1, _ym2, _side, <measures>)`` holds each month row
    once per pair it belongs to, as side 1 or side 2.  A conditional
    aggregate per (keys, pair) pivots the two sides into one row (no join);
    a side without a row becomes zeros with ``has_dataN = false``."""
    m = F.struct(*[F.col(c) for c in _MEASURES])
    g = tagged.groupBy(*keys, "_ym1", "_ym2").agg(
        F.max(F.when(F.col("_side") == 1, m)).alias("_a"),
        F.max(F.when(F.col("_side") == 2, m)).alias("_b"))
    cols = [*keys]
    for t, side in (("1", "_a"), ("2", "_b")):
        ym = F.col(f"_ym{t}")
        y, mo = F.floor(ym / 12).cast("int"), (F.pmod(ym, F.lit(12)) + 1).cast("int")
        cols += [y.alias(f"year{t}"), mo.alias(f"month{t}"), month_label(y, mo).alias(f"month_year{t}"),
                 F.col(side).isNotNull().alias(f"has_data{t}")]
        for c in _MEASURES:
            zero = F.lit(0).cast("bigint") if c in _INT_MEASURES else F.lit(0.0)
            cols.append(F.coalesce(F.col(f"{side}.{c}"), zero).alias(f"{c}{t}"))
    z = g.select(*cols)
    rev_diff = F.col("total_revenue2") - F.col("total_revenue1")
    ord_diff = F.col("total_orders2") - F.col("total_orders1")
    aov_diff = F.col("avg_order_value2") - F.col("avg_order_value1")
    return z.withColumns({
        "revenue_change": rev_diff,
        "revenue_change_pct": guarded_percent(rev_diff, "total_revenue1", 2),
        "orders_change": ord_diff,
        "orders_change_pct": guarded_percent(ord_diff, "total_orders1", 2),
        "return_rate_change": F.col("return_rate2") - F.col("return_rate1"),
        "aov_change": aov_diff,
        "aov_change_pct": guarded_percent(aov_diff, "avg_order_value1", 2),
    })


def month_comparison(orders: DataFrame, month1: Month, month2: Month,
                     scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """Compare two calendar months for every scope group that has data in
    at least one of them; a month without rows is a zero record with
    ``has_data=false``.  Only the two months are scanned.  A month or year
    that is missing or 0 gives an empty result; the same month twice is
    rejected."""
    keys = scope_cols(scope)
    given = all(month1 or ()) and all(month2 or ()) and len(month1 or ()) == 2 and len(month2 or ()) == 2
    if not given:
        # a month or year missing (or 0): nothing to compare, empty result
        return month_comparison(orders.filter(F.lit(False)), (1, 1), (1, 2), keys)
    if any(not 1 <= m <= 12 for _, m in (month1, month2)):
        raise ValueError("months are 1..12")
    if tuple(month1) == tuple(month2):
        raise ValueError("cannot compare a month with itself")
    k = month_kpis(orders, keys, months=[month1, month2])
    ym1 = month1[0] * 12 + month1[1] - 1
    ym2 = month2[0] * 12 + month2[1] - 1
    ym = month_index("year", "month")
    tagged = k.select(*keys, *_MEASURES, F.lit(ym1).alias("_ym1"), F.lit(ym2).alias("_ym2"),
                      F.when(ym == ym1, 1).otherwise(2).alias("_side"))
    return _compare(tagged, keys)


def month_over_month(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """Every (previous month, month) comparison touching a month with data:
    for each data month M of a group, the pairs (M-1, M) and (M, M+1)."""
    keys = scope_cols(scope)
    k = month_kpis(orders, keys)
    ym = month_index("year", "month")
    roles = F.array(
        F.struct((ym - 1).alias("_ym1"), ym.alias("_ym2"), F.lit(2).alias("_side")),
        F.struct(ym.alias("_ym1"), (ym + 1).alias("_ym2"), F.lit(1).alias("_side")))
    tagged = (k.select(*keys, *_MEASURES, F.explode(roles).alias("r"))
              .select(*keys, *_MEASURES, "r._ym1", "r._ym2", "r._side"))
    return _compare(tagged, keys)


def available_years(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE,
                    groups: DataFrame | None = None) -> DataFrame:
    """Distinct years with a parseable order date per group; groups with
    none (all groups of ``orders``, plus ``groups`` if given) get the
    fallback years.

    One aggregate: the set of years of a group is bounded by the calendar
    (a few dozen values), so it is collected per group, sorted and exploded,
    with the fallback when empty; a group's years follow each other in order.
    """
    keys = scope_cols(scope)
    d = orders
    if not has(d, "order_dt"):
        d = d.withColumn("order_dt", parse_dmy(col_or_null(d, "order_date")))
    year = F.year("order_dt")
    g = d.groupBy(*keys).agg(F.collect_set(year).alias("_ys"))
    if groups is not None and keys:
        extra = key_join(groups.select(*keys).distinct(), g.select(*keys), keys, "left_anti")
        g = g.unionByName(extra.withColumn("_ys", F.array().cast("array<int>")))
    fallback = F.array(*[F.lit(y) for y in FALLBACK_YEARS]).cast("array<int>")
    ys = F.when(F.size("_ys") > 0, F.sort_array("_ys")).otherwise(fallback)
    return g.select(*keys, F.explode(ys).alias("year"))
