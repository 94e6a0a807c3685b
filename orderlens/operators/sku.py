"""SKU ranking, SKU detail, SKU-page KPIs and SKU buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import (
    brand_label, ellipsis, guarded_percent, ratio, rint_k, sku_class, sum0, warehouse_label,
)
from orderlens.functions.text import SKU_NAME_LEN, SKU_SHORT_LEN
from orderlens.operators._common import (
    DEFAULT_SCOPE, Scope, absent_in_row, col_or_null, drop_null_keys, is_returned, key_join, money,
    n_nonnull, n_rows, n_where,
    scope_cols, status_is, top_k,
)
from orderlens.operators.kpis import TOP_RETURNED_K
from orderlens.schema import (
    DEFAULT_SKU_MARGIN, DEFAULT_SKU_RETURN_RATE, STATUS_DELIVERED,
)

TOP_SKUS_K = 10
HIGH_RISK_RETURN_RATE = 15.0


def _sku_rates(g):
    """Margin and return rate (1 decimal) from the per-SKU sums, with the
    defaults used when the files had no return_cost / order_status column."""
    margin = rint_k(ratio(F.col("_rev") - F.col("_rc"), F.col("_rev")) * F.lit(100.0), 1)
    rate = rint_k(ratio("return_count", "orders") * F.lit(100.0), 1)
    return g.select(
        "*",
        F.when(F.col("_no_rc"), F.lit(DEFAULT_SKU_MARGIN)).otherwise(margin).alias("profit_margin"),
        F.when(F.col("_no_status"), F.lit(DEFAULT_SKU_RETURN_RATE)).otherwise(rate).alias("return_rate"),
    )


def sku_stats(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """All SKUs: orders (non-null ids), revenue, return cost, returned lines,
    margin and return rate.  One aggregate; no join."""
    keys = scope_cols(scope)
    sku = col_or_null(orders, "sku_description")
    g = (orders.filter(sku.isNotNull())
         .groupBy(*keys, sku.alias("sku"))
         .agg(n_nonnull(orders, "order_id").alias("orders"),
              sum0(col_or_null(orders, "order_price")).alias("_rev"),
              sum0(col_or_null(orders, "return_cost")).alias("_rc"),
              n_where(orders, is_returned(orders)).alias("return_count"),
              F.bool_and(absent_in_row(orders, "return_cost")).alias("_no_rc"),
              F.bool_and(absent_in_row(orders, "order_status")).alias("_no_status")))
    return _sku_rates(g)


def sku_stats_join(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """Same result as :func:`sku_stats`, built the merge way: SKU stats
    left-joined with return cost per SKU and returned lines per SKU.

    All three inputs are aggregates hash-partitioned on the same keys, so
    the joins reuse that partitioning instead of shuffling again.
    """
    keys = scope_cols(scope)
    jk = keys + ["sku"]
    sku = col_or_null(orders, "sku_description")
    base = drop_null_keys(orders, keys).filter(sku.isNotNull()).withColumn("sku", sku)
    stats = base.groupBy(*jk).agg(n_nonnull(orders, "order_id").alias("orders"),
                                  sum0(col_or_null(orders, "order_price")).alias("_rev"),
                                  F.bool_and(absent_in_row(orders, "return_cost")).alias("_no_rc"),
                                  F.bool_and(absent_in_row(orders, "order_status")).alias("_no_status"))
    rc = base.groupBy(*jk).agg(F.sum(col_or_null(orders, "return_cost")).alias("_rc_sum"))
    ret = base.filter(is_returned(orders)).groupBy(*jk).agg(n_rows(orders).alias("_ret_n"))
    j = key_join(key_join(stats, rc, jk, "left"), ret, jk, "left")
    j = j.select(*jk, "orders", "_rev", "_no_rc", "_no_status",
                 F.coalesce(F.col("_rc_sum"), F.lit(0)).alias("_rc"),
                 F.coalesce(F.col("_ret_n"), F.lit(0)).cast("bigint").alias("return_count"))
    return _sku_rates(j)


def _rank_output(stats: DataFrame, keys: list[str], k: int) -> DataFrame:
    ranked = top_k(stats, keys, [F.desc("_rev"), F.asc("sku")], k)
    return ranked.select(
        *keys, "rnk", "sku",
        ellipsis("sku", SKU_SHORT_LEN).alias("sku_short"),
        ellipsis("sku", SKU_NAME_LEN).alias("sku_name"),
        sku_class("sku").alias("sku_class"),
        "orders",
        rint_k(F.col("_rev").cast("double"), 2).alias("revenue"),
        money("_rc").alias("return_cost"),
        "profit_margin", "return_count", "return_rate",
    )


def sku_ranking(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE, k: int = TOP_SKUS_K) -> DataFrame:
    """Top ``k`` SKUs by revenue (ties by SKU text) with display names,
    keyword class, margin and return rate."""
    keys = scope_cols(scope)
    return _rank_output(sku_stats(orders, keys), keys, k)


def sku_ranking_join(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE, k: int = TOP_SKUS_K) -> DataFrame:
    """:func:`sku_ranking` computed through the join form."""
    keys = scope_cols(scope)
    return _rank_output(sku_stats_join(orders, keys), keys, k)


def sku_buckets(orders: DataFrame) -> DataFrame:
    """Stable brand / warehouse bucket labels for every SKU text."""
    sku = col_or_null(orders, "sku_description")
    return (orders.filter(sku.isNotNull()).select(sku.alias("sku")).distinct()
            .select("sku", brand_label("sku").alias("brand"), warehouse_label("sku").alias("warehouse")))


def sku_detail(orders: DataFrame, requests: DataFrame, scope: Scope | None = DEFAULT_SCOPE,
               prefilter: bool = True) -> DataFrame:
    """Metrics of requested SKUs: ``requests`` has the scope columns and
    ``sku``.  A requested SKU with no lines gets a zero record.

    With ``prefilter`` (a short request list, the page use) the orders are
    first semi-joined to the requests so only requested SKUs are
    aggregated; for requests covering most SKUs, ``prefilter=False``
    aggregates once and skips planning the requests twice.
    """
    keys = scope_cols(scope)
    jk = keys + ["sku"]
    sku = col_or_null(orders, "sku_description")
    base = drop_null_keys(orders, keys).withColumn("sku", sku).filter(F.col("sku").isNotNull())
    req = drop_null_keys(requests.select(*jk), jk).distinct()
    if prefilter:
        base = key_join(base, req, jk, "left_semi")
    g = base.groupBy(*jk).agg(
        n_rows(orders).alias("_rows"),
        sum0(col_or_null(orders, "order_price")).alias("_rev"),
        n_where(orders, is_returned(orders)).alias("_ret"),
    )
    j = key_join(req, g, jk, "left")
    rows = F.coalesce(F.col("_rows"), F.lit(0)).cast("bigint")
    ret = F.coalesce(F.col("_ret"), F.lit(0)).cast("bigint")
    return j.select(
        *keys, "sku",
        ellipsis("sku", SKU_NAME_LEN).alias("sku_label"),
        rows.alias("total_orders"),
        money(F.coalesce(F.col("_rev"), F.lit(0))).alias("revenue"),
        ret.alias("returns"),
        guarded_percent(ret, rows, 2).alias("return_rate"),
    )


def sku_detail_one(orders: DataFrame, sku: str, scope: Scope | None = ()) -> DataFrame:
    """Metrics of one SKU text (zero record when absent); global by default."""
    keys = scope_cols(scope)
    s = col_or_null(orders, "sku_description")
    hit = orders.filter(s == F.lit(sku))
    g = hit.groupBy(*keys).agg(n_rows(orders).alias("total_orders"),
                               sum0(col_or_null(orders, "order_price")).alias("_rev"),
                               n_where(orders, is_returned(orders)).alias("returns"))
    return g.select(*keys, F.lit(sku).alias("sku"),
                    ellipsis(F.lit(sku), SKU_NAME_LEN).alias("sku_label"),
                    "total_orders", money("_rev").alias("revenue"), "returns",
                    guarded_percent("returns", "total_orders", 2).alias("return_rate"))


def sku_page_kpis(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """Page KPIs of the SKU view, all from the data.

    One aggregate by (scope, sku) carries every additive measure; a second,
    much smaller aggregate rolls SKUs up to the scope.  Rows with no SKU
    text count toward totals but not toward SKU counts.
    """
    keys = scope_cols(scope)
    sku = col_or_null(orders, "sku_description")
    price = col_or_null(orders, "order_price")
    returned = is_returned(orders)
    per_sku = orders.groupBy(*keys, sku.alias("sku")).agg(
        n_rows(orders).alias("rows"),
        n_nonnull(orders, "order_id").alias("orders"),
        n_where(orders, returned).alias("return_count"),
        n_where(orders, status_is(orders, STATUS_DELIVERED)).alias("delivered"),
        sum0(price).alias("_rev"),
        sum0(col_or_null(orders, "return_cost")).alias("_rc"),
        sum0(F.when(returned, price)).alias("_refund"),
        sum0(col_or_null(orders, "quantity")).alias("_qty"),
        F.bool_and(absent_in_row(orders, "return_cost")).alias("_no_rc"),
        F.bool_and(absent_in_row(orders, "order_status")).alias("_no_status"),
    )
    per_sku = _sku_rates(per_sku)
    is_sku = F.col("sku").isNotNull()
    g = per_sku.groupBy(*keys).agg(
        F.sum("rows").alias("total_units_sold"),
        F.sum("return_count").alias("total_refunds"),
        F.sum("delivered").alias("_delivered"),
        F.sum("_rev").alias("_sales"),
        F.sum("_rc").alias("_rc_all"),
        F.sum("_refund").alias("_refund_all"),
        F.sum("_qty").alias("total_quantity"),
        F.count_if(is_sku).alias("distinct_skus"),
        F.count_if(is_sku & (F.col("return_count") > 0)).alias("_returned_skus"),
        F.count_if(is_sku & (F.col("profit_margin") < 0)).alias("loss_making_skus"),
        F.count_if(is_sku & (F.col("return_rate") > HIGH_RISK_RETURN_RATE)).alias("high_risk_skus"),
        F.sum(F.when(is_sku, F.col("profit_margin").cast("decimal(12,1)"))).alias("_margin_sum"),
        F.count(F.when(is_sku, F.col("profit_margin"))).alias("_margin_n"),
    )
    n = F.col("total_units_sold")
    return g.select(
        *keys,
        money("_sales").alias("total_revenue"),
        n.cast("bigint").alias("total_units_sold"),
        F.least(F.col("_returned_skus"), F.lit(TOP_RETURNED_K)).cast("bigint").alias("total_skus_listed"),
        F.when(n > 0, rint_k(ratio("_sales", n), 2)).otherwise(F.lit(0.0)).alias("aov"),
        rint_k(ratio(F.col("_sales") - F.col("_rc_all"), F.col("_sales")) * F.lit(100.0), 2).alias("gross_margin"),
        guarded_percent("total_refunds", n, 2).alias("return_rate"),
        money(F.col("_sales") - F.col("_rc_all")).alias("total_profit"),
        rint_k(ratio("_margin_sum", "_margin_n"), 2).alias("avg_profit_margin"),
        F.col("loss_making_skus").cast("bigint").alias("loss_making_skus"),
        F.col("total_refunds").cast("bigint").alias("total_refunds"),
        money("_refund_all").alias("refund_amount"),
        guarded_percent("_delivered", n, 2).alias("delivery_success_rate"),
        F.col("high_risk_skus").cast("bigint").alias("high_risk_skus"),
        F.col("distinct_skus").cast("bigint").alias("distinct_skus"),
        F.col("total_quantity").cast("bigint").alias("total_quantity"),
    )
