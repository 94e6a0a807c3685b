"""The whole seller dashboard from one read of the raw orders.

Every dashboard result is an aggregate of a few order columns, and all of
them are sums or counts.  So the order lines are first rolled up once to
one row per (scope, order date, catalogue, category, SKU, status, reason)
with the line counts the results need (all lines, lines with an order id,
lines with a price) and the summed amounts.  That table is written to the
shared checkpoint folder (``spark.checkpoint.dir``) and every result is
computed from it: the operators sum the stored counts instead of counting
lines.  The checkpoint also cuts the lineage, so a lost executor re-reads the
table instead of recomputing the raw scan; Spark deletes it when nothing
refers to it any more (spark.cleaner.referenceTracking.cleanCheckpoints).  A seller with many lines per
day and SKU shrinks by that factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators import category, kpis, sku
from orderlens.operators._common import ABSENT_COL, DEFAULT_SCOPE, W_ROWS, Scope, n_nonnull, n_rows, scope_cols
from orderlens.session import ensure_checkpoint_dir

# Grouping columns of the roll-up (those any dashboard result groups or
# filters on), when present.
ROLLUP_KEYS = ["order_date", "order_dt", "catalogue_id", "category", "sku_description",
               "order_status", "return_reason", ABSENT_COL]
# Summed amounts.
ROLLUP_SUMS = ["order_price", "return_cost", "quantity"]


def rollup(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """Order lines rolled up to one row per dashboard key with line counts
    (``_w_rows``, ``_w_order_id``, ``_w_order_price``) and summed amounts.
    Partial aggregation runs before the shuffle, so a hot seller is
    reduced on every map task."""
    keys = scope_cols(scope)
    group = keys + [c for c in ROLLUP_KEYS if c in orders.columns and c not in keys]
    # weight-aware counts: rolling up a roll-up (e.g. the union of the
    # ingest's per-batch roll-ups) compacts it
    aggs = [n_rows(orders).alias(W_ROWS),
            n_nonnull(orders, "order_id").alias("_w_order_id"),
            n_nonnull(orders, "order_price").alias("_w_order_price")]
    aggs += [F.sum(c).alias(c) for c in ROLLUP_SUMS if c in orders.columns]
    return orders.groupBy(*group).agg(*aggs)


def compact(spark, rollup_path: str, out_path: str, scope: Scope | None = ("seller_id", "upload_id")) -> None:
    """Merge the per-batch roll-ups under ``rollup_path`` into one roll-up."""
    rollup(spark.read.parquet(rollup_path).drop("batch"), scope).write.mode("overwrite").parquet(out_path)


def materialize(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """The roll-up, checkpointed to the shared folder (runs a job)."""
    ensure_checkpoint_dir(orders.sparkSession)
    return rollup(orders, scope).checkpoint()


def dashboard(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE,
              materialized: bool = True) -> dict[str, DataFrame]:
    """All dashboard results per scope group (default: per seller).

    With ``materialized=False`` every result plans from ``orders`` directly
    (the multi-pass form, for comparison).
    """
    keys = scope_cols(scope)
    base = materialize(orders, keys) if materialized else orders
    scorecard = category.category_scorecard(base, keys)
    return {
        "kpis": kpis.seller_kpis(base, keys),
        "daily_sales": kpis.daily_sales(base, keys),
        "return_reasons": kpis.return_reasons(base, keys),
        "top_returned_catalogues": kpis.top_returned_catalogues(base, keys),
        "top_returned_skus": kpis.top_returned_skus(base, keys),
        "category_scorecard": scorecard,
        "top_categories_by_revenue": category.top_categories(scorecard, "revenue", keys),
        "top_categories_by_orders": category.top_categories(scorecard, "orders", keys),
        "category_insights": category.category_insights(scorecard, keys),
        "category_recommendations": category.category_recommendations(scorecard, keys),
        "category_actions": category.category_actions(scorecard, keys),
        "sku_ranking": sku.sku_ranking(base, keys),
        "sku_page_kpis": sku.sku_page_kpis(base, keys),
    }


def dashboard_json(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """The per-group result document (KPIs, reason map, top returned
    catalogues and SKUs).  Each part aggregates only the columns that it needs;
    nothing is stored between them."""
    return kpis.kpi_json(orders, scope_cols(scope))
