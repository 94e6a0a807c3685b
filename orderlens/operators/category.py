"""Category scorecard, top categories, rule-based insights and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import clip, ratio, rint_k, sum0
from orderlens.operators._common import (
    ABSENT_COL, DEFAULT_SCOPE, Scope, absent_in_row, col_or_null, has, is_returned, money,
    n_nonnull, n_where, scope_cols, top_k,
)
from orderlens.schema import UNMAPPED_CATEGORY_PREFIX, catalogue_dim

TOP_CATEGORIES_K = 5
# Parts in which the categories of one group are limited first.
SALTS = 32

# --- fixed values -----------------------------------------------------------
# Rule thresholds.
HIGH_RETURN_RATE = 15.0      # danger above
ELEVATED_RETURN_RATE = 10.0  # warning above (when not danger)
STRONG_SCORE = 70.0          # success above
LOW_MARGIN = 10.0            # warning below
# Performance score weights: revenue share, return rate, clipped margin.
SCORE_REVENUE_WEIGHT = 30.0
SCORE_RETURN_WEIGHT = 0.4
SCORE_MARGIN_CAP = 50.0
SCORE_MARGIN_WEIGHT = 30.0
# Insight texts ({name}, {value} are filled per row).
MSG_HIGH_RETURN = "{name} has a high return rate of {value}%. Consider reviewing product quality or descriptions."
MSG_ELEVATED_RETURN = "{name} return rate is at {value}%. Monitor closely."
MSG_STRONG = "{name} is performing excellently with a {value}% score."
MSG_LOW_MARGIN = "{name} has low profit margin of {value}%. Consider optimizing costs."
MSG_FOCUS_RETURNS = ("Focus on categories with high return rates first - consider quality control "
                     "and better product descriptions.")
MSG_EXPAND_TOP = "{name} is your top performer - consider expanding this category."
# Action items shown whenever a scorecard exists.
ACTION_ITEMS = [
    ("Review High Return Categories", "Investigate root causes of returns in categories with >10% return rate."),
    ("Optimize Pricing", "Consider adjusting prices in low margin categories to improve profitability."),
    ("Expand Successful Categories", "Invest more in top-performing categories to maximize revenue."),
    ("Improve Descriptions", "Add detailed product descriptions to reduce return rates."),
]


def _fill(template: str, name: Column, value: Column | None = None) -> Column:
    """A message column from a '{name}' / '{value}' template (name first)."""
    text = template.replace("%", "%%").replace("{name}", "%s").replace("{value}", "%s")
    return F.format_string(text, name, *([value.cast("string")] if value is not None else []))


def with_category(orders: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Add ``_category``: the file's own ``category`` when the file has that
    column, else the dictionary name of ``catalogue_id``, else
    'Category <id>'.  NULL when neither applies (row is then ignored).

    The built-in dictionary (19 rows) is broadcast; a caller-supplied
    dimension is left to the planner (AQE broadcasts it only if small).
    """
    own = col_or_null(orders, "category")
    use_own = ~absent_in_row(orders, "category")
    if not has(orders, "catalogue_id") or (has(orders, "category") and not has(orders, ABSENT_COL)):
        # every row carries its own category (or none can be mapped): no lookup
        return orders.withColumn("_category", F.when(use_own, own))
    builtin = dim is None
    d = catalogue_dim(orders.sparkSession) if builtin else dim
    d = d.select(F.col("catalogue_id").alias("_dim_id"), F.col("category").alias("_dim_name"))
    if builtin:
        d = F.broadcast(d)
    j = orders.join(d, orders["catalogue_id"] == d["_dim_id"], "left")
    mapped = F.coalesce(F.col("_dim_name"),
                        F.concat(F.lit(UNMAPPED_CATEGORY_PREFIX), F.col("catalogue_id").cast("string")))
    return j.withColumn("_category", F.when(use_own, own).otherwise(mapped)).drop("_dim_id", "_dim_name")


def category_mapped(orders: DataFrame, dim: DataFrame | None = None,
                    scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """Orders (non-null ``order_id``) per scope, catalogue id and category."""
    keys = scope_cols(scope)
    c = with_category(orders, dim)
    return (c.filter(F.col("_category").isNotNull())
            .groupBy(*keys, "catalogue_id", F.col("_category").alias("category"))
            .agg(n_nonnull(c, "order_id").alias("orders")))


def category_scorecard(orders: DataFrame, scope: Scope | None = DEFAULT_SCOPE,
                       dim: DataFrame | None = None) -> DataFrame:
    """Per category: revenue, orders, returns, return_cost, profit_margin,
    return_rate, avg_order_value and performance_score.

    ``performance_score`` normalises revenue by the scope's best category
    (see :func:`_with_scope_max`).
    """
    keys = scope_cols(scope)
    c = with_category(orders, dim)
    g = (c.filter(F.col("_category").isNotNull())
         .groupBy(*keys, F.col("_category").alias("name"))
         .agg(sum0(col_or_null(c, "order_price")).alias("_rev"),
              n_nonnull(c, "order_id").alias("orders"),
              n_where(c, is_returned(c)).alias("returns"),
              sum0(col_or_null(c, "return_cost")).alias("_rc")))
    rev = F.col("_rev").cast("double")
    g = g.select(
        *keys, "name",
        rev.alias("revenue"),
        "orders", "returns",
        money("_rc").alias("return_cost"),
        F.when(F.col("_rev") > 0, ratio(F.col("_rev") - F.col("_rc"), F.col("_rev")) * F.lit(100.0))
        .otherwise(F.lit(0.0)).alias("profit_margin"),
        rint_k(ratio("returns", "orders") * F.lit(100.0), 2).alias("return_rate"),
        rint_k(ratio("_rev", "orders"), 2).alias("avg_order_value"),
    )
    g = _with_scope_max(g, keys, "revenue", "_max_rev")
    score = (ratio("revenue", "_max_rev") * F.lit(SCORE_REVENUE_WEIGHT)
             + (F.lit(100.0) - F.col("return_rate")) * F.lit(SCORE_RETURN_WEIGHT)
             + clip(F.col("profit_margin"), 0.0, SCORE_MARGIN_CAP) / F.lit(SCORE_MARGIN_CAP)
             * F.lit(SCORE_MARGIN_WEIGHT))
    return g.withColumn("performance_score", rint_k(score, 0)).drop("_max_rev")


def _with_scope_max(g: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Add the scope group's maximum of ``col`` to every row of ``g`` (one
    row per category).

    A group can hold very many categories (every unmapped catalogue id is
    its own), so the maximum is an aggregate (partial per task, no group
    in one task) joined back on the scope key and a salt, not a window: the
    rows of one group are dealt over SALTS parts.  Both sides start from the
    same aggregate; the join strategy is left to AQE.
    """
    if not keys:
        one = g.withColumn("_all", F.lit(1))
        return one.join(one.groupBy("_all").agg(F.max(col).alias(out)), "_all").drop("_all")
    best = g.groupBy(*keys).agg(F.max(col).alias(out)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = g.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)))
    return salted.join(best, [*keys, "_salt"], "inner").drop("_salt")


def top_categories(scorecard: DataFrame, by: str = "revenue", scope: Scope | None = DEFAULT_SCOPE,
                   k: int = TOP_CATEGORIES_K) -> DataFrame:
    """Top ``k`` categories by ``by`` (revenue or orders), ties by name.

    A group's categories are first limited in SALTS parts, so that a group
    with very many of them is not sorted by one task.
    """
    keys = scope_cols(scope)
    order = [F.desc(by), F.asc("name")]
    if keys:
        salted = scorecard.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)))
        scorecard = top_k(salted, [*keys, "_salt"], order, k).drop("_salt", "rnk")
    return top_k(scorecard, keys, order, k)


def category_insights(scorecard: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """One row per triggered rule: (severity, rule, name, metric, message).

    Return rate above 15 is a danger, else above 10 a warning; score above
    70 a success; margin below 10 a warning.  All rules in one projection.
    """
    keys = scope_cols(scope)
    name, rr = F.col("name"), F.col("return_rate")
    score, pm = F.col("performance_score"), F.col("profit_margin")

    def hit(sev: str, rule: str, metric: Column, msg: str) -> Column:
        return F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule"),
                        metric.cast("double").alias("metric"), _fill(msg, name, metric).alias("message"))

    empty = F.lit(None).cast("struct<severity:string,rule:string,metric:double,message:string>")
    rate_rule = (F.when(rr > HIGH_RETURN_RATE, hit("danger", "high_return_rate", rr, MSG_HIGH_RETURN))
                 .when(rr > ELEVATED_RETURN_RATE, hit("warning", "elevated_return_rate", rr, MSG_ELEVATED_RETURN))
                 .otherwise(empty))
    score_rule = F.when(score > STRONG_SCORE, hit("success", "high_performance", score, MSG_STRONG)).otherwise(empty)
    margin_rule = F.when(pm < LOW_MARGIN, hit("warning", "low_profit_margin", pm, MSG_LOW_MARGIN)).otherwise(empty)
    hits = F.filter(F.array(rate_rule, score_rule, margin_rule), lambda x: x.isNotNull())
    return (scorecard.select(*keys, "name", F.explode(hits).alias("h"))
            .select(*keys, "name", "h.severity", "h.rule", "h.metric", "h.message"))


def category_recommendations(scorecard: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """'focus_high_returns' when any category is a danger; 'expand_top_category'
    naming the top category by revenue (ties by name).  One aggregate of
    the scorecard: ``bool_or`` for the danger and ``min_by`` over
    (-revenue, name) for the best category."""
    keys = scope_cols(scope)
    g = scorecard.groupBy(*keys).agg(
        F.bool_or(F.coalesce(F.col("return_rate") > HIGH_RETURN_RATE, F.lit(False))).alias("_danger"),
        F.min_by("name", F.struct((-F.col("revenue")).alias("r"), F.col("name").alias("n"))).alias("_best"))
    rec_type = "struct<rule:string,name:string,message:string>"
    focus = F.when(F.col("_danger"), F.struct(F.lit("focus_high_returns").alias("rule"),
                                              F.lit(None).cast("string").alias("name"),
                                              F.lit(MSG_FOCUS_RETURNS).alias("message")))
    best = F.when(F.col("_best").isNotNull(), F.struct(F.lit("expand_top_category").alias("rule"),
                                                       F.col("_best").alias("name"),
                                                       _fill(MSG_EXPAND_TOP, F.col("_best")).alias("message")))
    recs = F.filter(F.array(focus.cast(rec_type), best.cast(rec_type)), lambda x: x.isNotNull())
    return (g.select(*keys, F.explode(recs).alias("r"))
            .select(*keys, "r.rule", "r.name", "r.message"))


def category_actions(scorecard: DataFrame, scope: Scope | None = DEFAULT_SCOPE) -> DataFrame:
    """The four fixed action items, for every scope group with a scorecard."""
    keys = scope_cols(scope)
    items = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(d).alias("description"))
                      for t, d in ACTION_ITEMS])
    groups = scorecard.select(*keys).distinct() if keys else scorecard.groupBy().count().filter("count > 0")
    return (groups.select(*keys, F.posexplode(items).alias("pos", "a"))
            .select(*keys, (F.col("pos") + 1).alias("item"), "a.title", "a.description"))
