"""DuckDB SQL equivalents of :mod:`orderlens.plans.queries` (the oracle).

Each statement runs on the raw test tables through the adapter views
``o`` (orders), ``ev`` (uploads) and ``sl`` (sellers) from
:mod:`orderlens.sources.testdata`.  Rounding is half-to-even on the scaled
double, matching ``rint`` on the Spark side.
"""

from __future__ import annotations

from orderlens.operators.category import (
    ACTION_ITEMS, MSG_ELEVATED_RETURN, MSG_EXPAND_TOP, MSG_FOCUS_RETURNS, MSG_HIGH_RETURN, MSG_LOW_MARGIN, MSG_STRONG,
)
from orderlens.sources.testdata import CATALOG_CUTOFF, with_views


def R(x: str, k: int) -> str:
    """Half-even rounding to k decimals of a DOUBLE expression."""
    if k == 0:
        return f"round_even(CAST({x} AS DOUBLE), 0)"
    s = f"{10 ** k}.0::DOUBLE"
    return f"(round_even(CAST({x} AS DOUBLE) * {s}, 0) / {s})"


def DIV(a: str, b: str) -> str:
    """Double division, NULL on a zero divisor."""
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0.0::DOUBLE))"


def PCT(a: str, b: str) -> str:
    return f"({DIV(a, b)} * 100.0::DOUBLE)"


def GPCT(a: str, b: str, k: int = 2) -> str:
    """Rounded percent, 0.0 when the base is not positive."""
    return f"(CASE WHEN {b} > 0 THEN {R(PCT(a, b), k)} ELSE 0.0::DOUBLE END)"


def ORD(d: str) -> str:
    return (f"(CAST({d} AS VARCHAR) || CASE WHEN {d} BETWEEN 11 AND 13 THEN 'th' "
            f"WHEN {d} % 10 = 1 THEN 'st' WHEN {d} % 10 = 2 THEN 'nd' WHEN {d} % 10 = 3 THEN 'rd' ELSE 'th' END)")


def PARSE(s: str) -> str:
    return (f"(CASE WHEN regexp_full_match({s}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') "
            f"AND split_part({s}, '-', 3) <> '0000' "
            f"THEN CAST(try_strptime({s}, '%d-%m-%Y') AS DATE) END)")


def ELLIPSIS(s: str, n: int) -> str:
    return f"(CASE WHEN length({s}) > {n} THEN substring({s}, 1, {n}) || '...' ELSE {s} END)"


def MONTH_LABEL(y: str, m: str) -> str:
    return f"(strftime(make_date(CAST({y} AS BIGINT), CAST({m} AS BIGINT), 1), '%B') || ' ' || CAST({y} AS VARCHAR))"


MONEY = "CAST(COALESCE(SUM({c}), 0) AS DOUBLE)"
RET = "order_status = 'returned'"
ORDER_OUT = ("seller_id, order_id, order_date, catalogue_id, sku_description, CAST(item_price AS DOUBLE) AS item_price, "
             "quantity, CAST(order_price AS DOUBLE) AS order_price, order_status, return_type, "
             "CAST(return_cost AS DOUBLE) AS return_cost, return_reason, category, order_dt")
UPLOAD_OUT = ("upload_id, seller_id, filename, original_name, filepath, "
              "strftime(upload_date, '%Y-%m-%d %H:%M:%S') AS upload_date, row_count")

SQL: dict[str, str] = {}

SQL["orders_scan"] = f"SELECT {ORDER_OUT} FROM o"

SQL["orders_union"] = f"""
SELECT {ORDER_OUT} FROM (
  SELECT * FROM o WHERE {RET}
  UNION ALL BY NAME
  SELECT * EXCLUDE (return_reason) FROM o WHERE order_status IS DISTINCT FROM 'returned')
"""

SQL["seller_kpis"] = f"""
SELECT seller_id,
  COUNT(*) AS total_orders,
  COUNT(*) FILTER (WHERE {RET}) AS total_returns,
  {GPCT(f"COUNT(*) FILTER (WHERE {RET})", "COUNT(*)")} AS return_percent,
  {MONEY.format(c="order_price")} AS net_sales,
  {MONEY.format(c="return_cost")} AS return_cost,
  CAST(COALESCE(SUM(order_price), 0) - COALESCE(SUM(return_cost), 0) AS DOUBLE) AS net_profit
FROM o GROUP BY seller_id
"""

SQL["upload_kpis"] = f"""
SELECT seller_id, CAST(year(order_dt) AS BIGINT) AS upload_id,
  COUNT(*) AS total_orders,
  COUNT(*) FILTER (WHERE {RET}) AS total_returns,
  {GPCT(f"COUNT(*) FILTER (WHERE {RET})", "COUNT(*)")} AS return_percent,
  {MONEY.format(c="order_price")} AS net_sales,
  {MONEY.format(c="return_cost")} AS return_cost,
  CAST(COALESCE(SUM(order_price), 0) - COALESCE(SUM(return_cost), 0) AS DOUBLE) AS net_profit
FROM o GROUP BY seller_id, CAST(year(order_dt) AS BIGINT)
"""

# Order files written from the same rows and read back (batch CSV reader /
# streaming folder ingest) give exactly the seller KPIs.
SQL["orders_csv_kpis"] = SQL["seller_kpis"]
SQL["stream_ingest_kpis"] = SQL["seller_kpis"]

SQL["kpi_missing_cols"] = f"""
SELECT seller_id,
  COUNT(*) AS total_orders,
  CAST(0 AS BIGINT) AS total_returns,
  0.0::DOUBLE AS return_percent,
  {MONEY.format(c="order_price")} AS net_sales,
  0.0::DOUBLE AS return_cost,
  {MONEY.format(c="order_price")} AS net_profit
FROM o GROUP BY seller_id
"""

SQL["order_validation"] = f"""
SELECT seller_id,
  COUNT(*) AS lines,
  COUNT(*) FILTER (WHERE order_date IS NOT NULL AND order_dt IS NULL) AS bad_dates,
  COUNT(*) FILTER (WHERE order_id IS NULL) AS missing_order_ids,
  COUNT(*) FILTER (WHERE order_price IS NULL) AS missing_prices,
  COUNT(*) FILTER (WHERE order_status IS NOT NULL
                     AND order_status NOT IN ('delivered', 'cancelled', 'returned')) AS unknown_statuses,
  COUNT(*) FILTER (WHERE order_price IS NOT NULL AND item_price IS NOT NULL AND quantity IS NOT NULL
                     AND order_price <> item_price * quantity) AS price_mismatches,
  '' AS absent_columns
FROM o GROUP BY seller_id
"""

SQL["daily_sales"] = f"""
SELECT seller_id, order_date,
  {PARSE("order_date")} AS order_dt,
  CASE WHEN instr(order_date, '-') > 0
       THEN {ORD("TRY_CAST(split_part(order_date, '-', 1) AS INTEGER)")} ELSE order_date END AS label,
  {MONEY.format(c="order_price")} AS total_amount,
  COUNT(order_price) AS order_count
FROM o WHERE order_date IS NOT NULL
GROUP BY seller_id, order_date
"""

SQL["return_reasons"] = f"""
SELECT seller_id, return_reason, COUNT(*) AS cnt
FROM o WHERE {RET} AND return_reason IS NOT NULL
GROUP BY seller_id, return_reason
"""


def _top_returned(key: str, label: str) -> str:
    return f"""
SELECT seller_id, {label} AS {key}, return_count, CAST(rnk AS INTEGER) AS rnk FROM (
  SELECT seller_id, {key}, COUNT(order_id) AS return_count,
         ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY COUNT(order_id) DESC, {key} ASC) AS rnk
  FROM o WHERE {RET} AND {key} IS NOT NULL
  GROUP BY seller_id, {key})
WHERE rnk <= 5
"""


SQL["top_returned_catalogues"] = _top_returned("catalogue_id", "CAST(catalogue_id AS VARCHAR)")
SQL["top_returned_skus"] = _top_returned("sku_description", "sku_description")

SQL["category_mapped"] = """
SELECT seller_id, catalogue_id, category, COUNT(order_id) AS orders FROM (
  SELECT x.seller_id, x.catalogue_id, x.order_id,
         COALESCE(d.category, 'Category ' || CAST(x.catalogue_id AS VARCHAR)) AS category
  FROM (SELECT seller_id, order_id, CASE WHEN order_status = 'cancelled' THEN catalogue_id + 1000000000 ELSE catalogue_id END AS catalogue_id FROM o) x
       LEFT JOIN (SELECT p_partkey AS catalogue_id, p_type AS category FROM part) d ON x.catalogue_id = d.catalogue_id)
WHERE category IS NOT NULL
GROUP BY seller_id, catalogue_id, category
"""

def _message(template: str, value: str | None = None) -> str:
    """A message template as a SQL expression over ``name`` and ``value``."""
    quoted = "'" + template.replace("'", "''") + "'"
    out = f"replace({quoted}, '{{name}}', name)"
    return f"replace({out}, '{{value}}', CAST({value} AS VARCHAR))" if value else out


SCORECARD_CTE = f"""
g AS (
  SELECT seller_id, category AS name,
         COALESCE(SUM(order_price), 0) AS rev_d, COUNT(order_id) AS orders,
         COUNT(*) FILTER (WHERE {RET}) AS returns, COALESCE(SUM(return_cost), 0) AS rc_d
  FROM o WHERE category IS NOT NULL GROUP BY seller_id, category),
s0 AS (
  SELECT seller_id, name, CAST(rev_d AS DOUBLE) AS revenue, orders, returns,
         CAST(rc_d AS DOUBLE) AS return_cost,
         CASE WHEN rev_d > 0 THEN {DIV("rev_d - rc_d", "rev_d")} * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS profit_margin,
         {R(PCT("returns", "orders"), 2)} AS return_rate,
         {R(DIV("rev_d", "orders"), 2)} AS avg_order_value
  FROM g),
mx AS (SELECT seller_id, MAX(revenue) AS max_rev FROM s0 GROUP BY seller_id),
sc AS (
  SELECT s0.*, {R(f'''{DIV("s0.revenue", "mx.max_rev")} * 30.0::DOUBLE
           + (100.0::DOUBLE - s0.return_rate) * 0.4::DOUBLE
           + GREATEST(0.0::DOUBLE, LEAST(50.0::DOUBLE, s0.profit_margin)) / 50.0::DOUBLE * 30.0::DOUBLE''', 0)}
           AS performance_score
  FROM s0 JOIN mx ON s0.seller_id = mx.seller_id)
"""

SQL["category_scorecard"] = f"WITH {SCORECARD_CTE} SELECT * FROM sc"


def _top_categories(by: str) -> str:
    return f"""WITH {SCORECARD_CTE}
SELECT seller_id, name, revenue, orders, CAST(rnk AS INTEGER) AS rnk FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY {by} DESC, name ASC) AS rnk FROM sc)
WHERE rnk <= 5
"""


SQL["top_categories_by_revenue"] = _top_categories("revenue")
SQL["top_categories_by_orders"] = _top_categories("orders")

SQL["category_insights"] = f"""WITH {SCORECARD_CTE}
SELECT seller_id, name, 'danger' AS severity, 'high_return_rate' AS rule, return_rate AS metric, {_message(MSG_HIGH_RETURN, "return_rate")} AS message
  FROM sc WHERE return_rate > 15
UNION ALL
SELECT seller_id, name, 'warning', 'elevated_return_rate', return_rate, {_message(MSG_ELEVATED_RETURN, "return_rate")}
  FROM sc WHERE return_rate > 10 AND NOT (return_rate > 15)
UNION ALL
SELECT seller_id, name, 'success', 'high_performance', performance_score, {_message(MSG_STRONG, "performance_score")} FROM sc WHERE performance_score > 70
UNION ALL
SELECT seller_id, name, 'warning', 'low_profit_margin', profit_margin, {_message(MSG_LOW_MARGIN, "profit_margin")} FROM sc WHERE profit_margin < 10
"""

SQL["category_recommendations"] = f"""WITH {SCORECARD_CTE}
SELECT DISTINCT seller_id, 'focus_high_returns' AS rule, CAST(NULL AS VARCHAR) AS name, '{MSG_FOCUS_RETURNS}' AS message FROM sc WHERE return_rate > 15
UNION ALL
SELECT seller_id, 'expand_top_category', name, {_message(MSG_EXPAND_TOP)} FROM (
  SELECT seller_id, name, ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY revenue DESC, name ASC) AS rnk FROM sc)
WHERE rnk = 1
"""

SQL["category_actions"] = f"""WITH {SCORECARD_CTE}
SELECT s.seller_id, a.item, a.title, a.description
FROM (SELECT DISTINCT seller_id FROM sc) s,
     (VALUES {", ".join(f"({i}, '{t}', '{d}')" for i, (t, d) in enumerate(ACTION_ITEMS, 1))}) a(item, title, description)
"""

SKU_RANK = f"""
WITH g AS (
  SELECT seller_id, sku_description AS sku, COUNT(order_id) AS orders,
         COALESCE(SUM(order_price), 0) AS rev_d, COALESCE(SUM(return_cost), 0) AS rc_d,
         COUNT(*) FILTER (WHERE {RET}) AS return_count
  FROM o WHERE sku_description IS NOT NULL GROUP BY seller_id, sku_description),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY rev_d DESC, sku ASC) AS rnk FROM g)
SELECT seller_id, CAST(rnk AS INTEGER) AS rnk, sku,
  {ELLIPSIS("sku", 15)} AS sku_short,
  {ELLIPSIS("sku", 30)} AS sku_name,
  CASE WHEN contains(lower(sku), 'electronic') THEN 'Electronics'
       WHEN contains(lower(sku), 'cable') OR contains(lower(sku), 'headphone') THEN 'Accessories'
       ELSE 'General' END AS sku_class,
  orders,
  {R("rev_d", 2)} AS revenue,
  CAST(rc_d AS DOUBLE) AS return_cost,
  {R(PCT("rev_d - rc_d", "rev_d"), 1)} AS profit_margin,
  return_count,
  {R(PCT("return_count", "orders"), 1)} AS return_rate
FROM r WHERE rnk <= 10
"""
SQL["sku_ranking"] = SKU_RANK
SQL["sku_ranking_join"] = SKU_RANK

SQL["sku_detail"] = f"""
WITH req AS (
  SELECT DISTINCT seller_id, sku FROM (
    SELECT seller_id, sku_description AS sku FROM o WHERE sku_description IS NOT NULL
    UNION ALL
    SELECT seller_id, upper(sku_description) FROM o WHERE sku_description IS NOT NULL)),
g AS (
  SELECT seller_id, sku_description AS sku, COUNT(*) AS n, COALESCE(SUM(order_price), 0) AS rev,
         COUNT(*) FILTER (WHERE {RET}) AS ret
  FROM o WHERE sku_description IS NOT NULL GROUP BY seller_id, sku_description)
SELECT req.seller_id, req.sku, {ELLIPSIS("req.sku", 30)} AS sku_label,
  COALESCE(g.n, 0) AS total_orders,
  CAST(COALESCE(g.rev, 0) AS DOUBLE) AS revenue,
  COALESCE(g.ret, 0) AS returns,
  {GPCT("COALESCE(g.ret, 0)", "COALESCE(g.n, 0)")} AS return_rate
FROM req LEFT JOIN g ON req.seller_id = g.seller_id AND req.sku = g.sku
"""

SQL["sku_page_kpis"] = f"""
WITH ps AS (
  SELECT seller_id, sku_description AS sku, COUNT(*) AS rows_n, COUNT(order_id) AS orders,
         COUNT(*) FILTER (WHERE {RET}) AS return_count,
         COUNT(*) FILTER (WHERE order_status = 'delivered') AS delivered,
         COALESCE(SUM(order_price), 0) AS rev, COALESCE(SUM(return_cost), 0) AS rc,
         COALESCE(SUM(CASE WHEN {RET} THEN order_price END), 0) AS refund,
         COALESCE(SUM(quantity), 0) AS qty
  FROM o GROUP BY seller_id, sku_description),
ps2 AS (
  SELECT *, {R(PCT("rev - rc", "rev"), 1)} AS pm, {R(PCT("return_count", "orders"), 1)} AS rr FROM ps),
g AS (
  SELECT seller_id, SUM(rows_n) AS n, SUM(return_count) AS refunds, SUM(delivered) AS delivered,
         SUM(rev) AS sales, SUM(rc) AS rc, SUM(refund) AS refund, SUM(qty) AS qty,
         COUNT(*) FILTER (WHERE sku IS NOT NULL) AS distinct_skus,
         COUNT(*) FILTER (WHERE sku IS NOT NULL AND return_count > 0) AS returned_skus,
         COUNT(*) FILTER (WHERE sku IS NOT NULL AND pm < 0) AS loss_making_skus,
         COUNT(*) FILTER (WHERE sku IS NOT NULL AND rr > 15) AS high_risk_skus,
         SUM(CASE WHEN sku IS NOT NULL THEN CAST(pm AS DECIMAL(12,1)) END) AS msum,
         COUNT(CASE WHEN sku IS NOT NULL THEN pm END) AS mn
  FROM ps2 GROUP BY seller_id)
SELECT seller_id,
  CAST(sales AS DOUBLE) AS total_revenue,
  CAST(n AS BIGINT) AS total_units_sold,
  CAST(LEAST(returned_skus, 5) AS BIGINT) AS total_skus_listed,
  CASE WHEN n > 0 THEN {R(DIV("sales", "n"), 2)} ELSE 0.0::DOUBLE END AS aov,
  {R(PCT("sales - rc", "sales"), 2)} AS gross_margin,
  {GPCT("refunds", "n")} AS return_rate,
  CAST(sales - rc AS DOUBLE) AS total_profit,
  {R(DIV("msum", "mn"), 2)} AS avg_profit_margin,
  CAST(loss_making_skus AS BIGINT) AS loss_making_skus,
  CAST(refunds AS BIGINT) AS total_refunds,
  CAST(refund AS DOUBLE) AS refund_amount,
  {GPCT("delivered", "n")} AS delivery_success_rate,
  CAST(high_risk_skus AS BIGINT) AS high_risk_skus,
  CAST(distinct_skus AS BIGINT) AS distinct_skus,
  CAST(qty AS BIGINT) AS total_quantity
FROM g
"""

SQL["date_parse"] = f"""
WITH v AS (
  SELECT DISTINCT unnest([
    order_date,
    regexp_replace(order_date, '(^|-)0', '\\1', 'g'),
    substring(order_date, 1, 6) || substring(order_date, 9, 2),
    substring(order_date, 7, 4) || '-' || substring(order_date, 4, 2) || '-' || substring(order_date, 1, 2),
    replace(order_date, '-', '/'),
    order_date || ' ',
    '0' || order_date,
    '31' || substring(order_date, 3, 8)]) AS raw
  FROM o)
SELECT raw, {PARSE("raw")} AS order_dt FROM v
"""

DATED = """d AS (
  SELECT *, CAST(year(order_dt) AS INTEGER) AS year, CAST(month(order_dt) AS INTEGER) AS month,
         CAST(day(order_dt) AS INTEGER) AS day
  FROM o WHERE order_dt IS NOT NULL)"""

SQL["month_daily_revenue"] = f"""WITH {DATED}
SELECT seller_id, year, month, day, {MONEY.format(c="order_price")} AS revenue
FROM d GROUP BY seller_id, year, month, day
"""

MONTH_KPIS = f"""mk AS (
  SELECT seller_id, year, month,
         {MONTH_LABEL("year", "month")} AS month_year,
         COUNT(*) AS total_orders,
         CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS total_quantity,
         {MONEY.format(c="order_price")} AS total_revenue,
         {DIV("COALESCE(SUM(order_price), 0)", "COUNT(*)")} AS avg_order_value,
         COUNT(*) FILTER (WHERE order_status = 'delivered') AS delivered_count,
         COUNT(*) FILTER (WHERE order_status = 'cancelled') AS cancelled_count,
         COUNT(*) FILTER (WHERE {RET}) AS returned_count,
         {MONEY.format(c="return_cost")} AS return_cost,
         {GPCT(f"COUNT(*) FILTER (WHERE {RET})", "COUNT(*)")} AS return_rate,
         TRUE AS has_data
  FROM d GROUP BY seller_id, year, month)"""

SQL["month_kpis"] = f"WITH {DATED}, {MONTH_KPIS} SELECT * FROM mk"
# the order table stored month-partitioned and read back gives the same
SQL["orders_sink_month_kpis"] = SQL["month_kpis"]

SQL["month_return_reasons"] = f"""WITH {DATED}
SELECT seller_id, year, month, return_reason, COUNT(*) AS cnt
FROM d WHERE {RET} AND return_reason IS NOT NULL
GROUP BY seller_id, year, month, return_reason
"""

_MEASURES = ["total_orders", "total_quantity", "total_revenue", "avg_order_value", "delivered_count",
             "cancelled_count", "returned_count", "return_cost", "return_rate"]
_INT_MEASURES = {"total_orders", "total_quantity", "delivered_count", "cancelled_count", "returned_count"}


def _side(t: str, alias: str) -> str:
    ym = f"p.ym{t}"
    cols = [f"CAST({ym} // 12 AS INTEGER) AS year{t}",
            f"CAST({ym} % 12 + 1 AS INTEGER) AS month{t}",
            f"{MONTH_LABEL(f'{ym} // 12', f'{ym} % 12 + 1')} AS month_year{t}",
            f"{alias}.total_orders IS NOT NULL AS has_data{t}"]
    for c in _MEASURES:
        zero = "CAST(0 AS BIGINT)" if c in _INT_MEASURES else "0.0::DOUBLE"
        cols.append(f"COALESCE({alias}.{c}, {zero}) AS {c}{t}")
    return ",\n    ".join(cols)


SQL["month_comparison"] = f"""WITH {DATED}, {MONTH_KPIS},
k AS (SELECT *, year * 12 + month - 1 AS ym FROM mk),
p AS (SELECT DISTINCT seller_id, ym1, ym2 FROM (
        SELECT seller_id, ym - 1 AS ym1, ym AS ym2 FROM k
        UNION ALL
        SELECT seller_id, ym AS ym1, ym + 1 AS ym2 FROM k)),
z AS (
  SELECT p.seller_id,
    {_side("1", "a")},
    {_side("2", "b")}
  FROM p
  LEFT JOIN k a ON a.seller_id = p.seller_id AND a.ym = p.ym1
  LEFT JOIN k b ON b.seller_id = p.seller_id AND b.ym = p.ym2)
SELECT *,
  total_revenue2 - total_revenue1 AS revenue_change,
  {GPCT("total_revenue2 - total_revenue1", "total_revenue1")} AS revenue_change_pct,
  total_orders2 - total_orders1 AS orders_change,
  {GPCT("total_orders2 - total_orders1", "total_orders1")} AS orders_change_pct,
  return_rate2 - return_rate1 AS return_rate_change,
  avg_order_value2 - avg_order_value1 AS aov_change,
  {GPCT("avg_order_value2 - avg_order_value1", "avg_order_value1")} AS aov_change_pct
FROM z
"""

SQL["available_years"] = f"""WITH {DATED},
y AS (SELECT DISTINCT seller_id, year FROM d)
SELECT seller_id, year FROM y
UNION ALL
SELECT s.seller_id, CAST(f.year AS INTEGER) AS year
FROM (SELECT DISTINCT seller_id FROM o WHERE seller_id NOT IN (SELECT seller_id FROM y)) s,
     (VALUES (2024), (2025), (2026)) f(year)
"""

SQL["uploads_list"] = """
SELECT seller_id, upload_id, filename, original_name, filepath,
       strftime(upload_date, '%Y-%m-%d %H:%M:%S') AS upload_date, row_count,
       CAST(ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY upload_date DESC NULLS LAST, upload_id DESC) - 1
            AS INTEGER) AS position
FROM ev
"""

SQL["uploads_by_date"] = """
SELECT seller_id, strftime(upload_date, '%Y-%m-%d') AS upload_day, COUNT(*) AS uploads
FROM ev GROUP BY seller_id, strftime(upload_date, '%Y-%m-%d')
"""

LATEST = """(SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY upload_date DESC NULLS LAST, upload_id DESC) AS rn
  FROM {src}) WHERE rn = 1)"""

SQL["latest_upload"] = f"SELECT {UPLOAD_OUT} FROM {LATEST.format(src='ev')}"

SQL["upload_lookup"] = f"""
WITH req AS (
  SELECT seller_id, upload_id FROM ev
  UNION
  SELECT seller_id + 1, upload_id FROM ev WHERE event_type = 'click')
SELECT {UPLOAD_OUT} FROM ev
WHERE EXISTS (SELECT 1 FROM req WHERE req.seller_id = ev.seller_id AND req.upload_id = ev.upload_id)
"""

KNOWN = f"(SELECT * FROM ev WHERE upload_date < TIMESTAMP '{CATALOG_CUTOFF}')"

SQL["upload_discovery"] = f"""
SELECT DISTINCT filename, filepath FROM ev
WHERE regexp_full_match(filename, '[^.].*_[0-9].*\\.csv')
  AND filename NOT IN (SELECT filename FROM {KNOWN})
"""

ROWS_PER_FILE = "(SELECT filepath, COUNT(*) AS n FROM ev WHERE event_type <> 'signup' GROUP BY filepath)"

SQL["upload_row_counts"] = f"""
SELECT f.filepath, CAST(COALESCE(c.n, 0) AS BIGINT) AS row_count
FROM (SELECT DISTINCT filepath FROM ev) f LEFT JOIN {ROWS_PER_FILE} c ON f.filepath = c.filepath
"""

SQL["upload_register"] = f"""
WITH new AS (
  SELECT DISTINCT filename, filepath FROM ev
  WHERE regexp_full_match(filename, '[^.].*_[0-9].*\\.csv')
    AND filename NOT IN (SELECT filename FROM {KNOWN}))
SELECT TRY_CAST(split_part(new.filename, '_', 1) AS BIGINT) AS seller_id, new.filename,
       new.filename AS original_name, new.filepath, CAST(COALESCE(c.n, 0) AS BIGINT) AS row_count,
       split_part(new.filename, '_', 1) || '_' || new.filename AS stored_name
FROM new LEFT JOIN {ROWS_PER_FILE} c ON new.filepath = c.filepath
"""

LISTING = "(SELECT DISTINCT filename, filepath FROM ev WHERE event_type <> 'error')"
EXISTING = f"(SELECT * FROM ev WHERE filepath IN (SELECT filepath FROM {LISTING}))"

SQL["uploads_existing"] = f"SELECT {UPLOAD_OUT} FROM {EXISTING}"

SQL["latest_existing_upload"] = f"SELECT {UPLOAD_OUT} FROM {LATEST.format(src=EXISTING)}"

SQL["upload_selection"] = f"""
WITH per AS (
  SELECT seller_id,
         MAX(CASE WHEN event_type = 'click' THEN upload_id END) AS own_click,
         MAX(upload_id) AS max_id,
         arg_min(filepath, (upload_date, upload_id)) AS first_path
  FROM ev GROUP BY seller_id),
req AS (
  SELECT seller_id,
         CASE WHEN seller_id % 4 = 0 THEN own_click WHEN seller_id % 4 = 1 THEN max_id + 1 END AS req_id,
         CASE WHEN seller_id % 4 = 2 THEN first_path END AS sticky_path
  FROM per),
latest AS (SELECT seller_id, upload_id AS lat_id, filepath AS lat_path FROM {LATEST.format(src=EXISTING)}),
sticky_ids AS (
  SELECT seller_id, filepath AS sticky_path, arg_max(upload_id, (upload_date, upload_id)) AS sticky_id
  FROM ev GROUP BY seller_id, filepath),
j AS (
  SELECT r.seller_id, r.req_id, r.sticky_path,
         e.upload_id AS exp_id, e.filepath AS exp_path,
         r.sticky_path IN (SELECT filepath FROM {LISTING}) AS sticky_ok,
         l.lat_id, l.lat_path, s.sticky_id
  FROM req r
  LEFT JOIN ev e ON e.seller_id = r.seller_id AND e.upload_id = r.req_id
  LEFT JOIN latest l ON l.seller_id = r.seller_id
  LEFT JOIN sticky_ids s ON s.seller_id = r.seller_id AND s.sticky_path = r.sticky_path)
SELECT seller_id, req_id, sticky_path,
  CASE WHEN req_id IS NOT NULL THEN (CASE WHEN exp_id IS NOT NULL THEN 'explicit' END)
       WHEN COALESCE(sticky_ok, FALSE) THEN 'sticky'
       WHEN lat_id IS NOT NULL THEN 'latest' END AS source,
  CASE WHEN req_id IS NOT NULL THEN exp_id WHEN COALESCE(sticky_ok, FALSE) THEN sticky_id ELSE lat_id END AS upload_id,
  CASE WHEN req_id IS NOT NULL THEN exp_path WHEN COALESCE(sticky_ok, FALSE) THEN sticky_path ELSE lat_path END AS filepath
FROM j
"""

SQL["upload_delete"] = f"SELECT {UPLOAD_OUT} FROM ev WHERE event_type <> 'error'"

SQL["seller_purge"] = f"""
SELECT {UPLOAD_OUT} FROM ev
WHERE seller_id NOT IN (SELECT seller_id FROM sl WHERE balance < 0)
"""

SQL["seller_upsert"] = """
WITH cur AS (SELECT seller_id, name, store_name, email FROM sl),
upd AS (
  SELECT seller_id, CAST(NULL AS VARCHAR) AS name, upper(store_name) AS store_name, CAST(NULL AS VARCHAR) AS email
  FROM sl WHERE nation_id % 2 = 0
  UNION ALL
  SELECT seller_id + 1000000, name, store_name, email FROM sl WHERE nation_id = 0)
SELECT COALESCE(cur.seller_id, upd.seller_id) AS seller_id,
       COALESCE(upd.name, cur.name) AS name,
       COALESCE(upd.store_name, cur.store_name) AS store_name,
       COALESCE(upd.email, cur.email) AS email
FROM cur FULL OUTER JOIN upd ON cur.seller_id = upd.seller_id
"""

SQL["schema_evolve"] = """
SELECT seller_id, name, email, '' AS store_name, CAST(NULL AS VARCHAR) AS unique_code,
       'fa-user' AS profile_icon, CAST(NULL AS VARCHAR) AS profile_photo
FROM sl
"""

SQL["unique_violations"] = """
SELECT filename, COUNT(*) AS n FROM ev WHERE filename IS NOT NULL GROUP BY filename HAVING COUNT(*) > 1
"""


SQL["orders_csv_wide"] = SQL["seller_kpis"]
SQL["file_row_counts"] = "SELECT seller_id, CAST(COUNT(*) AS BIGINT) AS row_count FROM o GROUP BY seller_id"

_YEARLY = "(SELECT *, CAST(seller_id * 10000 + year(order_dt) AS BIGINT) AS upload_id FROM o)"
_TOTALS = "SELECT seller_id, upload_id, COUNT(*) AS lines, CAST(SUM(order_price) AS DOUBLE) AS amount"
SQL["upload_replace"] = f"{_TOTALS} FROM {_YEARLY} WHERE year(order_dt) <> 1995 OR {RET} GROUP BY seller_id, upload_id"
SQL["orders_delete"] = f"{_TOTALS} FROM {_YEARLY} WHERE year(order_dt) <> 1996 GROUP BY seller_id, upload_id"
SQL["orders_purge"] = f"{_TOTALS} FROM {_YEARLY} WHERE seller_id NOT IN (SELECT seller_id FROM sl WHERE balance < 0) GROUP BY seller_id, upload_id"
SQL["sellers_purge"] = "SELECT seller_id, name, store_name, email FROM sl WHERE balance >= 0"

SQL["kpi_document"] = f"""
SELECT k.*, r.reasons, c.catalogues, s.skus
FROM ({SQL["seller_kpis"]}) k
LEFT JOIN (SELECT seller_id, string_agg(return_reason || '=' || cnt, ';' ORDER BY return_reason) AS reasons FROM ({SQL["return_reasons"]}) GROUP BY seller_id) r USING (seller_id)
LEFT JOIN (SELECT seller_id, string_agg(catalogue_id || '=' || return_count, ';' ORDER BY rnk) AS catalogues FROM ({SQL["top_returned_catalogues"]}) GROUP BY seller_id) c USING (seller_id)
LEFT JOIN (SELECT seller_id, string_agg(sku_description || '=' || return_count, ';' ORDER BY rnk) AS skus FROM ({SQL["top_returned_skus"]}) GROUP BY seller_id) s USING (seller_id)
"""

SQL["kpi_document_chunks"] = f"""
SELECT seller_id, CAST(pos // 2 AS INTEGER) AS chunk, string_agg(return_reason || '=' || cnt, ';' ORDER BY pos) AS entries
FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY cnt DESC, return_reason) - 1 AS pos FROM ({SQL["return_reasons"]}))
GROUP BY seller_id, pos // 2
"""

# Of every third seller only the returned lines are left, of every fifth (other) none.
SQL["reingest_kpis"] = SQL["seller_kpis"].replace("FROM o ", f"FROM (SELECT * FROM o WHERE CASE WHEN seller_id % 3 = 0 THEN {RET} ELSE seller_id % 5 <> 0 END) ")
SQL["reingest_kpis"] = f"SELECT * FROM ({SQL['reingest_kpis']}), (VALUES ('lines'), ('rollup')) t (taken_from)"

_FOLDER = "(SELECT DISTINCT seller_id, 0 AS empty FROM o UNION ALL SELECT 0, 1)"
SQL["files_listed"] = f"SELECT seller_id, COUNT(*) AS files, CAST(SUM(empty) AS BIGINT) AS empty_files FROM {_FOLDER} GROUP BY seller_id"
SQL["folder_scan_catalog"] = f"""
SELECT seller_id, COUNT(*) AS files, COUNT(*) AS paths,
  CAST(coalesce(any_value(n), 0) AS BIGINT) AS row_count
FROM {_FOLDER} LEFT JOIN (SELECT seller_id, COUNT(*) AS n FROM o WHERE seller_id % 2 = 0 GROUP BY seller_id) USING (seller_id)
GROUP BY seller_id
"""

SQL["orders_evolved"] = f"""
SELECT seller_id, CASE WHEN year(order_dt) < 1996 THEN 'unknown' WHEN {RET} THEN 'shop' END AS channel,
  CASE WHEN year(order_dt) >= 1996 THEN return_reason END AS return_reason, COUNT(*) AS lines, CAST(SUM(order_price) AS DOUBLE) AS amount
FROM o GROUP BY ALL
"""

SQL["seller_upsert_last"] = """
WITH cur AS (SELECT seller_id, name, store_name, email FROM sl),
given AS (
  SELECT seller_id, upload_date, upload_id, CASE WHEN event_type <> 'signup' THEN 'Store ' || upload_id END AS store_name,
    CASE WHEN event_type = 'purchase' THEN upload_id || '@example.com' END AS email FROM ev),
upd AS (
  SELECT seller_id, arg_max(store_name, (upload_date, upload_id)) FILTER (WHERE store_name IS NOT NULL) AS store_name,
    arg_max(email, (upload_date, upload_id)) FILTER (WHERE email IS NOT NULL) AS email FROM given GROUP BY seller_id)
SELECT COALESCE(cur.seller_id, upd.seller_id) AS seller_id, cur.name, COALESCE(upd.store_name, cur.store_name) AS store_name, COALESCE(upd.email, cur.email) AS email
FROM cur FULL OUTER JOIN upd ON cur.seller_id = upd.seller_id
"""

SQL["register_unique"] = """
WITH new AS (
  SELECT upload_id, upload_date, CASE WHEN event_type <> 'error' THEN 'supplier' || lpad(CAST(upload_id % 5000 AS VARCHAR), 9, '0') || '@example.com' END AS email FROM ev)
SELECT upload_id, email,
  CASE WHEN email IN (SELECT email FROM sl) THEN 'email exists'
       WHEN email IS NOT NULL AND row_number() OVER (PARTITION BY email ORDER BY upload_date, upload_id) > 1 THEN 'email repeated' END AS reason
FROM new
"""

_HASH = "CAST('0x' || substr(md5(sku_description), 1, 8) AS BIGINT)"
SQL["sku_buckets"] = f"""
SELECT DISTINCT sku_description AS sku, 'Brand-' || substr(CAST({_HASH} % 1000 AS VARCHAR), 1, 3) AS brand, 'WH-' || CAST({_HASH} % 3 + 1 AS VARCHAR) AS warehouse
FROM o WHERE sku_description IS NOT NULL
"""

SQL["sku_detail_one"] = f"""
SELECT d.* FROM ({SQL["sku_detail"]}) d
JOIN (SELECT seller_id, MIN(sku_description) AS sku FROM o GROUP BY seller_id) m ON d.seller_id = m.seller_id AND d.sku = m.sku
"""


def _month_pair(first: tuple[int, int], second: tuple[int, int]) -> str:
    ym1, ym2 = (y * 12 + m - 1 for y, m in (first, second))
    pairs = SQL["month_comparison"]
    a, b = pairs.index("p AS (SELECT"), pairs.index("z AS (")
    return f"{pairs[:a]}p AS (SELECT DISTINCT seller_id, {ym1} AS ym1, {ym2} AS ym2 FROM k WHERE ym IN ({ym1}, {ym2})),\n{pairs[b:]}"


SQL["month_pair"] = _month_pair((1995, 3), (1996, 3))
SQL["month_pair_absent"] = _month_pair((1995, 3), (1970, 1))


def oracle_sql() -> dict[str, str]:
    """Full statements (adapter views included) keyed by query name."""
    return {name: with_views(sql) for name, sql in SQL.items()}
