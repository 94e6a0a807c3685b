"""Adapters from the supplied parquet test tables to our data model.

``lineitem ⋈ part`` becomes the order-line table, ``events`` the upload
catalog and ``supplier`` the seller dimension.  Each adapter exists twice:
as a DataFrame (what the queries run on) and as DuckDB SQL (the oracle's
view of the same rows).  Both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# l_returnflag -> order_status
STATUS_BY_FLAG = [("R", "returned"), ("A", "cancelled"), ("N", "delivered")]
# l_linestatus -> return_type for returned lines
RETURN_TYPE_BY_LINESTATUS = [("F", "customer"), ("O", "rto")]
# l_linenumber -> return_reason for returned lines (7 -> no reason)
REASON_BY_LINENUMBER = [
    (1, "Wrong product"),
    (2, "Size issue"),
    (3, "Late delivery"),
    (4, "Damaged item"),
    (5, "Color mismatch"),
    (6, "Quality not as expected"),
]
# Catalog entries registered before this instant count as "already known"
# when the upload folder is scanned; later ones are "new files".
CATALOG_CUTOFF = "2024-01-16 00:00:00"
UPLOAD_FOLDER = "uploads"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: str, pairs) -> F.Column:
    expr = None
    for k, v in pairs:
        expr = F.when(F.col(col) == F.lit(k), F.lit(v)) if expr is None else expr.when(F.col(col) == F.lit(k), F.lit(v))
    return expr


PART_COLUMNS = ["sku_description", "item_price", "category"]


def orders_from_tpch(spark: SparkSession, sf_dir: str, part: bool = True) -> DataFrame:
    """Order lines for all sellers (``seller_id = l_suppkey``).  Every line has
    a part, so ``part=False`` leaves out the join together with the columns
    that only it gives (PART_COLUMNS).

    ``order_dt`` is the parsed order date; it is taken from the source
    timestamp directly, which equals parsing the formatted ``order_date``.
    """
    li = _read(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    returned = F.col("l_returnflag") == "R"
    if part:
        p = _read(spark, sf_dir, "part")
        li = li.join(p, li["l_partkey"] == p["p_partkey"], "inner")
    out = li.select(
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_orderkey").alias("order_id"),
        F.date_format("l_shipdate", "dd-MM-yyyy").alias("order_date"),
        F.to_date("l_shipdate").alias("order_dt"),
        F.col("l_partkey").alias("catalogue_id"),
        *([F.col("p_name").alias("sku_description"), F.col("p_retailprice").cast("decimal(18,2)").alias("item_price")] if part else []),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        price.alias("order_price"),
        _case("l_returnflag", STATUS_BY_FLAG).alias("order_status"),
        F.when(returned, _case("l_linestatus", RETURN_TYPE_BY_LINESTATUS)).alias("return_type"),
        F.when(returned & (F.col("l_linestatus") == "F"),
               (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)"))
        .otherwise(F.lit(0).cast("decimal(18,4)")).alias("return_cost"),
        F.when(returned, _case("l_linenumber", REASON_BY_LINENUMBER)).alias("return_reason"),
        *([F.col("p_type").alias("category")] if part else []),
    )
    return out


def uploads_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload catalog: one event = one registered upload."""
    ev = _read(spark, sf_dir, "events")
    fname = F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_type"),
                        F.pmod(F.col("event_id"), F.lit(50)).cast("string"))
    fname = F.concat(fname, F.lit(".csv"))
    return ev.select(
        F.col("event_id").alias("upload_id"),
        F.col("user_id").alias("seller_id"),
        fname.alias("filename"),
        fname.alias("original_name"),
        F.concat(F.lit(UPLOAD_FOLDER + "/"), fname).alias("filepath"),
        F.col("ts").cast("timestamp").alias("upload_date"),
        F.floor("value").cast("bigint").alias("row_count"),
        F.col("event_type"),
    )


def sellers_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seller dimension (no credentials) from ``supplier``."""
    s = _read(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_name").alias("name"),
        F.concat(F.col("s_name"), F.lit(" Store")).alias("store_name"),
        F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), F.lit("@example.com")).alias("email"),
        F.col("s_nationkey").alias("nation_id"),
        F.col("s_acctbal").alias("balance"),
    )


# --- the same adapters as DuckDB SQL (views for the oracle) -----------------

ORDERS_SQL = """
SELECT l.l_suppkey AS seller_id,
       l.l_orderkey AS order_id,
       strftime(l.l_shipdate, '%d-%m-%Y') AS order_date,
       CAST(l.l_shipdate AS DATE) AS order_dt,
       l.l_partkey AS catalogue_id,
       p.p_name AS sku_description,
       CAST(p.p_retailprice AS DECIMAL(18,2)) AS item_price,
       CAST(l.l_quantity AS BIGINT) AS quantity,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS order_price,
       CASE l.l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'cancelled'
                           WHEN 'N' THEN 'delivered' END AS order_status,
       CASE WHEN l.l_returnflag = 'R' THEN
            CASE l.l_linestatus WHEN 'F' THEN 'customer' WHEN 'O' THEN 'rto' END END AS return_type,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F'
            THEN CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4))
            ELSE CAST(0 AS DECIMAL(18,4)) END AS return_cost,
       CASE WHEN l.l_returnflag = 'R' THEN
            CASE l.l_linenumber WHEN 1 THEN 'Wrong product' WHEN 2 THEN 'Size issue'
                 WHEN 3 THEN 'Late delivery' WHEN 4 THEN 'Damaged item'
                 WHEN 5 THEN 'Color mismatch' WHEN 6 THEN 'Quality not as expected' END END AS return_reason,
       p.p_type AS category
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

UPLOADS_SQL = """
SELECT event_id AS upload_id,
       user_id AS seller_id,
       CAST(user_id AS VARCHAR) || '_' || event_type || '_' || CAST(event_id % 50 AS VARCHAR) || '.csv' AS filename,
       CAST(user_id AS VARCHAR) || '_' || event_type || '_' || CAST(event_id % 50 AS VARCHAR) || '.csv' AS original_name,
       'uploads/' || CAST(user_id AS VARCHAR) || '_' || event_type || '_' || CAST(event_id % 50 AS VARCHAR) || '.csv' AS filepath,
       ts AS upload_date,
       CAST(floor(value) AS BIGINT) AS row_count,
       event_type
FROM events
"""

SELLERS_SQL = """
SELECT s_suppkey AS seller_id,
       s_name AS name,
       s_name || ' Store' AS store_name,
       lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com' AS email,
       s_nationkey AS nation_id,
       s_acctbal AS balance
FROM supplier
"""


def with_views(sql: str) -> str:
    """Prefix an oracle query with the adapter views ``o``, ``ev``, ``sl``."""
    head = f"WITH o AS ({ORDERS_SQL}), ev AS ({UPLOADS_SQL}), sl AS ({SELLERS_SQL})"
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"{head},\n{body[4:]}"
    return f"{head}\n{body}"
