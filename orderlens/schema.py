"""Schemas and fixed values of the order/return data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Order-line table: the 11 columns of a seller's order file plus the optional
# ``category`` column.  Money is decimal so sums are exact.
ORDER_COLUMNS: list[tuple[str, T.DataType]] = [
    ("order_id", T.LongType()),
    ("order_date", T.StringType()),
    ("catalogue_id", T.LongType()),
    ("sku_description", T.StringType()),
    ("item_price", T.DecimalType(28, 8)),
    ("quantity", T.LongType()),
    ("order_price", T.DecimalType(28, 8)),
    ("order_status", T.StringType()),
    ("return_type", T.StringType()),
    ("return_cost", T.DecimalType(28, 8)),
    ("return_reason", T.StringType()),
    ("category", T.StringType()),
]
ORDER_TYPES: dict[str, T.DataType] = dict(ORDER_COLUMNS)
ORDER_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in ORDER_COLUMNS])

# Columns every ingested row carries besides the file's own columns.
LINEAGE_COLUMNS: list[tuple[str, T.DataType]] = [
    ("seller_id", T.LongType()),
    ("upload_id", T.LongType()),
    ("source_file", T.StringType()),
]

UPLOAD_SCHEMA = T.StructType([
    T.StructField("upload_id", T.LongType(), False),
    T.StructField("seller_id", T.LongType(), True),
    T.StructField("filename", T.StringType(), False),
    T.StructField("original_name", T.StringType(), False),
    T.StructField("filepath", T.StringType(), False),
    T.StructField("upload_date", T.TimestampType(), True),
    T.StructField("row_count", T.LongType(), True),
])

SELLER_SCHEMA = T.StructType([
    T.StructField("seller_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("store_name", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
])

# --- fixed values -----------------------------------------------------------
# These must equal the values the original application uses.

# Status values (compared case-sensitively, untrimmed).
STATUS_RETURNED = "returned"
STATUS_DELIVERED = "delivered"
STATUS_CANCELLED = "cancelled"

# Text read as missing by the CSV reader the original application relies on
# (pandas' default NA tokens).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Catalogue id -> category name dictionary; unmapped ids become "Category <id>".
CATALOGUE_CATEGORIES: list[tuple[int, str]] = [
    (362950628, "Men's Kurtas"),
    (685582861, "Women's Sarees"),
    (334760738, "Men's Shirts"),
    (868820204, "Women's Dresses"),
    (969119330, "Kids Wear"),
    (266944844, "Accessories"),
    (485451171, "Footwear"),
    (675770529, "Bags"),
    (774996843, "Jewelry"),
    (149203558, "Watches"),
    (586845604, "Electronics"),
    (386665249, "Home Decor"),
    (362863730, "Beauty Products"),
    (924970419, "Sports Gear"),
    (171069472, "Kitchenware"),
    (636045484, "Furniture"),
    (364814270, "Toys"),
    (726563708, "Books"),
    (197613238, "Food Items"),
]
UNMAPPED_CATEGORY_PREFIX = "Category "

# Years offered when a seller has no parseable order date.
FALLBACK_YEARS = [2024, 2025, 2026]

# Defaults when a column is absent from a file.
DEFAULT_SKU_MARGIN = 35.0
DEFAULT_SKU_RETURN_RATE = 5.0

# Upload folder conventions.
UPLOAD_GLOB = "*_[0-9]*.csv"
ALLOWED_EXTENSIONS = ["csv"]
DEFAULT_PROFILE_ICON = "fa-user"


def catalogue_dim(spark: SparkSession) -> DataFrame:
    """The catalogue dictionary as a two-column dimension (19 rows)."""
    schema = T.StructType([
        T.StructField("catalogue_id", T.LongType(), False),
        T.StructField("category", T.StringType(), False),
    ])
    return spark.createDataFrame(CATALOGUE_CATEGORIES, schema)
