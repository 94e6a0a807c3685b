"""Named queries over the supplied test tables.

Each query takes ``(spark, sf_dir)``, reads whole tables through the
adapters in :mod:`orderlens.sources.testdata` and returns a DataFrame.  The
equivalent DuckDB SQL for each lives in :mod:`orderlens.plans.oracle`.
Request/listing tables that the catalog operations need are derived from
the ``events`` and ``supplier`` rows, so their size grows with the data.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.dates import DISPLAY_TIMESTAMP
from orderlens.operators import catalog, category, kpis, months, sku
from orderlens.operators.quality import validate_orders
from orderlens.schema import DEFAULT_PROFILE_ICON, ORDER_COLUMNS
from orderlens.sources.csv_orders import union_orders
from orderlens.sources.files import export_csv, write_orders
from orderlens.sources.testdata import (
    CATALOG_CUTOFF, orders_from_tpch, sellers_from_supplier, uploads_from_events,
)

#: Months that the month pair compares.
CHOSEN_MONTHS = ((1995, 3), (1996, 3))

Query = Callable[[SparkSession, str], DataFrame]

_ORDER_OUT = ["seller_id"] + [n for n, _ in ORDER_COLUMNS] + ["order_dt"]
_MONEY = {"item_price", "order_price", "return_cost"}
_UPLOAD_OUT = ["upload_id", "seller_id", "filename", "original_name", "filepath", "upload_date", "row_count"]


def _orders(spark, sf):
    return orders_from_tpch(spark, sf)


def _lines(spark, sf):
    """Order lines without the columns that only ``part`` gives, unjoined."""
    return orders_from_tpch(spark, sf, part=False)


def _uploads(spark, sf):
    return uploads_from_events(spark, sf)


def _fmt_uploads(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format("upload_date", DISPLAY_TIMESTAMP).alias(c) if c == "upload_date" else c
                       for c in _UPLOAD_OUT])


def _scan_out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in _MONEY else F.col(c) for c in _ORDER_OUT])


# --- order scans -------------------------------------------------------------

def q_orders_scan(spark, sf):
    """All order lines of all sellers in the order-file schema."""
    return _scan_out(_orders(spark, sf))


def q_orders_union(spark, sf):
    """UNION ALL by name of two slices, the second without ``return_reason``."""
    o = _orders(spark, sf)
    returned = F.coalesce(F.col("order_status") == "returned", F.lit(False))
    u = union_orders([o.filter(returned), o.filter(~returned).drop("return_reason")])
    return _scan_out(u)


def export_orders_csv(spark, sf) -> str:
    """Write the test orders as CSV order files, one folder per seller
    (``seller_id=<n>/``); even sellers' files list the columns in file
    order, odd sellers' in reverse order.  Returns the folder."""
    import uuid

    from orderlens.session import checkpoint_path
    o = _orders(spark, sf)
    cols = [n for n, _ in ORDER_COLUMNS]
    root = checkpoint_path(spark, f"order-files-{uuid.uuid4().hex}")
    even = F.pmod(F.col("seller_id"), F.lit(2)) == 0
    for sub, cond, order in (("a", even, cols), ("b", ~even, list(reversed(cols)))):
        export_csv(o.filter(cond), f"{root}/{sub}", columns=order, partition_by="seller_id")
    return root


def q_orders_csv_kpis(spark, sf):
    """Seller KPIs of order files read back from CSV (columns matched by
    name per file; owner from the seller folder)."""
    from orderlens.operators.catalog import seller_from_path
    from orderlens.sources.csv_orders import read_orders_csv
    root = export_orders_csv(spark, sf)
    return kpis.seller_kpis(read_orders_csv(spark, [f"{root}/a", f"{root}/b"], per_file={"seller_id": seller_from_path("source_file")}, recursiveFileLookup=True, pathGlobFilter="*.csv"))


def q_stream_ingest_kpis(spark, sf):
    """Seller KPIs of the same order files picked up by the streaming
    folder ingest (each file once, catalog row per file), computed from the
    dashboard roll-up the ingest maintains next to the order table."""
    from orderlens.session import checkpoint_path
    from orderlens.streaming import ingest_folder
    root = export_orders_csv(spark, sf)
    out = checkpoint_path(spark, f"ingest-{os.path.basename(root)}")
    q = ingest_folder(spark, root, f"{out}/orders", f"{out}/catalog", checkpoint=f"{out}/ckpt",
                      pattern="*.csv", recursive=True, rollup_path=f"{out}/rollup")
    q.awaitTermination()
    return kpis.seller_kpis(spark.read.parquet(f"{out}/rollup"))


def q_orders_sink_month_kpis(spark, sf):
    """Month KPIs of the order table after storing it in the month-
    partitioned layout and reading it back."""
    import uuid

    from orderlens.session import checkpoint_path
    path = checkpoint_path(spark, f"order-table-{uuid.uuid4().hex}")
    write_orders(_lines(spark, sf), path, mode="overwrite")
    return months.month_kpis(spark.read.parquet(path))


def _scratch(spark, name: str) -> str:
    import uuid

    from orderlens.session import checkpoint_path
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def q_orders_csv_wide(spark, sf):
    """Seller KPIs of order files that another program might have written:
    an unnamed index column, 40 columns before the order columns, quoted texts
    with commas, doubled quotes and line breaks, Windows line ends."""
    from orderlens.operators.catalog import seller_from_path
    from orderlens.sources.csv_orders import read_orders_csv
    path = _scratch(spark, "order-files-wide")
    cells = [F.col("order_id").alias(""), *[F.lit(f"x{i}").alias(f"extra {i}") for i in range(40)], "order_id", "order_date", "order_price", "order_status", "return_cost",
             F.lit('5" pipe, steel\r\nsecond line').alias("sku_description")]
    files = _lines(spark, sf).select(*cells, "seller_id").hint("rebalance", "seller_id")
    files.write.partitionBy("seller_id").options(header=True, escape='"', lineSep="\r\n").csv(path)
    return kpis.seller_kpis(read_orders_csv(spark, path, per_file={"seller_id": seller_from_path("source_file")}, recursiveFileLookup=True, pathGlobFilter="*.csv"))


def q_file_row_counts(spark, sf):
    """Data rows of stored order files, counted per file and summed by seller."""
    from orderlens.operators.catalog import seller_from_path
    from orderlens.sources.csv_orders import file_row_counts
    root = export_orders_csv(spark, sf)
    counts = file_row_counts(spark, [f"{root}/a", f"{root}/b"], recursiveFileLookup=True, pathGlobFilter="*.csv")
    return counts.groupBy(seller_from_path("filepath").alias("seller_id")).agg(F.sum("row_count").alias("row_count"))


def _yearly_uploads(spark, sf):
    """The order lines as one upload per seller and calendar year."""
    return _lines(spark, sf).withColumn("upload_id", (F.col("seller_id") * 10000 + F.year("order_dt")).cast("bigint"))


def _stored_totals(o: DataFrame) -> DataFrame:
    return o.groupBy("seller_id", "upload_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("order_price").cast("double").alias("amount"))


def q_upload_replace(spark, sf):
    """All uploads stored, then those of 1995 uploaded again with only their
    returned lines: the others keep all theirs."""
    from orderlens.sources import order_table
    path, o = _scratch(spark, "order-table"), _yearly_uploads(spark, sf)
    order_table.store_uploads(o, path)
    again = o.filter(F.year("order_dt") == 1995)
    order_table.store_uploads(again.filter(F.col("order_status") == "returned"), path, again.select("seller_id", "upload_id"))
    return _stored_totals(order_table.read_orders(spark, path))


def q_orders_delete(spark, sf):
    """Stored order lines after the uploads of 1996 are deleted."""
    from orderlens.sources import order_table
    path, o = _scratch(spark, "order-table"), _yearly_uploads(spark, sf)
    order_table.store_uploads(o, path)
    order_table.delete_uploads(spark, path, o.filter(F.year("order_dt") == 1996).select("upload_id"))
    return _stored_totals(order_table.read_orders(spark, path))


def q_orders_purge(spark, sf):
    """Stored order lines after sellers with a negative balance are purged."""
    from orderlens.sources import order_table
    path, o = _scratch(spark, "order-table"), _yearly_uploads(spark, sf)
    order_table.store_uploads(o, path)
    order_table.purge_sellers(spark, path, sellers_from_supplier(spark, sf).filter(F.col("balance") < 0).select("seller_id"))
    return _stored_totals(order_table.read_orders(spark, path))


def q_sellers_purge(spark, sf):
    """The sellers that remain after those with a negative balance are purged."""
    s = sellers_from_supplier(spark, sf)
    (kept,) = catalog.purge_sellers(s.filter(F.col("balance") < 0), s.select("seller_id", "name", "store_name", "email"))
    return kept


def _reingested(spark, sf):
    """Two scans of one upload folder.  Between them the files of every third
    seller are replaced by files with only the returned lines, and those of every
    fifth seller removed."""
    from orderlens.streaming.ingest import scan_folder
    root, out = _scratch(spark, "upload-folder"), _scratch(spark, "ingest")
    cols, o = [n for n, _ in ORDER_COLUMNS], _orders(spark, sf)
    third, fifth = F.pmod(F.col("seller_id"), F.lit(3)) == 0, F.pmod(F.col("seller_id"), F.lit(5)) == 0
    write = lambda df, name: export_csv(df, f"{root}/{name}", columns=cols, partition_by="seller_id")
    scan = lambda: scan_folder(spark, root, f"{out}/orders", f"{out}/catalog", pattern="*.csv", recursive=True, drop_missing=True, checkpoint=f"{out}/ckpt")
    write(o.filter(~third & ~fifth), "kept")
    write(o.filter(third), "replaced")
    write(o.filter(~third & fifth), "removed")
    scan()
    write(o.filter(third & (F.col("order_status") == "returned")), "replaced")  # overwrites the folder
    write(o.limit(0), "removed")
    scan()
    return f"{out}/orders"


def q_reingest_kpis(spark, sf):
    """Seller KPIs of the order table after uploads were replaced and removed
    between two scans: once from its lines, once from its roll-up."""
    from orderlens.sources import order_table
    path = _reingested(spark, sf)
    taken = {"lines": order_table.read_orders(spark, path), "rollup": order_table.read_rollup(spark, path)}
    lines, rolled = (kpis.seller_kpis(df).withColumn("taken_from", F.lit(name)) for name, df in taken.items())
    return lines.unionByName(rolled)


def _upload_folder(spark, sf) -> str:
    """An upload folder with files of all kinds: order lines of every even seller,
    only a header for every fourth seller, bytes that are no text, and nothing."""
    root, o = _scratch(spark, "upload-folder"), _lines(spark, sf).select("seller_id", "order_id", "order_price")
    seller = lambda n, of: F.pmod(F.col("seller_id"), F.lit(n)) == of
    # a number of tasks is asked for: by size, all the small files would fall to one
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    o.filter(seller(2, 0)).repartition(tasks, "seller_id").write.partitionBy("seller_id").option("header", True).csv(f"{root}/orders")
    others = o.select("seller_id").distinct().filter(seller(2, 1))
    others.filter(seller(4, 1)).select("seller_id", F.lit("order_id,order_price").alias("value")).repartition(tasks, "seller_id").write.partitionBy("seller_id").text(f"{root}/header")
    others.filter(seller(4, 3)).select("seller_id", F.unhex(F.lit("6F726465725F69640AFFFE")).cast("string").alias("value")).repartition(tasks, "seller_id").write.partitionBy("seller_id").text(f"{root}/binary")
    spark.range(0).select(F.col("id").cast("string").alias("value")).write.text(f"{root}/empty/seller_id=0")
    return root


def q_files_listed(spark, sf):
    """The listing of an upload folder: files and empty files by seller."""
    from orderlens.operators.catalog import seller_from_path
    from orderlens.sources.files import list_files
    found = list_files(spark, _upload_folder(spark, sf), recursive=True)
    return found.groupBy(seller_from_path("filepath").alias("seller_id")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") == 0).alias("empty_files"))


def q_folder_scan_catalog(spark, sf):
    """The catalog after one scan of that folder: every file is registered once,
    those without lines, unreadable and empty ones with row_count 0."""
    from orderlens.streaming.ingest import read_catalog, scan_folder
    root, out = _upload_folder(spark, sf), _scratch(spark, "ingest")
    scan_folder(spark, root, f"{out}/orders", f"{out}/catalog", pattern="*", recursive=True, checkpoint=f"{out}/ckpt")
    return read_catalog(spark, f"{out}/catalog").groupBy("seller_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("filepath").alias("paths"), F.sum("row_count").alias("row_count"))


def q_orders_evolved(spark, sf):
    """An order table whose older version has no ``return_reason`` and no
    ``channel``: lines by the value of both, with a default for lines from before."""
    from orderlens.sources import order_table
    path, o = _scratch(spark, "order-table"), _yearly_uploads(spark, sf)
    old = F.year("order_dt") < 1996
    order_table.store_uploads(o.filter(old).drop("return_reason"), path)
    channel = F.when(F.col("order_status") == "returned", F.lit("shop"))
    order_table.store_uploads(o.filter(~old).withColumn("channel", channel), path)
    lines = order_table.read_orders(spark, path, defaults={"channel": "unknown"})
    return lines.groupBy("seller_id", "channel", "return_reason").agg(F.count(F.lit(1)).alias("lines"), F.sum("order_price").cast("double").alias("amount"))


# --- dashboard KPIs ----------------------------------------------------------

def q_seller_kpis(spark, sf):
    return kpis.seller_kpis(_lines(spark, sf))


def q_upload_kpis(spark, sf):
    """KPIs per file, the original's unit: scope (seller_id, upload_id), the
    test orders taken as one upload per seller and calendar year."""
    o = _lines(spark, sf).withColumn("upload_id", F.year("order_dt").cast("bigint"))
    return kpis.seller_kpis(o, ["seller_id", "upload_id"])


def q_kpi_missing_cols(spark, sf):
    """KPIs of files without ``order_status`` and ``return_cost`` columns."""
    return kpis.seller_kpis(_lines(spark, sf).drop("order_status", "return_cost"))


def q_order_validation(spark, sf):
    """Data-quality report per seller (dates, ids, prices, statuses,
    price = item price x quantity, absent columns)."""
    return validate_orders(_orders(spark, sf))


def q_kpi_json(spark, sf):
    """Result document per seller."""
    from orderlens.plans.dashboard import dashboard_json
    return dashboard_json(_orders(spark, sf))


def q_kpi_document(spark, sf):
    """The result document of every seller, parsed back into columns."""
    from orderlens.plans.dashboard import dashboard_json
    top = "array<struct<rnk:int,{0}:string,return_count:bigint>>"
    schema = ("total_orders bigint, total_returns bigint, return_percent double, net_sales double, return_cost double, net_profit double, "
              f"return_reasons map<string,bigint>, top_catalogues {top.format('catalogue_id')}, top_skus {top.format('sku_description')}")
    d = dashboard_json(_orders(spark, sf)).select("seller_id", F.from_json("json", schema).alias("d")).select("seller_id", "d.*")
    pairs = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x["return_count"].cast("string"))), ";")
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("return_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return d.select("seller_id", "total_orders", "total_returns", "return_percent", "net_sales", "return_cost", "net_profit", reasons.alias("reasons"),
                    pairs("top_catalogues", "catalogue_id").alias("catalogues"), pairs("top_skus", "sku_description").alias("skus"))


def q_kpi_document_chunks(spark, sf):
    """Entries of the chunked documents, chunk by chunk (two reasons a chunk)."""
    c = kpis.kpi_json_chunks(_orders(spark, sf), entries=2).filter("section = 'return_reasons'")
    entries = F.from_json("json", "array<struct<return_reason:string,cnt:bigint>>")
    listed = F.array_join(F.transform(entries, lambda e: F.concat(e["return_reason"], F.lit("="), e["cnt"].cast("string"))), ";")
    return c.select("seller_id", F.col("chunk").cast("int").alias("chunk"), listed.alias("entries"))


def q_daily_sales(spark, sf):
    return kpis.daily_sales(_lines(spark, sf))


def q_return_reasons(spark, sf):
    return kpis.return_reasons(_lines(spark, sf))


def q_top_returned_catalogues(spark, sf):
    return kpis.top_returned_catalogues(_lines(spark, sf))


def q_top_returned_skus(spark, sf):
    return kpis.top_returned_skus(_orders(spark, sf))


# --- categories --------------------------------------------------------------

def _part_dim(spark, sf):
    """A catalogue dictionary of all parts."""
    part = spark.read.parquet(f"{sf.rstrip('/')}/part.parquet")
    return part.select(F.col("p_partkey").alias("catalogue_id"), F.col("p_type").alias("category"))


def q_category_mapped(spark, sf):
    """Categories by dictionary; cancelled lines have a catalogue id that no
    dictionary knows, so the 'Category <id>' fallback runs too."""
    unknown = F.when(F.col("order_status") == "cancelled", F.col("catalogue_id") + 1_000_000_000).otherwise(F.col("catalogue_id"))
    return category.category_mapped(_lines(spark, sf).withColumn("catalogue_id", unknown), _part_dim(spark, sf))


def _scorecard(spark, sf):
    return category.category_scorecard(_orders(spark, sf))


def q_category_scorecard(spark, sf):
    return _scorecard(spark, sf)


def q_top_categories_by_revenue(spark, sf):
    return category.top_categories(_scorecard(spark, sf), "revenue").select(
        "seller_id", "name", "revenue", "orders", "rnk")


def q_top_categories_by_orders(spark, sf):
    return category.top_categories(_scorecard(spark, sf), "orders").select(
        "seller_id", "name", "revenue", "orders", "rnk")


def q_category_insights(spark, sf):
    return category.category_insights(_scorecard(spark, sf)).select(
        "seller_id", "name", "severity", "rule", "metric", "message")


def q_category_recommendations(spark, sf):
    return category.category_recommendations(_scorecard(spark, sf)).select("seller_id", "rule", "name", "message")


def q_category_actions(spark, sf):
    return category.category_actions(_scorecard(spark, sf))


# --- SKUs --------------------------------------------------------------------

def q_sku_ranking(spark, sf):
    return sku.sku_ranking(_orders(spark, sf))


def q_sku_ranking_join(spark, sf):
    return sku.sku_ranking_join(_orders(spark, sf))


def q_sku_buckets(spark, sf):
    return sku.sku_buckets(_orders(spark, sf))


def q_sku_detail(spark, sf):
    """Detail of every (seller, SKU) sold plus the upper-cased text of each,
    which never matches (case-sensitive) and so yields zero records."""
    o = _orders(spark, sf)
    sold = o.select("seller_id", F.col("sku_description").alias("sku")).filter(F.col("sku").isNotNull())
    requests = sold.union(sold.select("seller_id", F.upper("sku").alias("sku"))).distinct()
    # the requests cover every SKU sold, so filtering the orders first saves nothing
    return sku.sku_detail(o, requests, prefilter=False)


def q_sku_detail_one(spark, sf):
    """One SKU of each seller (the first by text), the orders filtered by the
    requests before they are aggregated."""
    o = _orders(spark, sf)
    requests = o.groupBy("seller_id").agg(F.min("sku_description").alias("sku"))
    return sku.sku_detail(o, requests, prefilter=True)


def q_sku_page_kpis(spark, sf):
    return sku.sku_page_kpis(_orders(spark, sf))


# --- dates and months --------------------------------------------------------

def q_date_parse(spark, sf):
    """Parse every order date text in eight spellings derived from it
    (valid and invalid ones)."""
    from orderlens.functions import parse_dmy
    d = F.col("order_date")
    variants = F.array(
        d,
        F.regexp_replace(d, r"(^|-)0", "$1"),
        F.concat(F.substring(d, 1, 6), F.substring(d, 9, 2)),
        F.concat_ws("-", F.substring(d, 7, 4), F.substring(d, 4, 2), F.substring(d, 1, 2)),
        F.regexp_replace(d, "-", "/"),
        F.concat(d, F.lit(" ")),
        F.concat(F.lit("0"), d),
        F.concat(F.lit("31"), F.substring(d, 3, 8)),
    )
    dates = _lines(spark, sf).select("order_date").distinct()
    raw = dates.select(F.explode(variants).alias("raw")).distinct()
    return raw.select("raw", parse_dmy("raw").alias("order_dt"))


def q_month_daily_revenue(spark, sf):
    return months.month_daily_revenue(_lines(spark, sf))


def q_month_kpis(spark, sf):
    return months.month_kpis(_lines(spark, sf))


def q_month_return_reasons(spark, sf):
    return months.month_return_reasons(_lines(spark, sf))


def q_month_comparison(spark, sf):
    """Month-over-month comparison for every month touching a data month."""
    return months.month_over_month(_lines(spark, sf))


def q_month_pair(spark, sf):
    """Two chosen months side by side; only they are scanned."""
    return months.month_comparison(_lines(spark, sf), *CHOSEN_MONTHS)


def q_month_pair_absent(spark, sf):
    """A chosen month with data against one without any."""
    return months.month_comparison(_lines(spark, sf), CHOSEN_MONTHS[0], (1970, 1))


def q_available_years(spark, sf):
    return months.available_years(_lines(spark, sf))


# --- upload catalog ----------------------------------------------------------

def _listing(spark, sf):
    """Files present in the upload folder: those of uploads that did not fail."""
    ev = _uploads(spark, sf)
    return ev.filter(F.col("event_type") != "error").select("filename", "filepath").distinct()


def q_uploads_list(spark, sf):
    return catalog.uploads_list(_uploads(spark, sf))


def q_uploads_by_date(spark, sf):
    return catalog.uploads_by_date(_uploads(spark, sf))


def q_latest_upload(spark, sf):
    return _fmt_uploads(catalog.latest_upload(_uploads(spark, sf)))


def q_upload_lookup(spark, sf):
    """Every upload asked for by its owner, and every 'click' upload asked
    for by the next seller id (refused: not the owner)."""
    ev = _uploads(spark, sf)
    req = ev.select("seller_id", "upload_id").union(
        ev.filter(F.col("event_type") == "click").select((F.col("seller_id") + 1).alias("seller_id"), "upload_id"))
    return _fmt_uploads(catalog.upload_lookup(ev, req))


def q_upload_discovery(spark, sf):
    """Folder files (all upload names) not in the catalog as of the cutoff."""
    ev = _uploads(spark, sf)
    listing = ev.select("filename", "filepath").distinct()
    known = ev.filter(F.col("upload_date") < F.lit(CATALOG_CUTOFF).cast("timestamp"))
    return catalog.discover_uploads(listing, known).select("filename", "filepath")


def _rows_per_file(ev: DataFrame) -> DataFrame:
    """Data lines of each file: its non-'signup' events."""
    return ev.filter(F.col("event_type") != "signup").select("filepath")


def q_upload_row_counts(spark, sf):
    ev = _uploads(spark, sf)
    return catalog.upload_row_counts(ev.select("filepath").distinct(), _rows_per_file(ev))


def q_upload_register(spark, sf):
    ev = _uploads(spark, sf)
    listing = ev.select("filename", "filepath").distinct()
    known = ev.filter(F.col("upload_date") < F.lit(CATALOG_CUTOFF).cast("timestamp"))
    new = catalog.discover_uploads(listing, known)
    counts = catalog.upload_row_counts(new.select("filepath"), _rows_per_file(ev))
    reg = catalog.register_uploads(new.join(counts, "filepath", "left"))
    return reg.select("seller_id", "filename", "original_name", "filepath", "row_count", catalog.stored_name("seller_id", "original_name").alias("stored_name"))


def q_uploads_existing(spark, sf):
    return _fmt_uploads(catalog.existing_uploads(_uploads(spark, sf), _listing(spark, sf)))


def q_latest_existing_upload(spark, sf):
    return _fmt_uploads(catalog.latest_existing_upload(_uploads(spark, sf), _listing(spark, sf)))


def _selection_requests(ev: DataFrame) -> DataFrame:
    """One request per seller, by seller id mod 4: an own 'click' upload;
    the id after the seller's newest (usually someone else's); the path of
    the seller's first upload as remembered selection; nothing."""
    per = ev.groupBy("seller_id").agg(
        F.max(F.when(F.col("event_type") == "click", F.col("upload_id"))).alias("own_click"),
        F.max("upload_id").alias("max_id"),
        F.min_by("filepath", F.struct("upload_date", "upload_id")).alias("first_path"))
    kind = F.pmod(F.col("seller_id"), F.lit(4))
    return per.select(
        "seller_id",
        F.when(kind == 0, F.col("own_click")).when(kind == 1, F.col("max_id") + 1).alias("upload_id"),
        F.when(kind == 2, F.col("first_path")).alias("sticky_path"))


def q_upload_selection(spark, sf):
    ev = _uploads(spark, sf)
    return catalog.select_uploads(_selection_requests(ev), ev, _listing(spark, sf))


def q_upload_delete(spark, sf):
    """Delete every upload whose event is an 'error'."""
    ev = _uploads(spark, sf)
    return _fmt_uploads(catalog.delete_uploads(ev, ev.filter(F.col("event_type") == "error")))


def q_seller_purge(spark, sf):
    """Purge sellers with a negative balance: their uploads disappear."""
    ev = _uploads(spark, sf)
    sellers = sellers_from_supplier(spark, sf)
    (kept,) = catalog.purge_sellers(sellers.filter(F.col("balance") < 0), ev)
    return _fmt_uploads(kept)


def q_seller_upsert(spark, sf):
    """Sellers of even nations rename their store (other fields kept);
    sellers of nation 0 also register a second account (insert)."""
    s = sellers_from_supplier(spark, sf)
    cur = s.select("seller_id", "name", "store_name", "email")
    upd = s.filter(F.pmod(F.col("nation_id"), F.lit(2)) == 0).select(
        "seller_id", F.upper("store_name").alias("store_name"))
    ins = s.filter(F.col("nation_id") == 0).select(
        (F.col("seller_id") + 1000000).alias("seller_id"), "name", "store_name", "email")
    return catalog.upsert_by_key(cur, upd.unionByName(ins, allowMissingColumns=True))


def q_seller_upsert_last(spark, sf):
    """Every upload event renames its seller's store ('signup' events leave the
    name alone, 'purchase' events give an address): one row a seller, each column
    with the value given last."""
    s = sellers_from_supplier(spark, sf).select("seller_id", "name", "store_name", "email")
    ev = _uploads(spark, sf)
    store = F.when(F.col("event_type") != "signup", F.concat(F.lit("Store "), F.col("upload_id").cast("string")))
    email = F.when(F.col("event_type") == "purchase", F.concat(F.col("upload_id").cast("string"), F.lit("@example.com")))
    upd = ev.select("seller_id", store.alias("store_name"), email.alias("email"), F.struct("upload_date", "upload_id").alias("given"))
    return catalog.upsert_by_key(s, upd, order="given")


def q_register_unique(spark, sf):
    """Every upload event asks to register an account under an address ('error'
    events: none): refused where a seller or an earlier request has it."""
    s, ev = sellers_from_supplier(spark, sf), _uploads(spark, sf)
    address = F.concat(F.lit("supplier"), F.lpad(F.pmod("upload_id", F.lit(5000)).cast("string"), 9, "0"), F.lit("@example.com"))
    new = ev.select("upload_id", "upload_date", F.when(F.col("event_type") != "error", address).alias("email"))
    return catalog.check_unique(new, s, ["email"], "upload_id", order="upload_date").select("upload_id", "email", "reason")


def q_schema_evolve(spark, sf):
    s = sellers_from_supplier(spark, sf).select("seller_id", "name", "email")
    return catalog.evolve_schema(s, [
        ("store_name", "string", ""),
        ("unique_code", "string", None),
        ("profile_icon", "string", DEFAULT_PROFILE_ICON),
        ("profile_photo", "string", None),
    ])


def q_unique_violations(spark, sf):
    return catalog.unique_violations(_uploads(spark, sf), "filename")


QUERIES: dict[str, Query] = {
    "orders_scan": q_orders_scan,
    "orders_union": q_orders_union,
    "seller_kpis": q_seller_kpis,
    "orders_csv_kpis": q_orders_csv_kpis,
    "stream_ingest_kpis": q_stream_ingest_kpis,
    "orders_sink_month_kpis": q_orders_sink_month_kpis,
    "orders_csv_wide": q_orders_csv_wide,
    "file_row_counts": q_file_row_counts,
    "reingest_kpis": q_reingest_kpis,
    "files_listed": q_files_listed,
    "folder_scan_catalog": q_folder_scan_catalog,
    "orders_evolved": q_orders_evolved,
    "upload_replace": q_upload_replace,
    "orders_delete": q_orders_delete,
    "orders_purge": q_orders_purge,
    "sellers_purge": q_sellers_purge,
    "upload_kpis": q_upload_kpis,
    "kpi_missing_cols": q_kpi_missing_cols,
    "order_validation": q_order_validation,
    "kpi_json": q_kpi_json,
    "kpi_document": q_kpi_document,
    "kpi_document_chunks": q_kpi_document_chunks,
    "daily_sales": q_daily_sales,
    "return_reasons": q_return_reasons,
    "top_returned_catalogues": q_top_returned_catalogues,
    "top_returned_skus": q_top_returned_skus,
    "category_mapped": q_category_mapped,
    "category_scorecard": q_category_scorecard,
    "top_categories_by_revenue": q_top_categories_by_revenue,
    "top_categories_by_orders": q_top_categories_by_orders,
    "category_insights": q_category_insights,
    "category_recommendations": q_category_recommendations,
    "category_actions": q_category_actions,
    "sku_ranking": q_sku_ranking,
    "sku_ranking_join": q_sku_ranking_join,
    "sku_buckets": q_sku_buckets,
    "sku_detail": q_sku_detail,
    "sku_detail_one": q_sku_detail_one,
    "sku_page_kpis": q_sku_page_kpis,
    "date_parse": q_date_parse,
    "month_daily_revenue": q_month_daily_revenue,
    "month_kpis": q_month_kpis,
    "month_return_reasons": q_month_return_reasons,
    "month_comparison": q_month_comparison,
    "month_pair": q_month_pair,
    "month_pair_absent": q_month_pair_absent,
    "available_years": q_available_years,
    "uploads_list": q_uploads_list,
    "uploads_by_date": q_uploads_by_date,
    "latest_upload": q_latest_upload,
    "upload_lookup": q_upload_lookup,
    "upload_discovery": q_upload_discovery,
    "upload_row_counts": q_upload_row_counts,
    "upload_register": q_upload_register,
    "uploads_existing": q_uploads_existing,
    "latest_existing_upload": q_latest_existing_upload,
    "upload_selection": q_upload_selection,
    "upload_delete": q_upload_delete,
    "seller_purge": q_seller_purge,
    "seller_upsert": q_seller_upsert,
    "seller_upsert_last": q_seller_upsert_last,
    "register_unique": q_register_unique,
    "schema_evolve": q_schema_evolve,
    "unique_violations": q_unique_violations,
}
