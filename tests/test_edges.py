
import os

import pytest
from pyspark.sql import functions as F

from conftest import write_csv
from orderlens.operators import catalog, category, kpis, months, sku
from orderlens.sources import file_row_counts, read_orders_csv, union_orders

HEADER = ("order_id,order_date,catalogue_id,sku_description,item_price,quantity,order_price,"
          "order_status,return_type,return_cost,return_reason\n")


def test_null_keys_and_counts(spark, tmp_dir):
    p = write_csv(tmp_dir, "1_a_2025.csv", HEADER +
                  ",01-01-2025,1,SKU A,10,1,10,returned,customer,2,Size issue\n"
                  "2,01-01-2025,1,SKU A,10,1,,delivered,,0,\n"
                  "3,02-01-2025,,,10,1,,returned,rto,0,\n"
                  "4,,2,SKU B,10,1,5,delivered,,0,\n")
    o = read_orders_csv(spark, p)
    k = kpis.seller_kpis(o, ()).first()
    # S1: rows count null ids; S3/S4: sums skip nulls
    assert (k.total_orders, k.total_returns, k.net_sales, k.return_cost) == (4, 2, 15.0, 2.0)
    d = {r.order_date: r for r in kpis.daily_sales(o, ()).collect()}
    assert set(d) == {"01-01-2025", "02-01-2025"}          # S5: null date dropped
    assert (d["01-01-2025"].total_amount, d["01-01-2025"].order_count) == (10.0, 1)
    assert (d["02-01-2025"].total_amount, d["02-01-2025"].order_count) == (0.0, 0)  # all-null day
    cats = kpis.top_returned_catalogues(o, ()).collect()
    assert [(r.catalogue_id, r.return_count) for r in cats] == [("1", 0)]  # count of non-null ids
    reasons = kpis.return_reasons(o, ()).collect()
    assert [(r.return_reason, r.cnt) for r in reasons] == [("Size issue", 1)]


def test_null_tokens_and_column_order(spark, tmp_dir):
    p1 = write_csv(tmp_dir, "1_a_2025.csv", HEADER +
                   "1,01-01-2025,1,SKU A,10,1,10,returned,NA,5,None\n"
                   "2,01-01-2025,1,SKU A,10,1,10,returned,n/a,5,null\n")
    # other column order, no return_cost / return_reason columns
    p2 = write_csv(tmp_dir, "1_b_2025.csv",
                   "order_status,order_price,sku_description,order_id,order_date\n"
                   "returned,7,SKU B,3,03-01-2025\n")
    o = read_orders_csv(spark, [p1, p2])
    rows = {r.order_id: r for r in o.collect()}
    assert rows[1].return_type is None and rows[1].return_reason is None and rows[2].return_reason is None
    assert rows[3].order_price == 7 and rows[3].sku_description == "SKU B" and rows[3].return_cost is None
    assert set(rows[3]["_absent"]) >= {"return_cost", "return_reason", "catalogue_id"}
    assert kpis.return_reasons(o, ()).count() == 0


def test_absent_columns_defaults(spark, tmp_dir):
    p = write_csv(tmp_dir, "1_a_2025.csv",
                  "order_id,order_date,sku_description,order_price\n1,01-01-2025,SKU A,100\n2,01-01-2025,SKU A,50\n")
    o = read_orders_csv(spark, p)
    k = kpis.seller_kpis(o, ()).first()
    assert (k.total_returns, k.return_percent, k.return_cost, k.net_profit) == (0, 0.0, 0.0, 150.0)
    r = sku.sku_ranking(o, ()).first()
    assert (r.profit_margin, r.return_rate) == (35.0, 5.0)  # S10 defaults for absent columns
    # present but empty return_cost column: computed margin, not the default
    p2 = write_csv(tmp_dir, "1_b_2025.csv",
                   "order_id,sku_description,order_price,return_cost,order_status\n1,SKU A,100,,delivered\n")
    r2 = sku.sku_ranking(read_orders_csv(spark, p2), ()).first()
    assert (r2.profit_margin, r2.return_rate) == (100.0, 0.0)


def test_zero_revenue_and_division(spark, tmp_dir):
    p = write_csv(tmp_dir, "1_a_2025.csv", HEADER +
                  "1,01-01-2025,1,SKU Z,0,1,0,delivered,,0,\n"
                  "2,01-01-2025,2,SKU Y,10,1,10,returned,customer,1,Size issue\n")
    o = read_orders_csv(spark, p)   # no category column: ids 1, 2 are not in the dictionary
    sc = {r.name: r for r in category.category_scorecard(o, ()).collect()}
    assert sc["Category 1"].profit_margin == 0.0          # guarded margin
    assert sc["Category 2"].return_rate == 100.0
    r = {x.sku: x for x in sku.sku_ranking(o, ()).collect()}
    assert r["SKU Z"].profit_margin is None           # unguarded in the original: NULL, not an error


def test_ties_at_k(spark):
    df = spark.createDataFrame(
        [(1, f"S{i:02d}", 100 - (i // 2)) for i in range(12)],
        "seller_id long, sku_description string, order_price int")
    df = df.withColumn("order_id", F.lit(1).cast("long")).withColumn("order_price", F.col("order_price").cast("decimal(18,2)"))
    top = sku.sku_ranking(df).orderBy("rnk").collect()
    assert [r.sku for r in top] == [f"S{i:02d}" for i in range(10)]  # tie at 10/11 broken by text
    df2 = df.withColumn("order_status", F.lit("returned"))
    t5 = kpis.top_returned_skus(df2).orderBy("rnk").collect()
    assert [r.sku_description for r in t5] == ["S00", "S01", "S02", "S03", "S04"]


def test_header_only_file_row_count(spark, tmp_dir):
    p1 = write_csv(tmp_dir, "1_a_2025.csv", HEADER)
    p2 = write_csv(tmp_dir, "1_b_2025.csv", HEADER + "1,01-01-2025,1,A,1,1,1,delivered,,0,\n")
    got = {os.path.basename(r.filepath): r.row_count for r in file_row_counts(spark, [p1, p2]).collect()}
    assert got == {"1_a_2025.csv": 0, "1_b_2025.csv": 1}
    assert read_orders_csv(spark, p1).count() == 0


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "order_id long, return_reason string")
    b = spark.createDataFrame([(2,)], "order_id long")
    u = {r.order_id: r for r in union_orders([a, b]).collect()}
    assert u[2].return_reason is None and "return_reason" in u[2]["_absent"]
    assert "return_reason" not in u[1]["_absent"]


def test_bad_dates_dropped_from_months(spark):
    df = spark.createDataFrame(
        [("01-01-2025", 10), ("31-02-2025", 20), ("2025-01-01", 30), ("1-1-2025", 40), (None, 50)],
        "order_date string, order_price int").withColumn("order_price", F.col("order_price").cast("decimal(18,2)"))
    m = months.month_kpis(df, ()).collect()
    assert [(r.year, r.month, r.total_orders, r.total_revenue) for r in m] == [(2025, 1, 2, 50.0)]


def test_available_years_fallback(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "01-01-2024")], "seller_id long, order_date string")
    got = sorted((r.seller_id, r.year) for r in months.available_years(df).collect())
    assert got == [(1, 2024), (1, 2025), (1, 2026), (2, 2024)]


def test_catalog_operations(spark):
    from datetime import datetime

    from orderlens.schema import UPLOAD_SCHEMA
    up = spark.createDataFrame([
        (1, 7, "7_a_1.csv", "a.csv", "/u/7_a_1.csv", datetime(2025, 1, 1), 3),
        (2, 7, "7_b_2.csv", "b.csv", "/u/7_b_2.csv", datetime(2025, 1, 2), 4),
        (3, 7, "7_b_2.csv", "b.csv", "/u/7_b_2.csv", datetime(2025, 1, 3), 4),   # re-upload, same name
        (4, 8, "8_c_3.csv", "c.csv", "/u/8_c_3.csv", datetime(2025, 1, 1), 1),
    ], UPLOAD_SCHEMA)
    listing = spark.createDataFrame([("/u/7_a_1.csv",), ("/u/8_c_3.csv",), ("/u/9_new_5.csv",), ("/u/notes.txt",)],
                                    "filepath string")
    lat = {r.seller_id: r.upload_id for r in catalog.latest_upload(up).collect()}
    assert lat == {7: 3, 8: 4}
    late = {r.seller_id: r.upload_id for r in catalog.latest_existing_upload(up, listing).collect()}
    assert late == {7: 1, 8: 4}
    pos = {r.upload_id: r.position for r in catalog.uploads_list(up).collect()}
    assert pos == {3: 0, 2: 1, 1: 2, 4: 0}
    assert [r.filename for r in catalog.discover_uploads(listing, up).collect()] == ["9_new_5.csv"]
    assert catalog.dedupe_uploads(up).count() == 3
    assert [(r.filename, r.n) for r in catalog.unique_violations(up, "filename").collect()] == [("7_b_2.csv", 2)]
    req = spark.createDataFrame([(7, 4, None), (7, 1, None), (7, None, "/u/7_a_1.csv"), (8, None, "/u/gone.csv")],
                                "seller_id long, upload_id long, sticky_path string")
    sel = {(r.seller_id, r.req_id, r.sticky_path): (r.source, r.upload_id) for r in
           catalog.select_uploads(req, up, listing).collect()}
    assert sel[(7, 4, None)] == (None, None)           # not the seller's upload
    assert sel[(7, 1, None)] == ("explicit", 1)
    assert sel[(7, None, "/u/7_a_1.csv")] == ("sticky", 1)
    assert sel[(8, None, "/u/gone.csv")] == ("latest", 4)
    new = catalog.register_uploads(spark.createDataFrame([("9_new_5.csv", "/u/9_new_5.csv", 12)],
                                                         "filename string, filepath string, row_count long"))
    r = new.first()
    assert r.seller_id == 9 and r.row_count == 12 and r.upload_id >= 0
    assert new.first().upload_id == r.upload_id          # deterministic id
    kept = catalog.delete_uploads(up, spark.createDataFrame([(2,), (3,)], "upload_id long"))
    assert sorted(x.upload_id for x in kept.collect()) == [1, 4]


def test_upsert_and_evolve(spark):
    cur = spark.createDataFrame([(1, "A", "Store A", "a@x"), (2, "B", "Store B", "b@x")],
                                "seller_id long, name string, store_name string, email string")
    upd = spark.createDataFrame([(2, None, "New B"), (3, "C", "Store C")],
                                "seller_id long, name string, store_name string")
    got = {r.seller_id: (r.name, r.store_name, r.email) for r in catalog.upsert_by_key(cur, upd).collect()}
    assert got == {1: ("A", "Store A", "a@x"), 2: ("B", "New B", "b@x"), 3: ("C", "Store C", None)}
    ev = catalog.evolve_schema(cur.drop("store_name"), [("store_name", "string", ""),
                                                        ("profile_icon", "string", "fa-user")])
    r = ev.first()
    assert r.store_name == "" and r.profile_icon == "fa-user"


def test_partition_count_independent(spark, sample_orders):
    a = sorted(kpis.seller_kpis(sample_orders.repartition(1), ["upload_id"]).collect())
    b = sorted(kpis.seller_kpis(sample_orders.repartition(7), ["upload_id"]).collect())
    assert a == b


def test_daily_sum_equals_sales(sample_orders):
    d = kpis.daily_sales(sample_orders, ["upload_id"]).groupBy("upload_id").agg(F.sum("total_amount").alias("s"))
    k = kpis.seller_kpis(sample_orders, ["upload_id"])
    assert d.join(k, "upload_id").filter(F.col("s") != F.col("net_sales")).count() == 0


@pytest.mark.parametrize("scope", [(), ("seller_id",), ("seller_id", "upload_id")])
def test_scopes_run(sample_orders, scope):
    assert category.category_scorecard(sample_orders, scope).count() > 0
    assert kpis.kpi_json(sample_orders, scope).count() >= 1


def test_validation_report(spark, tmp_dir):
    from orderlens.operators.quality import validate_orders
    p1 = write_csv(tmp_dir, "1_a_2025.csv", HEADER +
                   ",01-01-2025,1,A,10,2,20,delivered,,0,\n"
                   "2,2025-01-01,1,A,10,2,25,shipped,,0,\n"
                   "3,02-01-2025,1,A,10,2,,returned,customer,1,Size issue\n")
    p2 = write_csv(tmp_dir, "1_b_2025.csv", "order_id,order_date,order_price\n4,03-01-2025,5\n")
    o = read_orders_csv(spark, [p1, p2])
    r = validate_orders(o, ()).first()
    assert (r.lines, r.bad_dates, r.missing_order_ids, r.missing_prices, r.unknown_statuses, r.price_mismatches) \
        == (4, 1, 1, 1, 1, 1)
    assert r.absent_columns.split(",") == sorted({"catalogue_id", "sku_description", "item_price", "quantity",
                                                   "order_status", "return_type", "return_cost", "return_reason",
                                                   "category"})


def test_same_file_twice_counted_once(spark, tmp_dir):
    from datetime import datetime

    from orderlens.schema import UPLOAD_SCHEMA
    p = write_csv(tmp_dir, "1_a_2025.csv", HEADER + "1,01-01-2025,1,A,10,1,10,delivered,,0,\n")
    up = spark.createDataFrame([(1, 1, "1_a_2025.csv", "a.csv", p, datetime(2025, 1, 1), 1),
                                (2, 1, "1_a_2025.csv", "a.csv", p, datetime(2025, 1, 2), 1)], UPLOAD_SCHEMA)
    o = read_orders_csv(spark, [p, p], uploads=up)
    rows = o.collect()
    assert len(rows) == 1 and rows[0].upload_id == 2   # newest registration of the path
