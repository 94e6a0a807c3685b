"""Order files that other programs write, the folder ingest over several runs,
and the order table whose uploads are replaced, deleted and purged."""

import csv
import io
import os
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import write_csv
from orderlens.operators import catalog, kpis
from orderlens.operators.quality import validate_orders
from orderlens.plans.dashboard import rollup
from orderlens.sources import export_csv, file_row_counts, list_files, order_table, read_orders_csv
from orderlens.sources.csv_orders import file_report
from orderlens.streaming.ingest import ingest_changed, read_catalog, scan_folder


def test_unnamed_index_column_keeps_its_place(spark, tmp_dir):
    p = write_csv(tmp_dir, "1_a_1.csv", ",order_id,order_date,order_price,order_status\n0,7,01-01-2025,500,returned\n")
    r = read_orders_csv(spark, p).first()
    assert (r.order_id, r.order_date, float(r.order_price), r.order_status) == (7, "01-01-2025", 500.0, "returned")


def test_any_number_of_columns(spark, tmp_dir):
    head = ",".join(f"x{i}" for i in range(60))
    p = write_csv(tmp_dir, "1_a_1.csv", f"{head},order_price,order_status\n{head},500,returned\n")
    k = kpis.seller_kpis(read_orders_csv(spark, p), ()).first()
    assert (k.net_sales, k.total_returns) == (500.0, 1)


def test_quotes_and_line_breaks(spark, tmp_dir):
    p = write_csv(tmp_dir, "1_a_1.csv", 'order_id,sku_description,order_price\r\n1,"5"" pipe, steel",10\r\n2,"two\r\nlines",20\r\n\r\n3,plain 5" pipe,30\r\n')
    rows = {r.order_id: (r.sku_description, int(r.order_price)) for r in read_orders_csv(spark, p).collect()}
    assert rows == {1: ('5" pipe, steel', 10), 2: ("two\r\nlines", 20), 3: ('plain 5" pipe', 30)}
    assert file_row_counts(spark, p).first().row_count == 3


def test_prices_keep_their_digits(spark, tmp_dir):
    p = write_csv(tmp_dir, "1_a_1.csv", "order_id,order_price\n1,10.005\n2,10.005\n")
    assert kpis.seller_kpis(read_orders_csv(spark, p), ()).first().net_sales == 20.01


def test_export_is_standard_csv(spark, tmp_dir):
    df = spark.createDataFrame([(1, '5" pipe, steel'), (2, "a\\b")], "order_id long, sku_description string")
    export_csv(df.coalesce(1), os.path.join(tmp_dir, "out"))
    (f,) = [x for x in os.listdir(os.path.join(tmp_dir, "out")) if x.endswith(".csv")]
    with open(os.path.join(tmp_dir, "out", f), newline="") as h:
        assert list(csv.reader(h)) == [["order_id", "sku_description"], ["1", '5" pipe, steel'], ["2", "a\\b"]]


def test_line_mode_gives_the_same_rows(spark, tmp_dir):
    a = write_csv(tmp_dir, "1_a_1.csv", "order_id,order_price\n1,10\n\n2,20\n")
    b = write_csv(tmp_dir, "1_b_2.csv", '\ufefforder_price,,order_id\r\n"30",x,3\r\n')
    whole, lines = (sorted((r.order_id, int(r.order_price)) for r in read_orders_csv(spark, [a, b], multi_line=m).collect()) for m in (True, False))
    assert whole == lines == [(1, 10), (2, 20), (3, 30)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab",\n\r é', max_size=6), min_size=3, max_size=3), min_size=1, max_size=4), st.sampled_from(["\n", "\r\n"]))
def test_records_as_the_csv_module_reads_them(spark, tmp_dir, rows, end):
    header = ["x", "order_status", "return_type", "y"]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([header, *[["z", *r] for r in rows]])
    p = write_csv(tmp_dir, "1_a_1.csv", out.getvalue())
    got = [(r.order_status, r.return_type) for r in read_orders_csv(spark, p).collect()]
    assert got == [(r[1] or None, r[2] or None) for r in csv.reader(io.StringIO(out.getvalue(), newline=""))][1:]
    assert file_row_counts(spark, p).first().row_count == len(rows)


def test_rows_are_read_by_spark_without_a_shuffle(spark, tmp_dir):
    """One CSV scan of the wanted places only; the table of files is broadcast."""
    p = write_csv(tmp_dir, "1_a_1.csv", ",".join(f"x{i}" for i in range(50)) + ",order_id\n" + "1," * 50 + "7\n")
    plan = read_orders_csv(spark, p).select("order_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "FileScan text" not in plan and "Exchange hash" not in plan and "Python" not in plan
    assert "ReadSchema: struct<c50:string>" in plan


def test_headers_of_many_shapes(spark, tmp_dir, monkeypatch):
    """Quoted names, names with commas and line breaks, mixed line ends, blank
    first lines, and a wanted column in more places than are told apart by CASE."""
    from orderlens.sources import csv_orders
    texts = ['"order_id","a,b",order_price\n1,x,10\n', '"a\nb",order_price,order_id\nx,20,2\n', "order_id,order_status\r\n3,returned\n\r\n4,returned\r\n", "order_id,order_status\n5,returned\r\n",
             "\n\norder_id\n6\n", 'order_id,"x ""y"", z",order_status\n7,"q\r\nr",returned\n', "\ufefforder_id\r\n8\r\n"]
    texts += [f"{'x,' * i}order_id\n{'0,' * i}{9 + i}\n" for i in range(6)]
    paths = [write_csv(tmp_dir, f"1_{i}_1.csv", t) for i, t in enumerate(texts)]
    want = {1: ("10", None), 2: ("20", None), **{i: (None, "returned") for i in (3, 4, 5, 7)}, **{i: (None, None) for i in (6, 8, *range(9, 15))}}
    get = lambda: {r.order_id: (r.order_price and str(int(r.order_price)), r.order_status) for r in read_orders_csv(spark, paths).collect()}
    assert get() == want
    monkeypatch.setattr(csv_orders, "MOST_PLACES", 2)
    monkeypatch.setattr(csv_orders, "BROADCAST_FILES", 3)
    assert get() == want


def test_files_that_are_not_text_or_gone(spark, tmp_dir):
    good = write_csv(tmp_dir, "1_a_1.csv", "order_id\n1\n")
    with open(os.path.join(tmp_dir, "1_b_2.csv"), "wb") as f:
        f.write(b"order_id\n2\n\xff\n")
    write_csv(tmp_dir, "1_c_3.csv", "order_id\n")
    for multi in (True, False):
        assert [r.order_id for r in read_orders_csv(spark, tmp_dir, multi_line=multi).collect()] == [1]
        assert {os.path.basename(r.filepath): r.row_count for r in file_row_counts(spark, tmp_dir, multi_line=multi).collect()} == {"1_a_1.csv": 1, "1_b_2.csv": 0, "1_c_3.csv": 0}
    assert read_orders_csv(spark, [good, good]).count() == 1


def test_a_large_file_is_split(spark, tmp_dir):
    p = write_csv(tmp_dir, "1_a_1.csv", "x,order_id,order_price\n" + "".join(f"y,{i},2\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = read_orders_csv(spark, p, multi_line=False)
        assert df.rdd.getNumPartitions() > 5
        k = kpis.seller_kpis(df, ()).first()
        assert (k.total_orders, k.net_sales) == (50_000, 100_000.0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_and_unreadable_files_are_listed(spark, tmp_dir):
    write_csv(tmp_dir, "1_empty_1.csv", "")
    write_csv(tmp_dir, "1_ok +%_2.csv", "order_id\n1\n2\n")
    with open(os.path.join(tmp_dir, "1_binary_3.csv"), "wb") as f:
        f.write(b"order_id\n\xff\xfe\n")
    got = {r.filename: (r.row_count, r.readable) for r in file_report(spark, tmp_dir).collect()}
    assert got == {"1_empty_1.csv": (0, True), "1_ok +%_2.csv": (2, True), "1_binary_3.csv": (0, False)}
    assert {r.filename: r.length for r in list_files(spark, tmp_dir, "*empty*").collect()} == {"1_empty_1.csv": 0}


def test_three_scans_miss_no_file(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "in")
    os.makedirs(folder)
    orders, cat, ckpt = (os.path.join(tmp_dir, x) for x in ("orders", "catalog", "ckpt"))
    scan = lambda: scan_folder(spark, folder, orders, cat, checkpoint=ckpt)
    rows = lambda: {r.filename: r.row_count for r in read_catalog(spark, cat).collect()}
    write_csv(folder, "4_a_1.csv", "order_id,order_price\n1,10\n2,20\n")
    scan()
    assert rows() == {"4_a_1.csv": 2}
    old = write_csv(folder, "4_old_2.csv", "order_id,order_price\n3,30\n")
    os.utime(old, (time.time() - 30 * 86400,) * 2)
    write_csv(folder, "4_empty_3.csv", "")
    # registered by another route before the scan finds it
    known = write_csv(folder, "4_known_4.csv", "order_id,order_price\n9,90\n")
    catalog.register_uploads(spark.createDataFrame([("4_known_4.csv", known, 1)], "filename string, filepath string, row_count long")).write.mode("append").parquet(f"{cat}/batch=other")
    with open(os.path.join(folder, "4_binary_5.csv"), "wb") as f:
        f.write(b"order_id\n\xff\n")
    scan()
    assert rows() == {"4_a_1.csv": 2, "4_old_2.csv": 1, "4_empty_3.csv": 0, "4_known_4.csv": 1, "4_binary_5.csv": 0}
    scan()
    assert read_catalog(spark, cat).count() == 5
    assert sorted(r.order_id for r in spark.read.parquet(orders).collect()) == [1, 2, 3]


def test_a_file_written_again_replaces_its_rows(spark, tmp_dir):
    folder, table, cat = (os.path.join(tmp_dir, x) for x in ("in", "table", "catalog"))
    os.makedirs(folder)
    paths = [write_csv(folder, f"4_{n}_1.csv", f"order_id,order_date,order_price\n{i},01-01-2025,10\n") for i, n in enumerate("ab")]
    files = spark.createDataFrame([(os.path.basename(p), p, 1) for p in paths], "filename string, filepath string, row_count long")
    ups = catalog.register_uploads(files)
    ups.write.parquet(f"{cat}/batch=0")
    order_table.store_uploads(read_orders_csv(spark, paths, uploads=ups), table)
    time.sleep(1)
    write_csv(folder, "4_a_1.csv", "order_id,order_date,order_price\n7,01-02-2025,70\n8,01-02-2025,80\n")
    ingest_changed(spark, folder, table, cat)
    assert sorted(r.order_id for r in order_table.read_orders(spark, table).collect()) == [1, 7, 8]
    assert read_catalog(spark, cat).filter("filename = '4_a_1.csv' and row_count = 2").count() == 1


@pytest.fixture()
def two_sellers(spark):
    return spark.createDataFrame([(s, s * 10 + u, i, "01-01-2025", 5) for s in (1, 2) for u in (1, 2) for i in range(3)],
                                 "seller_id long, upload_id long, order_id long, order_date string, order_price int")


def test_replacing_one_upload_leaves_the_others(spark, tmp_dir, two_sellers):
    table = os.path.join(tmp_dir, "t")
    count = lambda: {r.upload_id: r["count"] for r in order_table.read_orders(spark, table).groupBy("upload_id").count().collect()}
    order_table.store_uploads(two_sellers, table)
    order_table.store_uploads(two_sellers.filter("upload_id = 11 and order_id < 2"), table)
    assert count() == {11: 2, 12: 3, 21: 3, 22: 3}
    order_table.delete_uploads(spark, table, spark.createDataFrame([(12,)], "upload_id long"))
    assert count() == {11: 2, 21: 3, 22: 3}
    order_table.purge_sellers(spark, table, spark.createDataFrame([(2,)], "seller_id long"))
    assert count() == {11: 2}
    order_table.store_uploads(two_sellers.filter("upload_id in (12, 21)"), table)  # uploaded anew
    assert count() == {11: 2, 12: 3, 21: 3}
    order_table.compact(spark, table, os.path.join(tmp_dir, "c"))
    assert order_table.read_orders(spark, os.path.join(tmp_dir, "c")).count() == 8


def test_list_positions_of_a_bulk_load(spark):
    n = 50_000
    ups = spark.range(n).select(F.col("id").alias("upload_id"), F.lit(1).cast("long").alias("seller_id"), F.lit("f").alias("filename"), F.lit("f").alias("original_name"),
                                F.lit("p").alias("filepath"), F.lit("2025-01-01 10:00:00.5").cast("timestamp").alias("upload_date"), F.lit(1).cast("long").alias("row_count"))
    late = ups.limit(3).withColumn("upload_id", F.col("upload_id") + n).withColumn("upload_date", F.lit("2025-01-01 10:00:00.7").cast("timestamp"))
    none = ups.limit(1).withColumn("upload_id", F.lit(-1).cast("long")).withColumn("upload_date", F.lit(None).cast("timestamp"))
    got = catalog.uploads_list(ups.unionByName(late).unionByName(none))
    wrong = got.filter("not (position = case when upload_id = -1 then 50003 else 50002 - upload_id end)")
    assert got.count() == n + 4 and wrong.count() == 0


def test_validation_of_a_roll_up_is_refused(spark, two_sellers):
    with pytest.raises(ValueError):
        validate_orders(rollup(two_sellers.withColumn("order_price", F.col("order_price").cast("decimal(18,2)"))))


def test_stored_name_folds_accents(spark):
    name = spark.range(1).select(catalog.stored_name(F.lit(4), F.lit("Übersicht März.csv"))).first()[0]
    assert name == "4_Ubersicht_Marz.csv"


def test_reasons_by_count_and_years_in_order(spark):
    df = spark.createDataFrame([(1, "returned", r, d) for r, d in (("a", "01-01-2026"), ("b", "01-01-2024"), ("b", "01-01-2025"))],
                               "seller_id long, order_status string, return_reason string, order_date string")
    assert [(r.return_reason, r.cnt) for r in kpis.return_reasons(df, ordered=True).collect()] == [("b", 2), ("a", 1)]
    from orderlens.operators.months import available_years
    assert [r.year for r in available_years(df).collect()] == [2024, 2025, 2026]


def test_header_is_worked_out_once_a_file(spark):
    from orderlens.sources.csv_orders import with_places
    calls = spark.sparkContext.accumulator(0)

    def head(path):
        calls.add(1)
        return "order_id,order_price"

    texts = spark.createDataFrame([(f"/f{i}.csv",) for i in range(20)], "file_key string").repartition(2)
    heads = texts.select("file_key", F.col("file_key").alias("source_file"), F.udf(head, "string")("file_key").alias("_head"),
                         F.lit(True).alias("readable"), F.lit("\n").alias("_sep"))
    assert {(r._at_order_id, r._at_order_price) for r in with_places(heads).collect()} == {(0, 1)}
    assert calls.value == 20


def test_owner_of_a_file_is_worked_out_once_a_file(spark, tmp_dir):
    calls = spark.sparkContext.accumulator(0)

    def owner(path):
        calls.add(1)
        return int(os.path.basename(path).split("_")[0])

    for i in (3, 4):
        write_csv(tmp_dir, f"{i}_a_1.csv", "order_id,order_price\n" + "".join(f"{n},{i}\n" for n in range(50)))
    got = read_orders_csv(spark, tmp_dir, per_file={"seller_id": F.udf(owner, "bigint")("source_file")})
    assert {(r.seller_id, r["count"], int(r.amount)) for r in got.groupBy("seller_id").agg(F.count("*").alias("count"), F.sum("order_price").alias("amount")).collect()} == {(3, 50, 150), (4, 50, 200)}
    assert calls.value == 2


def test_a_cell_is_picked_once_a_row(spark, tmp_path):
    """The picking of a column is not repeated for every mention of its value."""
    write_csv(str(tmp_path), "1_a.csv", "order_id,order_date,order_price\n7,02-01-2025,10.5\n100.0,nan,NA\n")
    write_csv(str(tmp_path), "2_b.csv", "order_price,order_id,order_date\n3,8,31-12-2024\nx,None,\n")
    df = read_orders_csv(spark, str(tmp_path), pathGlobFilter="*.csv")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_at_order_id") <= 12 and "regexp_replace" not in plan.split("Join")[0]
    got = {(r.order_id, r.order_date, str(r.order_dt), None if r.order_price is None else float(r.order_price)) for r in df.collect()}
    assert got == {(7, "02-01-2025", "2025-01-02", 10.5), (100, None, "None", None), (8, "31-12-2024", "2024-12-31", 3.0), (None, None, "None", None)}
