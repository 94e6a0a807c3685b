"""Folder listing, order table sink (month partitions) and CSV export."""

import os
import shutil

from pyspark.sql import functions as F

from conftest import FILES
from orderlens.operators import catalog, kpis
from orderlens.sources import export_csv, list_files, read_orders_csv, write_orders


def test_list_files_glob_and_discovery(spark, tmp_dir, uploads):
    folder = os.path.join(tmp_dir, "up")
    os.makedirs(folder)
    for name in ["4_orders.csv", "4_orders_march_2025.csv", "9_new_2025.csv",
                 "readme.txt"]:
        shutil.copy(FILES[1], os.path.join(folder, name))
    lst = list_files(spark, folder, pattern="*_[0-9]*.csv")
    assert sorted(r.filename for r in lst.collect()) == ["4_orders_march_2025.csv",
                                                         "9_new_2025.csv"]
    every = list_files(spark, folder)
    assert every.count() == 4
    found = catalog.discover_uploads(every, uploads)
    assert sorted(r.filename for r in found.collect()) == ["4_orders_march_2025.csv",
                                                           "9_new_2025.csv"]


def test_write_orders_partitioned_and_pruned(spark, tmp_dir, sample_orders):
    out = os.path.join(tmp_dir, "orders")
    write_orders(sample_orders.drop("_absent"), out, mode="overwrite")
    months = sorted(d for d in os.listdir(out) if d.startswith("order_month="))
    assert months == ["order_month=2025-01", "order_month=2025-02", "order_month=2025-03"]
    back = spark.read.parquet(out)
    assert back.count() == 125
    feb = back.filter(F.col("order_month") == "2025-02")
    plan = feb._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert feb.count() == 20
    # appending one upload's rows again touches nothing else
    write_orders(sample_orders.drop("_absent").filter("upload_id = 2"), out, mode="append")
    assert spark.read.parquet(out).count() == 145
    write_orders(sample_orders.drop("_absent"), out, mode="overwrite")
    k = kpis.seller_kpis(spark.read.parquet(out), ["upload_id"]).orderBy("upload_id").collect()
    assert [r.total_orders for r in k] == [80, 20, 25]


def test_export_csv_roundtrip(spark, tmp_dir, sample_orders):
    out = os.path.join(tmp_dir, "export")
    cols = ["order_id", "order_date", "sku_description", "order_price", "order_status"]
    export_csv(sample_orders, out, upload_id=3, columns=cols)
    files = [os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")]
    back = read_orders_csv(spark, files)
    assert back.count() == 25
    assert kpis.seller_kpis(back, ()).first().net_sales == 56297.0


def test_month_comparison_prunes_month_folders(spark, tmp_dir, sample_orders):
    from orderlens.operators import months
    out = os.path.join(tmp_dir, "orders")
    write_orders(sample_orders.drop("_absent"), out, mode="overwrite")
    table = spark.read.parquet(out)
    c = months.month_comparison(table, (2025, 1), (2025, 2), ["seller_id"])
    plan = c._jdf.queryExecution().executedPlan().toString()
    import re
    parts = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("order_month" in p and "2025-01" in p and "2025-03" not in p for p in parts), parts
    r = c.first()
    assert (r.total_orders1, r.total_orders2, r.revenue_change) == (80, 20, -142287.0)


def _lineitem(spark, path, sellers=60):
    n = F.col("id")
    spark.range(sellers * 5).select(
        (n % sellers + 1).alias("l_suppkey"), n.alias("l_orderkey"), n.alias("l_partkey"), (n % 7 + 1).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
        F.lit(10.0).alias("l_extendedprice"), F.lit(0.1).alias("l_tax"), F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.lit("1995-03-01").cast("timestamp").alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")


def test_folders_are_listed_by_few_tasks(spark, tmp_dir):
    """A task lists many folders: with one a folder, each reads the Hadoop configuration first."""
    for i in range(300):
        os.makedirs(os.path.join(tmp_dir, f"seller_id={i}"))
        with open(os.path.join(tmp_dir, f"seller_id={i}", "a_1.csv"), "w") as f:
            f.write("order_id\n1\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(key)
    sc = spark.sparkContext
    try:
        sc.setJobGroup("few", "listing")
        assert list_files(spark, tmp_dir, recursive=True).count() == 300
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    seen = sc.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("few") for s in seen.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * sc.defaultParallelism
    spark.conf.set(key, "7")  # what the session sets is kept
    try:
        list_files(spark, tmp_dir)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)


def test_small_files_of_the_upload_folder_are_written_by_many_tasks(spark, tmp_dir):
    from orderlens.plans.queries import _upload_folder
    _lineitem(spark, tmp_dir)
    root = _upload_folder(spark, tmp_dir)
    listed = list_files(spark, root, recursive=True).cache()
    assert listed.count() == 61
    for kind in ("orders", "header", "binary"):
        tasks = listed.filter(F.col("filepath").contains(f"/{kind}/")).select(F.regexp_extract("filename", r"part-(\d+)", 1)).distinct().count()
        assert tasks > 4, kind


def test_a_stored_month_has_few_files(spark, tmp_dir):
    """Not one file from every task."""
    n = F.col("id")
    day = F.date_add(F.lit("2020-01-15").cast("date"), ((n % 12) * 30).cast("int"))
    o = spark.range(0, 4800, 1, 8).select((n % 97).alias("seller_id"), n.alias("order_id"), n.alias("upload_id"), F.date_format(day, "dd-MM-yyyy").alias("order_date"), day.alias("order_dt"))
    out = os.path.join(tmp_dir, "orders")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        write_orders(o, out, mode="overwrite")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spark.read.parquet(out).count() == 4800
    files = [len([f for f in os.listdir(os.path.join(out, d)) if f.endswith(".parquet")]) for d in os.listdir(out) if d.startswith("order_month=")]
    assert len(files) == 12 and max(files) <= 4
