"""Incremental folder ingest: each file exactly once across runs."""

import os
import shutil

from conftest import FILES
from orderlens.streaming import ingest_folder


def test_folder_ingest_each_file_once(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "uploads")
    os.makedirs(folder)
    out_orders, out_cat = os.path.join(tmp_dir, "orders"), os.path.join(tmp_dir, "catalog")
    ckpt = os.path.join(tmp_dir, "ckpt")
    shutil.copy(FILES[1], os.path.join(folder, "4_orders_2025_01.csv"))
    shutil.copy(FILES[2], os.path.join(folder, "4_orders_2025_02.csv"))
    with open(os.path.join(folder, "notes.csv"), "w") as f:   # no '_<digit>': not picked up
        f.write("a,b\n1,2\n")
    q = ingest_folder(spark, folder, out_orders, out_cat, checkpoint=ckpt)
    q.awaitTermination(120)
    cat = spark.read.parquet(out_cat)
    assert {r.filename: r.row_count for r in cat.collect()} == {"4_orders_2025_01.csv": 80,
                                                                "4_orders_2025_02.csv": 20}
    # second run with one new file: only that file is added
    shutil.copy(FILES[3], os.path.join(folder, "4_orders_2025_03.csv"))
    with open(os.path.join(folder, "4_empty_2025.csv"), "w") as f:
        f.write("order_id,order_date,order_price\n")
    q = ingest_folder(spark, folder, out_orders, out_cat, checkpoint=ckpt)
    q.awaitTermination(120)
    cat = spark.read.parquet(out_cat)
    rows = {r.filename: (r.row_count, r.seller_id) for r in cat.collect()}
    assert rows == {"4_orders_2025_01.csv": (80, 4), "4_orders_2025_02.csv": (20, 4),
                    "4_orders_2025_03.csv": (25, 4), "4_empty_2025.csv": (0, 4)}
    orders = spark.read.parquet(out_orders)
    assert orders.count() == 125
    assert orders.filter("upload_id IS NULL OR seller_id IS NULL").count() == 0
    # a third run finds nothing new
    q = ingest_folder(spark, folder, out_orders, out_cat, checkpoint=ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out_orders).count() == 125


def test_ingest_maintains_dashboard_rollup(spark, tmp_dir):
    from orderlens.operators import kpis, sku
    from orderlens.plans.dashboard import dashboard
    folder = os.path.join(tmp_dir, "uploads")
    os.makedirs(folder)
    out = {k: os.path.join(tmp_dir, k) for k in ("orders", "catalog", "rollup", "ckpt")}
    shutil.copy(FILES[1], os.path.join(folder, "4_orders_2025_01.csv"))
    q = ingest_folder(spark, folder, out["orders"], out["catalog"], checkpoint=out["ckpt"], rollup_path=out["rollup"])
    q.awaitTermination(120)
    shutil.copy(FILES[2], os.path.join(folder, "4_orders_2025_02.csv"))
    shutil.copy(FILES[3], os.path.join(folder, "4_orders_2025_03.csv"))
    q = ingest_folder(spark, folder, out["orders"], out["catalog"], checkpoint=out["ckpt"], rollup_path=out["rollup"])
    q.awaitTermination(120)
    lines = spark.read.parquet(out["orders"])
    rolled = spark.read.parquet(out["rollup"])
    assert rolled.count() <= lines.count()   # sample rows have distinct catalogue ids
    for scope in (["seller_id"], ["seller_id", "upload_id"]):
        a = sorted(kpis.seller_kpis(rolled, scope).collect())
        b = sorted(kpis.seller_kpis(lines, scope).collect())
        assert a == b
        assert sorted(sku.sku_ranking(rolled, scope).collect()) == sorted(sku.sku_ranking(lines, scope).collect())
    from orderlens.plans.dashboard import compact
    compact(spark, out["rollup"], os.path.join(tmp_dir, "compacted"))
    merged = spark.read.parquet(os.path.join(tmp_dir, "compacted"))
    assert merged.count() <= rolled.count()
    assert sorted(kpis.seller_kpis(merged).collect()) == sorted(kpis.seller_kpis(lines).collect())
    one = dashboard(rolled, ["seller_id"], materialized=False)
    two = dashboard(lines, ["seller_id"], materialized=False)
    for name in one:
        assert sorted(one[name].collect()) == sorted(two[name].select(*one[name].columns).collect()), name
