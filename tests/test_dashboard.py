"""One-pass dashboard equals the per-result (multi-pass) plans."""

from pyspark.sql import functions as F

from orderlens.plans.dashboard import dashboard


def test_one_pass_equals_multi_pass(sample_orders):
    scope = ["seller_id", "upload_id"]
    one = dashboard(sample_orders, scope, materialized=True)
    multi = dashboard(sample_orders, scope, materialized=False)
    assert set(one) == set(multi)
    for name in one:
        a = sorted(one[name].collect())
        b = sorted(multi[name].select(*one[name].columns).collect())
        assert a == b, name


def test_rollup_with_nulls_equals_lines(spark, tmp_dir):
    """Counts of three kinds survive the roll-up (null ids, null prices)."""
    from conftest import write_csv
    from orderlens.sources import read_orders_csv
    header = ("order_id,order_date,catalogue_id,sku_description,item_price,quantity,order_price,"
              "order_status,return_type,return_cost,return_reason\n")
    p = write_csv(tmp_dir, "1_a_2025.csv", header +
                  ",01-01-2025,1,SKU A,10,1,10,returned,customer,2,Size issue\n"
                  "2,01-01-2025,1,SKU A,10,1,,returned,customer,3,Size issue\n"
                  "3,01-01-2025,1,SKU A,10,2,7,returned,customer,,Size issue\n"
                  "4,02-01-2025,2,SKU B,10,1,5,delivered,,0,\n")
    o = read_orders_csv(spark, p).withColumn("seller_id", F.lit(1))
    one = dashboard(o, ["seller_id"], materialized=True)
    multi = dashboard(o, ["seller_id"], materialized=False)
    for name in one:
        assert sorted(one[name].collect()) == sorted(multi[name].select(*one[name].columns).collect()), name


def test_dashboard_json_equals_line_level(sample_orders):
    import json

    from orderlens.operators import kpis
    from orderlens.plans.dashboard import dashboard_json
    a = {r.seller_id: json.loads(r.json) for r in dashboard_json(sample_orders, ["seller_id"]).collect()}
    b = {r.seller_id: json.loads(r.json) for r in kpis.kpi_json(sample_orders, ["seller_id"]).collect()}
    assert a == b
    assert a[4]["total_orders"] == 125 and len(a[4]["top_skus"]) == 5
