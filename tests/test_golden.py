"""Golden values of the three sample order files, which
tools/make_sample_orders.py writes; the values were computed from the rows with
pandas, apart from the operators.

Files: upload 1 = January (A), 2 = February (B), 3 = March (C), all of
seller 4.  Scope (seller_id, upload_id) is "one file" as in the original
per-file dashboard.
"""

import pytest
from pyspark.sql import functions as F

from orderlens.operators import category, kpis, months, sku

SCOPE = ["seller_id", "upload_id"]


def by_upload(df):
    return {r["upload_id"]: r for r in df.collect()}


def test_row_counts(sample_orders):
    got = {r["upload_id"]: r["count"] for r in sample_orders.groupBy("upload_id").count().collect()}
    assert got == {1: 80, 2: 20, 3: 25}
    assert sample_orders.filter(F.size("_absent") != 1).count() == 0  # only 'category' missing


def test_seller_kpis(sample_orders):
    got = by_upload(kpis.seller_kpis(sample_orders, SCOPE))
    want = {
        1: (80, 13, 16.25, 187623.0, 753.0, 186870.0),
        2: (20, 5, 25.0, 45336.0, 412.0, 44924.0),
        3: (25, 6, 24.0, 56297.0, 417.0, 55880.0),
    }
    for uid, w in want.items():
        r = got[uid]
        assert (r.total_orders, r.total_returns, r.return_percent, r.net_sales, r.return_cost, r.net_profit) == w


def test_daily_sales_first_three(sample_orders):
    d = kpis.daily_sales(sample_orders, SCOPE, ordered=True).collect()
    first = {}
    for r in d:
        first.setdefault(r.upload_id, [])
        if len(first[r.upload_id]) < 3:
            first[r.upload_id].append((r.order_date, r.total_amount, r.order_count))
    assert first[1] == [("02-01-2025", 5157.0, 2), ("03-01-2025", 4492.0, 2), ("04-01-2025", 6805.0, 3)]
    assert first[2] == [("06-02-2025", 807.0, 1), ("12-02-2025", 4231.0, 2), ("13-02-2025", 2910.0, 1)]
    assert first[3] == [("01-03-2025", 7209.0, 2), ("03-03-2025", 10719.0, 3), ("08-03-2025", 6208.0, 2)]
    counts = {}
    for r in d:
        counts[r.upload_id] = counts.get(r.upload_id, 0) + 1
    assert counts == {1: 21, 2: 11, 3: 17}
    assert d[0].label == "2nd"


def test_return_reasons(sample_orders):
    got = {}
    for r in kpis.return_reasons(sample_orders, SCOPE).collect():
        got.setdefault(r.upload_id, {})[r.return_reason] = r.cnt
    assert got[1] == {"Size issue": 5, "Wrong product": 4, "Not as described": 3, "Damaged item": 1}
    assert got[2] == {"Wrong product": 3, "Late delivery": 1, "Size issue": 1}
    assert got[3] == {"Size issue": 3, "Damaged item": 2, "Late delivery": 1}


def test_top_returned_catalogues_tie_rule(sample_orders):
    rows = kpis.top_returned_catalogues(sample_orders, SCOPE).filter("upload_id = 1").orderBy("rnk").collect()
    assert [r.catalogue_id for r in rows] == ["232859788", "266944844", "304132575", "351625694", "386665249"]
    assert all(r.return_count == 1 for r in rows)


SKU_GOLDEN = {
    1: [("Reading Lamp Slate", 21, 50701.0, 187.0, 99.6, 4, 19.0),
        ("Reading Lamp Coral", 23, 47116.0, 261.0, 99.4, 4, 17.4),
        ("Reading Lamp Ivory", 15, 38206.0, 305.0, 99.2, 3, 20.0),
        ("Reading Lamp Amber", 11, 27424.0, 0.0, 100.0, 0, 0.0),
        ("Reading Lamp Olive", 10, 24176.0, 0.0, 100.0, 2, 20.0)],
    2: [("Reading Lamp Ivory", 8, 14880.0, 204.0, 98.6, 1, 12.5),
        ("Reading Lamp Amber", 4, 12526.0, 0.0, 100.0, 1, 25.0),
        ("Reading Lamp Pearl", 4, 9287.0, 0.0, 100.0, 1, 25.0),
        ("Reading Lamp Coral", 2, 6468.0, 208.0, 96.8, 1, 50.0),
        ("Reading Lamp Midnight Teal", 2, 2175.0, 0.0, 100.0, 1, 50.0)],
    3: [("Reading Lamp Ivory", 6, 17182.0, 166.0, 99.0, 2, 33.3),
        ("Reading Lamp Midnight Teal", 7, 15077.0, 0.0, 100.0, 1, 14.3),
        ("Reading Lamp Coral", 5, 11137.0, 0.0, 100.0, 0, 0.0),
        ("Reading Lamp Pearl", 2, 8122.0, 0.0, 100.0, 1, 50.0),
        ("Reading Lamp Amber", 5, 4779.0, 251.0, 94.7, 2, 40.0)],
}


@pytest.mark.parametrize("fn", [sku.sku_ranking, sku.sku_ranking_join])
def test_sku_ranking(sample_orders, fn):
    rows = fn(sample_orders, SCOPE).orderBy("upload_id", "rnk").collect()
    got = {}
    for r in rows:
        got.setdefault(r.upload_id, []).append(
            (r.sku, r.orders, r.revenue, r.return_cost, r.profit_margin, r.return_count, r.return_rate))
    assert got == SKU_GOLDEN
    assert rows[0].sku_short == "Reading Lamp Sl..."
    assert rows[0].sku_name == "Reading Lamp Slate"
    assert {r.sku_class for r in rows} == {"General"}


def test_catalogue_dictionary(sample_orders):
    mapped = category.category_mapped(sample_orders, scope=SCOPE)
    named = mapped.filter(~F.col("category").startswith("Category ")).groupBy("upload_id").count().collect()
    assert {r.upload_id: r["count"] for r in named} == {1: 19}


def test_category_scorecard_sums(sample_orders):
    sc = category.category_scorecard(sample_orders, SCOPE)
    tot = {r.upload_id: (r.rev, r.n) for r in
           sc.groupBy("upload_id").agg(F.sum("revenue").alias("rev"), F.sum("orders").alias("n")).collect()}
    assert tot == {1: (187623.0, 80), 2: (45336.0, 20), 3: (56297.0, 25)}
    best = sc.filter("upload_id = 1").orderBy(F.desc("revenue")).first()
    assert (best.name, best.revenue) == ("Category 853193820", 7316.0)  # top catalogue, not in the dictionary
    assert sc.filter("performance_score IS NULL").count() == 0


def test_month_kpis_and_comparison(sample_orders):
    mk = {(r.year, r.month): r for r in months.month_kpis(sample_orders, ["seller_id"]).collect()}
    jan, feb = mk[(2025, 1)], mk[(2025, 2)]
    assert (jan.total_orders, jan.total_quantity, jan.delivered_count, jan.cancelled_count, jan.returned_count) \
        == (80, 177, 60, 7, 13)
    assert (feb.total_quantity, feb.delivered_count, feb.cancelled_count) == (44, 6, 9)
    assert mk[(2025, 3)].total_quantity == 53
    assert jan.month_year == "January 2025"
    c = months.month_comparison(sample_orders, (2025, 1), (2025, 2), ["seller_id"]).first()
    assert c.revenue_change == -142287.0
    assert c.revenue_change_pct == -75.84
    assert c.orders_change == -60
    assert c.orders_change_pct == -75.0
    assert c.return_rate_change == pytest.approx(8.75)
    assert c.aov_change == pytest.approx(-78.4875)
    assert c.aov_change_pct == -3.35
    assert c.has_data1 and c.has_data2


def test_month_comparison_one_month_empty(sample_orders):
    c = months.month_comparison(sample_orders, (2024, 12), (2025, 1), ["seller_id"]).first()
    assert (c.has_data1, c.has_data2) == (False, True)
    assert c.total_orders1 == 0 and c.revenue_change_pct == 0.0 and c.orders_change == 80
    assert months.month_comparison(sample_orders, (2023, 1), (2023, 2), ["seller_id"]).count() == 0
    with pytest.raises(ValueError):
        months.month_comparison(sample_orders, (2025, 1), (2025, 1))
    with pytest.raises(ValueError):
        months.month_comparison(sample_orders, (2025, 13), (2025, 1))
    empty = months.month_comparison(sample_orders, (2025, 0), (2025, 2), ["seller_id"])
    assert empty.count() == 0 and "revenue_change" in empty.columns
    assert months.month_comparison(sample_orders, None, (2025, 2)).count() == 0


def test_available_years(sample_orders):
    got = [(r.seller_id, r.year) for r in months.available_years(sample_orders, ["seller_id"]).collect()]
    assert got == [(4, 2025)]


def test_month_daily_revenue_sums_to_month(sample_orders):
    d = months.month_daily_revenue(sample_orders, ["seller_id"], months=[(2025, 2)])
    assert d.agg(F.sum("revenue")).first()[0] == 45336.0
    assert d.count() == 11


def test_sku_page_kpis(sample_orders):
    r = by_upload(sku.sku_page_kpis(sample_orders, SCOPE))[1]
    assert r.total_revenue == 187623.0 and r.total_units_sold == 80 and r.total_skus_listed == 4
    assert r.aov == 2345.29 and r.total_refunds == 13 and r.distinct_skus == 5 and r.total_quantity == 177
    assert r.delivery_success_rate == 75.0
    assert r.loss_making_skus == 0 and r.high_risk_skus == 4


def test_sku_detail(sample_orders, spark):
    req = spark.createDataFrame([(4, 1, "Reading Lamp Slate"), (4, 1, "No Such SKU")],
                                "seller_id long, upload_id long, sku string")
    got = {r.sku: r for r in sku.sku_detail(sample_orders, req, SCOPE).collect()}
    assert (got["Reading Lamp Slate"].total_orders, got["Reading Lamp Slate"].returns) == (21, 4)
    assert got["Reading Lamp Slate"].return_rate == 19.05
    z = got["No Such SKU"]
    assert (z.total_orders, z.revenue, z.returns, z.return_rate) == (0, 0.0, 0, 0.0)
    one = sku.sku_detail_one(sample_orders.filter("upload_id = 1"), "Reading Lamp Slate").first()
    assert one.total_orders == 21 and one.revenue == 50701.0
    none = sku.sku_detail_one(sample_orders, "nothing").first()
    assert none.total_orders == 0 and none.revenue == 0.0


def test_insights_and_actions(sample_orders):
    sc = category.category_scorecard(sample_orders, SCOPE)
    ins = category.category_insights(sc, SCOPE).collect()
    for r in ins:
        if r.rule == "high_return_rate":
            assert r.metric > 15 and r.message.startswith(r.name + " has a high return rate of ")
        if r.rule == "elevated_return_rate":
            assert 10 < r.metric <= 15
        if r.rule == "low_profit_margin":
            assert r.metric < 10
    acts = category.category_actions(sc, SCOPE)
    assert acts.count() == 3 * 4
    rec = category.category_recommendations(sc, SCOPE).filter("rule = 'expand_top_category'").collect()
    assert len(rec) == 3 and all(r.message.endswith("is your top performer - consider expanding this category.")
                                 for r in rec)


def test_daily_order_text_vs_chronological(sample_orders):
    text = [r.order_date for r in kpis.daily_sales(sample_orders, ["upload_id"], ordered=True).collect()]
    chron = [r.order_date for r in kpis.daily_sales(sample_orders, ["upload_id"], chronological=True).collect()]
    assert sorted(text) == sorted(chron)
    dates = [r.order_dt for r in kpis.daily_sales(sample_orders, (), chronological=True).collect()]
    assert dates == sorted(dates)
