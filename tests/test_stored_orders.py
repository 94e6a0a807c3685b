"""The order table under two writers, replacement seen by lines and roll-up,
columns that change, uniqueness, repeated updates and chunked documents."""

import itertools
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import write_csv
from orderlens.operators import catalog, kpis
from orderlens.sources import order_table
from orderlens.streaming.ingest import read_catalog, scan_folder


@pytest.fixture()
def lines(spark):
    return spark.createDataFrame([(s, s * 10 + u, i, "01-01-2025", 5) for s in (1, 2) for u in (1, 2) for i in range(3)],
                                 "seller_id long, upload_id long, order_id long, order_date string, order_price int")


def counts(spark, table):
    return {r.upload_id: r["count"] for r in order_table.read_orders(spark, table).groupBy("upload_id").count().collect()}


def rolled(spark, table):
    return {r.upload_id: r.n for r in order_table.read_rollup(spark, table).groupBy("upload_id").agg(F.sum("_w_rows").alias("n")).collect()}


@pytest.mark.parametrize("first", ["a", "b"])
def test_two_writers_at_once_lose_nothing(spark, tmp_dir, lines, monkeypatch, first):
    """Both writers look at the table before either has written."""
    table = os.path.join(tmp_dir, "t")
    order_table.store_uploads(lines.filter("upload_id = 11"), table)
    seen = {"a": ("writer-a", 2), "b": ("writer-b", 2)}
    for who in sorted("ab", key=lambda w: w != first):
        monkeypatch.setattr(order_table, "_begin", lambda *_, who=who: seen[who])
        order_table.store_uploads(lines.filter("upload_id in (12, 21)" if who == "a" else "upload_id = 22 or (upload_id = 21 and order_id = 0)"), table)
    # the upload that both wrote is settled by name, whoever was first
    assert counts(spark, table) == rolled(spark, table) == {11: 3, 12: 3, 21: 1, 22: 3}


def test_a_repeated_write_replaces_itself(spark, tmp_dir, lines):
    table = os.path.join(tmp_dir, "t")
    for _ in range(2):
        order_table.store_uploads(lines, table, name="epoch-0")
    assert counts(spark, table) == rolled(spark, table) == {11: 3, 12: 3, 21: 3, 22: 3}
    assert order_table.manifest(spark, table).agg(F.max("place")).first()[0] == 1


def test_roll_up_follows_replacements(spark, tmp_dir, lines):
    table = os.path.join(tmp_dir, "t")
    order_table.store_uploads(lines, table)
    order_table.store_uploads(lines.filter("upload_id = 11 and order_id = 0"), table)
    order_table.delete_uploads(spark, table, spark.createDataFrame([(12,)], "upload_id long"))
    assert counts(spark, table) == rolled(spark, table) == {11: 1, 21: 3, 22: 3}
    order_table.store_uploads(lines.limit(0), table, spark.createDataFrame([(2, 21)], "seller_id long, upload_id long"))
    assert counts(spark, table) == rolled(spark, table) == {11: 1, 22: 3}
    order_table.purge_sellers(spark, table, spark.createDataFrame([(2,)], "seller_id long"))
    assert counts(spark, table) == rolled(spark, table) == {11: 1}
    assert sorted(kpis.seller_kpis(order_table.read_rollup(spark, table)).collect()) == sorted(kpis.seller_kpis(order_table.read_orders(spark, table)).collect())


def test_columns_of_all_versions(spark, tmp_dir, lines):
    table = os.path.join(tmp_dir, "t")
    order_table.store_uploads(lines.filter("upload_id = 11"), table)
    order_table.store_uploads(lines.filter("upload_id = 12").drop("order_price").withColumn("channel", F.when(F.col("order_id") > 0, F.lit("shop"))), table)
    got = order_table.read_orders(spark, table, defaults={"channel": "none", "order_price": 7})
    assert sorted((r.upload_id, r.order_id, r.order_price, r.channel) for r in got.collect()) == sorted(
        [(11, i, 5, "none") for i in range(3)] + [(12, 0, 7, None), (12, 1, 7, "shop"), (12, 2, 7, "shop")], key=str)
    plain = order_table.read_orders(spark, table)
    assert {r.channel for r in plain.filter("upload_id = 11").collect()} == {None} and plain.columns == ["seller_id", "upload_id", "order_id", "order_date", "order_price", "channel", "order_dt", "order_month"] or set(plain.columns) == set(got.columns)


def test_no_table_yet(spark, tmp_dir):
    assert order_table.manifest(spark, os.path.join(tmp_dir, "t")).count() == 0
    with pytest.raises(ValueError):
        order_table.read_orders(spark, os.path.join(tmp_dir, "t"))


def test_scans_see_new_changed_and_removed_files(spark, tmp_dir):
    folder, orders, cat, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "orders", "catalog", "ckpt"))
    os.makedirs(folder)
    scan = lambda: scan_folder(spark, folder, orders, cat, checkpoint=ckpt, drop_missing=True)
    ids = lambda: sorted(r.order_id for r in order_table.read_orders(spark, orders).collect())
    for i, n in enumerate("abc"):
        write_csv(folder, f"4_{n} [x]_1.csv", f"order_id,order_date,order_price\n{i},01-01-2025,10\n")
    scan()
    assert ids() == [0, 1, 2]
    time.sleep(1.1)
    write_csv(folder, "4_a [x]_1.csv", "order_price,order_id,order_date\n70,7,01-02-2025\n80,8,01-02-2025\n")
    write_csv(folder, "4_d_1.csv", "order_id,order_date,order_price\n9,01-01-2025,10\n")
    os.remove(os.path.join(folder, "4_c [x]_1.csv"))
    scan()
    assert ids() == [1, 7, 8, 9]
    lines, roll = (kpis.seller_kpis(f(spark, orders)).first() for f in (order_table.read_orders, order_table.read_rollup))
    assert lines == roll and (lines.total_orders, lines.net_sales) == (4, 170.0)
    newest = catalog.dedupe_uploads(read_catalog(spark, cat))
    assert {r.filename: r.row_count for r in newest.collect()} == {"4_a [x]_1.csv": 2, "4_b [x]_1.csv": 1, "4_c [x]_1.csv": 1, "4_d_1.csv": 1}
    time.sleep(1.1)
    write_csv(folder, "4_c [x]_1.csv", "order_id\n3\n")  # comes back
    scan()
    scan()
    assert ids() == [1, 3, 7, 8, 9]


def plain_unique(new, current, keys):
    held = [{r[k] for r in current} for k in range(keys)]
    out = {}
    for place, row in sorted(new):
        bad = next((f"k{k} " + ("exists" if row[k] in {r[k] for r in current} else "repeated") for k in range(keys) if row[k] is not None and row[k] in held[k]), None)
        exists = next((f"k{k} exists" for k in range(keys) if row[k] is not None and row[k] in {r[k] for r in current}), None)
        out[place] = exists or bad
        if not out[place]:
            for k in range(keys):
                held[k].add(row[k])
    return out


@pytest.mark.parametrize("keys", [1, 2])
def test_uniqueness_as_one_by_one(spark, keys):
    rnd = random.Random(keys)
    value = lambda: rnd.choice([None, "hot", "hot", *[f"v{i}" for i in range(25)]])
    current = [tuple(f"v{rnd.randrange(40)}" for _ in range(keys)) for _ in range(6)]
    new = [(i, tuple(value() for _ in range(keys))) for i in rnd.sample(range(1000), 60)]
    names = [f"k{k}" for k in range(keys)]
    n = spark.createDataFrame([(i, *r) for i, r in new], "id long, " + ", ".join(f"{k} string" for k in names))
    c = spark.createDataFrame(current, ", ".join(f"{k} string" for k in names))
    got = {r.id: r.reason for r in catalog.check_unique(n, c, names, "id").collect()}
    assert got == plain_unique(new, current, keys)
    assert catalog.check_unique(n.limit(0), c, names, "id").count() == 0


def test_a_refused_row_frees_its_values(spark):
    """Each row is refused for a value of the one before the last accepted."""
    n = 9
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k0 string, k1 string")
    got = {r.id: r.reason for r in catalog.check_unique(df, df.limit(0), ["k0", "k1"], "id").collect()}
    assert got == plain_unique([(i, (a, b)) for i, a, b in rows], [], 2)


def test_updates_of_one_key_in_any_order(spark):
    cur = spark.createDataFrame([(1, "A", "a@x"), (2, "B", None)], "seller_id long, name string, email string")
    rows = [(1, 1, "one", "late@x"), (1, 2, None, None), (1, 3, "three", None), (3, 1, "new", None), (3, 2, None, "n@x"), (4, 1, None, None)]
    for order in itertools.islice(itertools.permutations(rows), 0, 720, 180):
        upd = spark.createDataFrame(list(order), "seller_id long, at int, name string, email string")
        got = sorted((r.seller_id, r.name, r.email) for r in catalog.upsert_by_key(cur, upd, order="at").collect())
        assert got == [(1, "three", "late@x"), (2, "B", None), (3, "new", "n@x"), (4, None, None)]
    assert catalog.upsert_by_key(cur, spark.createDataFrame([(1,), (1,), (5,)], "seller_id long")).count() == 3


def test_chunks_hold_the_whole_document(spark):
    n = 2500
    rows = spark.range(n).select(F.lit(1).alias("seller_id"), "id", F.lit("returned").alias("order_status"), F.concat(F.lit("reason "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("return_reason"))
    two = rows.filter("id < 3").withColumn("seller_id", F.lit(2)).unionByName(rows.filter("id = 2").withColumn("seller_id", F.lit(2)))
    chunks = kpis.kpi_json_chunks(rows.unionByName(two), entries=100).collect()
    for seller, size in ((1, n), (2, 3)):
        parts = sorted((r.chunk, json.loads(r.json)) for r in chunks if r.seller_id == seller and r.section == "return_reasons")
        assert [c for c, _ in parts] == list(range((size + 99) // 100)) and all(len(p) <= 100 for _, p in parts)
        every = [(e["return_reason"], e["cnt"]) for _, p in parts for e in p]
        assert len(every) == size and every == sorted(every, key=lambda e: (-e[1], e[0]))
    assert json.loads(next(r.json for r in chunks if r.seller_id == 2 and r.section == "kpis"))["total_returns"] == 4
