"""Skew experiment: give one seller a third of all order lines and report,
per operator, the largest number of shuffle records any task reads next to
the total (from the Spark event log in a scratch folder).

usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="skew-events-")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from orderlens.operators import category, kpis, sku
    from orderlens.sources.testdata import orders_from_tpch
    o = orders_from_tpch(spark, sf)
    # one seller (id 1) gets every third line
    hot = o.withColumn("seller_id", F.when(F.pmod("order_id", F.lit(3)) == 0, F.lit(1)).otherwise(F.col("seller_id")))
    runs = {
        "seller_kpis": lambda: kpis.seller_kpis(hot),
        "top_returned_skus": lambda: kpis.top_returned_skus(hot),
        "sku_ranking": lambda: sku.sku_ranking(hot),
        "category_scorecard": lambda: category.category_scorecard(hot),
    }
    marks = []
    for name, fn in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        fn().write.format("noop").mode("overwrite").save()
        marks.append(name)
    spark.stop()
    import zstandard
    stages, tasks = {}, {}
    for f in sorted(glob.glob(logdir + "/*/events*")):
        raw = open(f, "rb").read()
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode() \
            if f.endswith(".zstd") else raw.decode()
        for line in text.splitlines():
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                group = e.get("Properties", {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stages[sid] = group
            elif e["Event"] == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                tasks.setdefault(e["Stage ID"], []).append(rec)
    print("| operator | shuffle stage | tasks | records read (total) | max per task |")
    print("|---|---|---|---|---|")
    for name in marks:
        for sid in sorted(s for s, g in stages.items() if g == name):
            recs = tasks.get(sid, [])
            if sum(recs):
                print(f"| {name} | {sid} | {len(recs)} | {sum(recs)} | {max(recs)} |")


if __name__ == "__main__":
    main()
