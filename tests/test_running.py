"""Running totals by ranges: values, ties of a range border, NULL keys, one hot key."""

import random

from pyspark.sql import functions as F

from orderlens.operators.running import running_before


def plain(rows, newest):
    out, seen = {}, {}
    for k, t, n in sorted(rows, key=lambda r: -r[1] if newest else r[1]):
        out[k, t] = seen.get(k, 0)
        seen[k] = seen.get(k, 0) + n
    return out


def test_totals_equal_plain_sums(spark):
    rnd = random.Random(7)
    rows = [(k, t, rnd.randrange(5)) for k in (None, 1, 2, 3) for t in rnd.sample(range(1000), 50)]
    df = spark.createDataFrame(rows, "k int, t int, n int")
    for order, newest in ((F.asc("t"), False), (F.desc("t"), True)):
        got = {(r.k, r.t): r.before for r in running_before(df, ["k"], [order], "n", "before").collect()}
        assert got == plain(rows, newest)


def test_without_keys_and_without_rows(spark):
    df = spark.range(1000).select("id", F.lit(2).alias("n"))
    got = running_before(df, [], [F.asc("id")], "n", "before")
    assert got.filter("before <> 2 * id").count() == 0 and got.count() == 1000
    assert running_before(df.limit(0), [], [F.asc("id")], "n", "before").count() == 0


def test_a_key_with_all_rows_is_spread(spark):
    """One seller with two million buckets: no range has more than its share."""
    n = 2_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.lit(1).alias("n"))
    out = running_before(df, ["k"], [F.desc("id")], "n", "before")
    assert out.filter(f"before <> {n - 1} - id").count() == 0
    dealt = df.repartitionByRange("k", F.desc("id")).groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < n / 2
