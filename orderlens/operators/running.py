"""Running totals over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import ensure_checkpoint_dir


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``df`` with the sum ``out`` of ``value`` over the rows of the same
    ``keys`` that come before in ``order`` (0 for the first).

    A prefix sum in two levels, so that no task holds a whole group: rows are
    dealt into ranges of (keys, order) of about equal size, each range is summed
    by itself, and what stands before a range is a running sum over one row for
    each range and key.  The dealing samples its input, so its result is written
    to the shared checkpoint folder once and both levels read that (a job runs
    when this is called).  ``order`` should leave no ties between rows of a key;
    rows that tie are taken in any order.
    """
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum(value).over(before(Window.partitionBy("__range", *keys).orderBy(*order)))
    totals = dealt.groupBy("__range", *keys).agg(F.sum(value).alias("__total"))
    offset = F.sum("__total").over(before(Window.partitionBy(*keys).orderBy("__range")))
    offsets = totals.select("__range", *keys, F.coalesce(offset, F.lit(0)).alias("__offset"))
    summed = dealt.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    # a key may be NULL, so the join of the levels is null-safe
    same = F.lit(True)
    for k in ["__range", *keys]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return summed.alias("l").join(offsets.alias("r"), same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__inside") + F.col("__offset")).alias(out))
