"""Shared helpers: column presence, scope handling, top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.schema import ORDER_TYPES, STATUS_RETURNED

Scope = Sequence[str]
DEFAULT_SCOPE: tuple[str, ...] = ("seller_id",)

# Per-row list of the columns the source file did not have (set by the CSV
# reader); lets "column absent" differ from "value null" per upload.
ABSENT_COL = "_absent"


def scope_cols(scope: Scope | None) -> list[str]:
    return list(scope or [])


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def col_or_null(df: DataFrame, name: str) -> Column:
    """The column, or a typed NULL when the frame lacks it."""
    if has(df, name):
        return F.col(name)
    return F.lit(None).cast(ORDER_TYPES.get(name, "string"))


def absent_in_row(df: DataFrame, name: str) -> Column:
    """TRUE where the row's source file lacked ``name``."""
    if not has(df, name):
        return F.lit(True)
    if has(df, ABSENT_COL):
        return F.coalesce(F.array_contains(F.col(ABSENT_COL), F.lit(name)), F.lit(False))
    return F.lit(False)


# A pre-aggregated order table (see orderlens.plans.dashboard.rollup) keeps
# one row per key with these line counts; counting then sums them.
W_ROWS = "_w_rows"


def _weight_of(name: str) -> str:
    return f"_w_{name}"


def n_rows(df: DataFrame) -> Column:
    """Number of order lines."""
    if has(df, W_ROWS):
        return F.coalesce(F.sum(W_ROWS), F.lit(0)).cast("bigint")
    return F.count(F.lit(1))


def n_where(df: DataFrame, cond: Column) -> Column:
    """Number of order lines meeting ``cond``."""
    if has(df, W_ROWS):
        return F.coalesce(F.sum(F.when(cond, F.col(W_ROWS))), F.lit(0)).cast("bigint")
    return F.count_if(cond)


def n_nonnull(df: DataFrame, name: str) -> Column:
    """Number of order lines whose ``name`` is not NULL."""
    if has(df, _weight_of(name)):
        return F.coalesce(F.sum(_weight_of(name)), F.lit(0)).cast("bigint")
    return F.count(col_or_null(df, name))


def is_returned(df: DataFrame) -> Column:
    return F.coalesce(col_or_null(df, "order_status") == F.lit(STATUS_RETURNED), F.lit(False))


def status_is(df: DataFrame, value: str) -> Column:
    return F.coalesce(col_or_null(df, "order_status") == F.lit(value), F.lit(False))


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named ``keys``.

    Scope keys (seller_id, upload_id, ...) are lineage ids and expected to
    be non-null; plain equality keeps the aggregates' hash partitioning,
    so a join of two aggregates on their group keys needs no new shuffle.
    """
    return left.join(right, list(keys), how)


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to no scope group (NULL key) are left out."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def top_k(df: DataFrame, scope: Scope | None, order: list[Column], k: int,
          rank_col: str = "rnk") -> DataFrame:
    """Top ``k`` rows per scope group, ranked 1..k by ``order``.

    Per group this is ``row_number() <= k``, which Spark plans with a partial
    WindowGroupLimit before the shuffle, so a hot group ships at most ``k``
    rows per map task.  Without a scope it is a TakeOrderedAndProject.
    """
    keys = scope_cols(scope)
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    ranked = df.orderBy(*order).limit(k)
    w = Window.orderBy(*order)
    return ranked.withColumn(rank_col, F.row_number().over(w))


def money(c: Column | str) -> Column:
    """Exact decimal amount presented as double."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")
