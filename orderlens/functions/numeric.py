"""Numeric column helpers (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def rint_k(c: Column | str, k: int) -> Column:
    """Round half-to-even on the scaled double: ``rint(x * 10^k) / 10^k``.

    This is how numpy rounds (1.005 -> 1.0, 0.125 -> 0.12, 8.345 -> 8.35);
    Spark's ``round``/``bround`` differ on such values.
    """
    x = as_double(c)
    if k == 0:
        return F.rint(x)
    scale = float(10 ** k)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` in double; NULL (not an error) when ``den`` is 0."""
    return F.try_divide(as_double(num), as_double(den))


def percent(num: Column | str, den: Column | str) -> Column:
    """``num / den * 100`` in double; NULL when ``den`` is 0."""
    return ratio(num, den) * F.lit(100.0)


def guarded_percent(num: Column | str, den: Column | str, k: int = 2) -> Column:
    """Rounded percent, 0.0 when ``den`` is not positive."""
    den_c = F.col(den) if isinstance(den, str) else den
    return F.when(den_c > 0, rint_k(percent(num, den), k)).otherwise(F.lit(0.0))


def sum0(c: Column | str) -> Column:
    """Sum that is 0 (not NULL) over no or all-null input."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0))


def clip(c: Column, lo: float, hi: float) -> Column:
    """``clip(lo, hi)`` that keeps NULL as NULL (greatest/least skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))
