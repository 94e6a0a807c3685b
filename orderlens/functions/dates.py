"""Date column helpers for the ``dd-mm-yyyy`` order date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Strict day-month-year text: 1-2 digit day and month, 4 digit year.
DMY_PATTERN = r"^\d{1,2}-\d{1,2}-\d{4}$"
DMY_FORMAT = "d-M-yyyy"
DISPLAY_DATE = "yyyy-MM-dd"
DISPLAY_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_dmy(c: Column | str) -> Column:
    """Parse ``d-m-yyyy`` text to a DATE; anything else (2-digit year,
    ISO, '/', spaces, 31-02, year 0, NULL) gives NULL."""
    s = _col(c)
    ok = s.rlike(DMY_PATTERN) & (F.substring_index(s, "-", -1) != "0000")
    return F.when(ok, F.try_to_date(s, DMY_FORMAT))


def month_label(year: Column | str, month: Column | str) -> Column:
    """'March 2025' for (2025, 3)."""
    y, m = _col(year), _col(month)
    return F.concat(F.date_format(F.make_date(y, m, F.lit(1)), "MMMM"), F.lit(" "), y.cast("string"))


def month_index(year: Column | str, month: Column | str) -> Column:
    """Months since year 0 (``year*12 + month-1``), for month arithmetic."""
    return _col(year) * 12 + _col(month) - 1
