"""Column helpers: rounding, labels, truncation, date parsing, globs."""

import re

import pytest
from pyspark.sql import functions as F

from orderlens.functions import (
    day_label, ellipsis, glob_to_regex, ordinal, parse_dmy, rint_k, secure_filename, sku_class,
)


def _one(spark, col, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("x,k,want", [
    (1.005, 2, 1.0), (0.125, 2, 0.12), (8.345, 2, 8.35), (16.665, 2, 16.66), (1.045, 2, 1.04),
    (2.5, 0, 2.0), (3.5, 0, 4.0), (99.75, 1, 99.8), (16.25, 2, 16.25),
])
def test_half_even_rounding(spark, x, k, want):
    assert _one(spark, lambda c: rint_k(c, k), x, "double") == want


@pytest.mark.parametrize("d,want", [
    (1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"),
    (21, "21st"), (22, "22nd"), (23, "23rd"), (31, "31st"), (111, "111st"), (2025, "2025th"),
])
def test_ordinal(spark, d, want):
    assert _one(spark, ordinal, d, "int") == want


@pytest.mark.parametrize("s,want", [
    ("01-01-2025", "1st"), ("22-02-2025", "22nd"), ("2025-01-01", "2025th"),
    ("20250101", "20250101"), ("x-01-2025", None), (None, None),
])
def test_day_label(spark, s, want):
    assert _one(spark, day_label, s, "string") == want


@pytest.mark.parametrize("n,text,want", [
    (15, "a" * 15, "a" * 15), (15, "a" * 16, "a" * 15 + "..."),
    (30, "b" * 30, "b" * 30), (30, "b" * 31, "b" * 30 + "..."),
])
def test_ellipsis(spark, n, text, want):
    assert _one(spark, lambda c: ellipsis(c, n), text, "string") == want


@pytest.mark.parametrize("s,ok", [
    ("1-1-2025", True), ("01-01-2025", True), ("31-01-2025", True), ("29-02-2024", True),
    ("31-02-2025", False), ("01-01-25", False), ("2025-01-01", False), ("01/01/2025", False),
    ("001-01-2025", False), ("01-01-2025 ", False), (" 01-01-2025", False), ("01-01-0000", False),
    (None, False), ("", False),
])
def test_parse_dmy(spark, s, ok):
    assert (_one(spark, parse_dmy, s, "string") is not None) == ok


def test_parse_dmy_value(spark):
    import datetime
    assert _one(spark, parse_dmy, "5-3-2025", "string") == datetime.date(2025, 3, 5)


@pytest.mark.parametrize("name,hit", [
    ("4_orders.csv", False),
    ("4_orders_v2.csv", False),
    ("4_orders_march_2025.csv", True),
    ("5_orders.csv", False),
    ("7_orders_2025.csv", True),
    (".hidden_2025.csv", False),
    ("a_1.CSV", False),
])
def test_upload_glob(name, hit):
    assert bool(re.match(glob_to_regex("*_[0-9]*.csv"), name)) == hit


@pytest.mark.parametrize("text,want", [
    ("Portable Electronic Scale", "Electronics"), ("USB cable", "Accessories"),
    ("Headphone stand", "Accessories"), ("Reading Lamp Slate", "General"), (None, "General"),
])
def test_sku_class(spark, text, want):
    assert _one(spark, sku_class, text, "string") == want


def test_secure_filename(spark):
    assert _one(spark, secure_filename, "4_my orders (jan).csv", "string") == "4_my_orders_jan.csv"
    assert _one(spark, secure_filename, "../../etc/passwd", "string") == "etc_passwd"
