"""Helpers shared by the corpus operators: table access, Arrow batches, words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one Arrow batch.  Spark's default of 10,000 rows could hold more
#: than a gigabyte of very long texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read by Spark from any file system."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch for whole texts; a chosen value stays."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def fold_of(column: str, folds: int):
    """``crc32(column as text) mod folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def word_bytes(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` change and split on ASCII alone, which
    is what the rule asks for.
    """
    return text.lower().split()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Strings of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of the given columns (lists or arrays)."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def per_batch(df: DataFrame, fn, ddl: str, schema: pa.Schema) -> DataFrame:
    """``fn(batch) -> columns`` over every Arrow batch of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, *fn(b))
    return df.mapInArrow(run, ddl)
