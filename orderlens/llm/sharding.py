"""Sharding by a Feistel permutation with cycle walking.

Every row of a stored table has a global row number: the rows of the files
before its own (files in order of their paths) plus its place in its file.  A
keyed Feistel network permutes the numbers below 4^b, the least such power that
holds them all; a result beyond the last row number goes through the network
again until it is one (cycle walking), so what comes out is a permutation of
the row numbers themselves.  Row ``i`` becomes place ``p = permuted(i)`` of the
shuffle, in shard ``p mod shards`` at slot ``p div shards``.

* Reproducible and computable: shard and slot of a row follow from its number,
  the number of rows, the shard count and the seed; :func:`row_at` inverts it,
  so a reader can fetch any slot without a table of places.
* Law ``rows``: shards hold equally many rows, at most one apart, and slots have
  no gap, whatever the rows hold.  No key decides, so no hot source, id or group
  of copies can make a shard larger.
* No shuffle: only one count for each file moves.  Texts are read once and stay
  where they are.

The numbers follow the stored order, so the same files give the same shards
whatever the cluster, partition sizes or retries; a table that is written anew
in another order is shuffled anew.  :func:`shard` therefore writes a frame that
is not a stored table once, and numbers that copy.

Cases: a null text has size 1 and CRC 0; rows of null or repeated ids and equal
rows each have a place of their own; an empty table gives no rows.  Columns of
the input named like a result column give way to it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.running import running_before
from orderlens.session import checkpoint_path

SHARDS = 16
SEED = 20240229
ROUNDS = 6
#: Up to so many files the table of their first row numbers is broadcast
#: (some 200 bytes a file); beyond, Spark joins it as it sees fit.
BROADCAST_FILES = 100_000
#: Rows of one file of :func:`write_shards`.
FILE_ROWS = 65_536
RESULT = ["row_number", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]

_MASK32 = np.uint64(0xFFFFFFFF)
#: Multiplier and shift of a well-known 32-bit integer hash; products of two
#: numbers below 2^32 and 2^27 stay below 2^63.
MULTIPLIER, SHIFT = 0x45D9F3B, 16


def mix(x: np.ndarray) -> np.ndarray:
    """32-bit integer hash of each number below 2^32."""
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(SHIFT))) * np.uint64(MULTIPLIER)) & _MASK32
    return x ^ (x >> np.uint64(SHIFT))


def half_bits(rows: int) -> int:
    """Bits of each half, so that 4^bits is at least ``rows``."""
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def round_key(seed: int, k: int) -> int:
    """Key of round ``k``, below 2^32."""
    return int(mix(np.array([(seed + 0x9E3779B9 * (k + 1)) & 0xFFFFFFFF], np.uint64))[0])


def _network(x: np.ndarray, bits: int, seed: int, back: bool = False) -> np.ndarray:
    b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & low
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = np.uint64(round_key(seed, k))
        if back:
            left, right = right ^ (mix(left ^ key) & low), left
        else:
            left, right = right, left ^ (mix(right ^ key) & low)
    return (left << b) | right


def _walk(numbers: np.ndarray, rows: int, seed: int, back: bool) -> np.ndarray:
    bits = half_bits(rows)
    out = _network(numbers.astype(np.uint64), bits, seed, back)
    while (far := out >= rows).any():
        out[far] = _network(out[far], bits, seed, back)
    return out.astype(np.int64)


def permuted(numbers: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """Places of row numbers: a permutation of 0 .. rows - 1."""
    return _walk(numbers, rows, seed, False)


def row_at(shard: int, slot: int, rows: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Global row number that lies in ``slot`` of ``shard``."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < rows):
        raise IndexError("no such slot")
    return int(_walk(np.array([place], np.int64), rows, seed, True)[0])


def numbered(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows of a stored Parquet table with their ``row_number`` and their
    count.  The count of each file comes from file footers."""
    docs = spark.read.parquet(path)
    meta = docs.metadataColumn("_metadata")
    files = running_before(docs.groupBy(meta["file_path"].alias("__file")).agg(F.count(F.lit(1)).alias("__rows")), [], [F.asc("__file")], "__rows", "__first").checkpoint()
    total = files.agg(F.sum("__rows"), F.count(F.lit(1))).first()
    starts = files.select("__file", "__first")
    if total[1] <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    kept = [docs[_quoted(c)] for c in docs.columns if c.lower() not in RESULT]
    met = docs.join(starts, meta["file_path"] == starts["__file"])
    return met.select(*kept, (starts["__first"] + meta["row_index"]).alias("row_number")), total[0] or 0


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shard_table(spark: SparkSession, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of a stored table with ``row_number``, ``shard`` and ``slot``."""
    rows, total = numbered(spark, path)
    return _placed(rows, total, shards, seed)


def _placed(rows: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), total, seed))

    at = place("row_number")
    return rows.withColumns({"shard": (at % shards).cast("int"), "slot": F.call_function("div", at, F.lit(shards))})


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """:func:`shard_table` of any frame, which is written to the shared folder."""
    path = checkpoint_path(spark, f"sharded-{uuid.uuid4().hex}")
    docs.write.parquet(path)
    return shard_table(spark, path, shards, seed)


def write_shards(spark: SparkSession, path: str, out: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The table at ``path`` as files ``out/shard=<s>/block=<b>``: block ``b`` has
    slots ``b * FILE_ROWS`` on, in order, so a shard of any size is written by
    many tasks and its files read in block order are the shuffled rows."""
    placed = shard_table(spark, path, shards, seed).withColumn("block", F.expr(f"slot div {FILE_ROWS}"))
    placed.repartition("shard", "block").sortWithinPartitions("shard", "block", "slot").write.partitionBy("shard", "block").parquet(out)


def digests(spark: SparkSession, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of
    every document of a stored table; only these narrow columns reach Python."""
    rows, total = numbered(spark, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "row_number")
    return _placed(narrow, total, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: a byte's share is linear in its bits, so
    each bit adds its own constant, derived here from the CRC polynomial."""
    terms = "c >> 8"
    for bit in range(8):
        constant = 1 << bit
        for _ in range(8):
            constant = (constant >> 1) ^ (0xEDB88320 if constant & 1 else 0)
        terms = f"xor({terms}, (xor(c, b) >> {bit} & 1) * {constant})"
    listed = f"list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT))"
    return f"xor(list_reduce({listed}, lambda c, b: {terms}), 4294967295)"


def oracle_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB SQL of :func:`digests` for a table of one file, whose scan order
    is the order of its rows."""
    def mixed(x: str) -> str:
        for _ in range(2):
            x = f"(xor({x}, {x} >> {SHIFT}) * {MULTIPLIER} % 4294967296)"
        return f"xor({x}, {x} >> {SHIFT})"

    halves = "x >> bits AS l, x & low AS r"
    step = f"SELECT i, rows, bits, low, n, {halves} FROM walk WHERE n = 0 OR x >= rows"
    for k in range(ROUNDS):
        step = f"SELECT i, rows, bits, low, n, r AS l, xor(l, m & low) AS r FROM (SELECT *, {mixed('z')} AS m FROM (SELECT *, xor(r, {round_key(seed, k)}) AS z FROM ({step})))"
    return f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () - 1 AS i, count(*) OVER () AS rows FROM documents),
sized AS (
  SELECT i, rows, greatest(1, (length(bin(greatest(rows - 1, 1))) + 1) // 2)::BIGINT AS bits FROM numbered),
walk AS (
  SELECT i, rows, bits, (1::BIGINT << bits) - 1 AS low, 0 AS n, i AS x FROM sized
  UNION ALL
  SELECT i, rows, bits, low, n + 1, (l << bits) | r FROM ({step})),
placed AS (SELECT i, x FROM walk WHERE n > 0 AND x < rows)
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, {_crc32_sql("text")} AS text_crc32, 'rows' AS law,
  CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, i AS row_number
FROM numbered JOIN placed USING (i)
"""
