"""Vector code compression with per-dimension value dictionaries.

Vectors become integers (``floor(4096 x)``), are cut into 8 parts, and each part
is coded by the nearest of 16 entries of its part's codebook; codebooks are
refined in 6 rounds of integer means.

Components repeat: a dimension has few distinct integers for the number of its
vectors.  So vectors are held in blocks, and a block holds, for each dimension,
a dictionary of its distinct integers and one small code a vector that points
into it.  An assignment tabulates the squared differences of every distinct
integer of a dimension to that dimension of all 16 entries; the distance of a
vector's part is then the sum of one gathered table row for each dimension.  No
difference is computed twice for a value, sums are exact in 64 bits, and a block
is the unit of work: dictionaries and tables never hold more than its vectors.

Blocks are written once to the shared checkpoint folder and read in every round,
so a lost executor costs the blocks it was reading.  A round sends at most one
count and one sum vector for each entry from a task; what reaches the driver is
the codebook (parts x entries x width numbers).

Cases: rows whose vector is null, has a null or non-finite component or whose
length is not a positive multiple of 8 are left out, and so are those of another
length than the first kept ``vec_id`` has.  Null ids come after all others, equal
ids in order of their vectors.  With fewer than 16 vectors a codebook has as many
entries.  Repeated rows each count.  Integers are held at a bound that keeps
distances within 64 bits (about 1.9e8 for 64 dimensions, components of 46,000);
vectors of unit scale are far below.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orderlens.llm._common import small_batches
from orderlens.session import ensure_checkpoint_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of one block; at most 2^16 vectors, so that codes have 16 bits.
BLOCK_VALUES, BLOCK_ROWS = 1 << 20, 1 << 16
#: Copies of the summed labels, over which the rows of one label are dealt.
SALTS = 16


def _bound(dim: int) -> int:
    """Largest integer whose squared differences, summed over ``dim``, fit."""
    return math.isqrt((1 << 63) // dim - 1) // 2 - 1


def integers(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """``vec_id, label, q`` (integers) of the vectors that take part, and their
    dimension (0 if there are none)."""
    x = F.col("embedding").cast("array<double>")
    whole = vectors.select("vec_id", "label", x.alias("x")).filter(
        F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    first = whole.select("vec_id", F.size("x").alias("dim")).orderBy(F.asc_nulls_last("vec_id"), "dim").limit(1).collect()
    if not first:
        return whole.select("vec_id", "label", F.col("x").cast("array<bigint>").alias("q")), 0
    dim, far = first[0].dim, float(_bound(first[0].dim))
    held = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(far)), F.lit(-far))).cast("long"))
    return whole.filter(F.size("x") == dim).select("vec_id", "label", held.alias("q")), dim


def _encode(q: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Dictionary sizes, dictionaries and codes of a block, dimension by dimension."""
    sizes, values, codes = [], [], []
    for column in q.T:
        distinct, code = np.unique(column, return_inverse=True)
        sizes.append(len(distinct))
        values.append(distinct)
        codes.append(code.astype(np.uint16))
    return np.array(sizes, np.int32).tobytes(), np.concatenate(values).tobytes(), np.concatenate(codes).tobytes()


def _decode(sizes: bytes, values: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries, and codes of shape (dimension, vector)."""
    n = np.frombuffer(sizes, np.int32)
    return np.split(np.frombuffer(values, np.int64), np.cumsum(n)[:-1]), np.frombuffer(codes, np.uint16).reshape(len(n), -1)


def assign(dictionaries: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (parts, vectors), ties to the lower index, and
    the squared distance of each vector summed over its parts.  ``books`` has
    shape (parts, entries, width)."""
    parts, entries, width = books.shape
    chosen = np.empty((parts, codes.shape[1]), np.int64)
    error = np.zeros(codes.shape[1], np.int64)
    for p in range(parts):
        distance = np.zeros((codes.shape[1], entries), np.int64)
        for i in range(width):
            d = p * width + i
            table = (dictionaries[d][:, None] - books[p, :, i][None, :]) ** 2
            distance += table[codes[d]]
        chosen[p] = distance.argmin(1)
        error += distance[np.arange(len(error)), chosen[p]]
    return chosen, error


def _sums(dictionaries: list[np.ndarray], codes: np.ndarray, chosen: np.ndarray, books: np.ndarray, total: np.ndarray) -> None:
    """Add count and component sums of each entry's vectors to ``total``
    (parts, entries, 1 + width)."""
    parts, entries, width = books.shape
    for p in range(parts):
        total[p, :, 0] += np.bincount(chosen[p], minlength=entries)
        for i in range(width):
            d = p * width + i
            # how often each distinct integer went to each entry, times itself
            met = np.bincount(codes[d].astype(np.int64) * entries + chosen[p], minlength=len(dictionaries[d]) * entries).reshape(-1, entries)
            total[p, :, 1 + i] += (met * dictionaries[d][:, None]).sum(0)


def blocks(spark: SparkSession, rows: DataFrame, dim: int) -> DataFrame:
    """``ids, labels, sizes, codes, values``: vectors packed where they are."""
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // dim))
    label = rows.schema["label"].dataType
    ddl = f"ids array<bigint>, labels array<{label.simpleString()}>, sizes binary, dictionaries binary, codes binary"
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(to_arrow_type(label))), ("sizes", pa.binary()), ("dictionaries", pa.binary()), ("codes", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            q = table["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            return pa.RecordBatch.from_arrays([pa.array([table["vec_id"].to_pylist()], schema[0].type), pa.array([table["label"].to_pylist()], schema[1].type),
                                               *[pa.array([x], pa.binary()) for x in _encode(q)]], schema=schema)

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= most:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, most))
                held, n = table.slice(most).to_batches(), n - most
        if n:
            yield block(pa.Table.from_batches(held))

    ensure_checkpoint_dir(spark)
    return rows.select("vec_id", "label", "q").mapInArrow(pack, ddl).checkpoint()


def _each(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for sizes, values, codes, i in zip(b["sizes"].to_pylist(), b["dictionaries"].to_pylist(), b["codes"].to_pylist(), range(b.num_rows), strict=True):
            yield *_decode(sizes, values, codes), b, i


def refine(packed: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of the parts nearest them."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for dictionaries, codes, _, _ in _each(batches):
            chosen, _ = assign(dictionaries, codes, books)
            _sums(dictionaries, codes, chosen, books, total)
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "sums": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    task = packed.select("sizes", "dictionaries", "codes").mapInArrow(sums, "part int, entry int, sums array<bigint>")
    summed = task.select("part", "entry", F.posexplode("sums").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("x").alias("x"))
    total = np.zeros((parts, entries, 1 + width), np.int64)
    for r in summed.collect():  # parts x entries x (1 + width) rows, at most
        total[r.part, r.entry, r.pos] = r.x
    used = total[:, :, 0] > 0
    out = books.copy()
    out[used] = total[used][:, 1:] // total[used][:, :1]
    return out


def first_books(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks of the parts of the smallest ids."""
    q = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    return np.array([r.q for r in q], np.int64).reshape(len(q), parts, dim // parts).transpose(1, 0, 2).copy()


def fit(packed: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        books = refine(packed, books)
    return books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(packed: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every packed vector."""
    label = packed.schema["labels"].dataType.elementType
    parts = books.shape[0]
    schema = pa.schema([("vec_id", pa.int64()), ("label", to_arrow_type(label)), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dictionaries, codes, b, i in _each(batches):
            chosen, error = assign(dictionaries, codes, books)
            text = chosen.T.astype(np.uint8).tobytes().hex()
            step = 2 * parts
            yield pa.RecordBatch.from_arrays([b["ids"][i].values, b["labels"][i].values, pa.array([text[k:k + step] for k in range(0, len(text), step)], pa.string()), pa.array(error)], schema=schema)

    return packed.mapInArrow(run, f"vec_id bigint, label {label.simpleString()}, code string, error bigint")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, their errors summed over equal labels (nulls
    together).  The sums are joined in copies, so that the rows of a label that
    most rows have are spread over tasks."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select("label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int")).alias("l")
    same = F.col("l.label").eqNullSafe(F.col("r.label")) & (F.col("l.salt") == F.col("r.salt"))
    return salted.join(sums.alias("r"), same).select(*[F.col(f"l.{c}") for c in rows.columns], "label_error")


def compress(spark: SparkSession, vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector."""
    small_batches(spark)
    out = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    rows, dim = integers(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding"))
    if not dim:
        return spark.createDataFrame([], out)
    packed = blocks(spark, rows, dim)
    books = fit(packed, first_books(rows, dim), rounds)
    return with_label_error(coded(packed, books)).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of :func:`compress`: the rounds written out, distances plainly."""
    distance = "list_sum(list_transform(list_zip(s.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    sql = [f"""
WITH q AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // {parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS v FROM q, (SELECT range AS p FROM range({parts}))),
c0 AS MATERIALIZED (SELECT p, e, v FROM s JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM q) USING (vec_id) WHERE e < {entries})"""]
    for k in range(rounds + 1):
        sql.append(f"""
a{k} AS MATERIALIZED (
  SELECT s.vec_id, any_value(s.label) AS label, s.p, any_value(s.v) AS v, min({{'d': CAST({distance} AS BIGINT), 'e': c.e}}) AS best
  FROM s JOIN c{k} c USING (p) GROUP BY s.vec_id, s.p)""")
        if k < rounds:
            sql.append(f"""
m{k} AS (SELECT p, e, list(floored ORDER BY i) AS v FROM (
  SELECT p, e, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS floored
  FROM (SELECT p, best.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, e))""")
    return ",".join(sql) + f""",
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM r
"""
