"""Nearest neighbours by largest inner product with multiprobe p-stable hashing.

Inner product becomes distance by one more coordinate: with M the largest
norm, a vector x is extended by ``sqrt(M^2 - |x|^2)`` and a query by 0; the
nearest extended vector then has the largest inner product.  Each of TABLES
tables hashes an extended vector to a cell of k numbers
``floor((a.x + b) / w)`` with Gaussian a.  A query visits its own cell and the
cells around it in the order of their estimated chance to hold a neighbour
(the Gaussian mass of each cell around the query's projections at the
distance of a neighbour).  How many cells are visited is set so that the
neighbours of PROBE_QUERIES sample queries, found exactly, would be found at
TARGET recall; all rows are indexed and all candidates of visited cells are
scored exactly in double precision.

Equal vectors are indexed once; a class carries its 21 smallest ids, enough
for any query (copies tie, and ties go to the smaller id).  Cells are laid out
in blocks of bounded size on both sides, so that no group grows with the data.
Queries that find fewer candidates than asked visit every cell.

Cases: vectors that are null, zero, or hold null or non-finite parts, and rows
of null id, take no part; of several rows with one id the smallest vector
counts; vectors of another length than the most frequent one (the shorter, if
equal) take no part; with fewer candidates than k, all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm._common import batch
from orderlens.session import ensure_checkpoint_dir

TABLES = 2
TARGET = 0.97
#: Queries whose exact neighbours set the number of visited cells.
PROBE_QUERIES = 128
#: Vectors aimed at in a cell, and vectors or queries aimed at in a block.
CELL, BLOCK = 1500, 16384
SEED = 20240607


class Hashing:
    """The hash functions: fixed Gaussian directions, width of a cell."""

    def __init__(self, dim: int, norm: float, rows: int, distance: float = 0.0):
        self.k = max(1, min(6, math.ceil(math.log(max(1.0, rows / CELL)) / math.log(4))))
        rng = np.random.default_rng(SEED)
        self.a = rng.standard_normal((TABLES, self.k, dim + 1))
        self.norm, self.w = norm, norm
        self.b = rng.uniform(0, self.w, (TABLES, self.k))
        self.distance = distance or norm

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, k) projections in widths of a cell."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - np.einsum("ij,ij->i", x, x)))
        z = np.concatenate([x, last[:, None]], axis=1)
        return (np.einsum("nd,tkd->ntk", z, self.a) + self.b) / self.w

    def cells(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.floor(self.project(x, query)).astype(np.int64)

    def offsets(self) -> np.ndarray:
        side = np.arange(-3, 4) if self.k <= 4 else np.arange(-2, 3)
        return np.stack(np.meshgrid(*[side] * self.k, indexing="ij"), -1).reshape(-1, self.k)

    def probes(self, x: np.ndarray):
        """(rows, tables, offsets) estimated log chance of each perturbed cell."""
        p = self.project(x, True)
        inside = p - np.floor(p)
        offsets = self.offsets()
        side = np.unique(offsets)
        sd = self.distance / self.w
        mass = np.log(_phi((side + 1 - inside[..., None]) / sd) - _phi((side - inside[..., None]) / sd) + 1e-12)  # n, t, k, side
        at = offsets - side[0]
        return sum(mass[:, :, j, at[:, j]] for j in range(self.k))


def _phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function (logistic form; it only orders cells)."""
    return 1 / (1 + np.exp(-1.5976 * x - 0.07056 * x**3))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """(name, vec as the bytes of its doubles)."""
    def run(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = len(flat) // len(b) if len(b) else 0
            yield batch(schema, b.column(0), [flat[i * size:(i + 1) * size].tobytes() for i in range(len(b))])
    schema = pa.schema([(name, pa.int64()), ("vec", pa.binary())])
    return rows.mapInArrow(run, f"{name} long, vec binary")


def _cell_rows(rows: DataFrame, hashing: Hashing) -> DataFrame:
    """(tab, cell, cid, vec): the cell of each vector in each table."""
    schema = pa.schema([("tab", pa.int32()), ("cell", pa.string()), ("cid", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            if len(b):
                own = hashing.cells(_matrix(b.column(1)))
                for t in range(TABLES):
                    yield batch(schema, [t] * len(b), [",".join(map(str, c)) for c in own[:, t].tolist()], b.column(0), b.column(1))
    return rows.mapInArrow(run, "tab int, cell string, cid long, vec binary")


def _probe_rows(queries: DataFrame, hashing: Hashing, visits: int) -> DataFrame:
    """(tab, cell, query): the cells that each query visits, likeliest first."""
    schema = pa.schema([("tab", pa.int32()), ("cell", pa.string()), ("query", pa.int64())])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(1))
            own, chance = hashing.cells(x, True), hashing.probes(x)
            for t in range(TABLES):
                rank = np.argsort(-chance[:, t], axis=1, kind="stable")[:, :visits]
                at = own[:, None, t] + hashing.offsets()[rank]
                cell = [",".join(map(str, c)) for c in at.reshape(-1, hashing.k).tolist()]
                yield batch(schema, [t] * len(cell), cell, b.column(0).take(pa.array(np.repeat(np.arange(len(b)), at.shape[1]))))
    return queries.mapInArrow(run, "tab int, cell string, query long")


def _blocks(vectors: DataFrame, probes: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` vectors of visited cells for each query and block, as
    (query, cid, score).

    A table's cells, in order, are laid out in blocks of about BLOCK vectors; a
    cell that crosses a border is dealt to both sides by hash.  Queries of a
    block are cut into groups of about BLOCK.
    """
    cells = vectors.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tab").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    laid = cells.withColumn("before", before).select("tab", "cell", F.floor(F.col("before") / BLOCK).cast("int").alias("first"),
                                                     F.floor((F.col("before") + F.col("n") - 1) / BLOCK).cast("int").alias("last"))
    asked = probes.join(laid, ["tab", "cell"]).select("tab", F.explode(F.sequence("first", "last")).alias("block"), "query", "cell").groupBy("tab", "block", "query").agg(
        F.collect_set("cell").alias("cells"))
    groups = asked.groupBy("tab", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups"))
    q = (asked.join(groups, ["tab", "block"]).join(queries, "query")
         .select("tab", "block", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int").alias("g"), "query", "vec", "cells").groupBy("tab", "block", "g"))
    v = (vectors.join(laid, ["tab", "cell"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("cid"), F.col("last") - F.col("first") + 1)).cast("int"))
         .join(groups, ["tab", "block"]).select("tab", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "cid", "vec", "cell").groupBy("tab", "block", "g"))
    schema = pa.schema([("query", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        x, y = _matrix(left["vec"].combine_chunks()), _matrix(right["vec"].combine_chunks())
        ids, asked = left["cid"].to_numpy(), right["query"].to_numpy()
        names, cell = np.unique(np.array(left["cell"].to_pylist()), return_inverse=True)
        number = {c: i for i, c in enumerate(names.tolist())}
        visits = right["cells"].to_pylist()
        out = []
        for i in range(0, len(y), 256):
            visited = np.zeros((len(y[i:i + 256]), len(names)), bool)
            for row, cells in enumerate(visits[i:i + 256]):
                visited[row, [number[c] for c in cells if c in number]] = True
            s = np.where(visited[:, cell], y[i:i + 256] @ x.T, -np.inf)
            top = _top(s, min(keep, s.shape[1]))
            score = np.take_along_axis(s, top, 1)
            real = np.isfinite(score)
            out.append((np.broadcast_to(asked[i:i + 256, None], top.shape)[real], ids[top][real], score[real]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return v.cogroup(q).applyInArrow(run, "query long, cid long, score double")


def _top(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest entries of each row, in any order."""
    return np.argpartition(-s, keep - 1, axis=1)[:, :keep]


def _best(rows: DataFrame, keep: int, key: str = "query", ident: str = "cid") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), ident)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def _exact(reps: DataFrame, x: np.ndarray, hashing: Hashing, keep: int) -> DataFrame:
    """Exact neighbours of a few vectors by one pass: (q, cid, score, cells)."""
    schema = pa.schema([("q", pa.int32()), ("cid", pa.int64()), ("score", pa.float64()), ("cells", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            y = _matrix(b.column(1))
            s = x @ y.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :keep]
            cells = hashing.cells(y).reshape(len(y), -1)[top.ravel()].tolist()
            yield batch(schema, np.repeat(np.arange(len(x)), top.shape[1]).tolist(), b.column(0).take(pa.array(top.ravel())), np.take_along_axis(s, top, 1).ravel().tolist(), cells)
    return _best(reps.mapInArrow(run, "q int, cid long, score double, cells array<long>"), keep, "q")


def _visits(hashing: Hashing, x: np.ndarray, found: list) -> int:
    """Cells to visit in each table for TARGET recall of exact neighbours."""
    offsets = {tuple(o): i for i, o in enumerate(hashing.offsets().tolist())}
    rank = np.argsort(np.argsort(-hashing.probes(x), axis=2, kind="stable"), axis=2)
    own = hashing.cells(x, True)
    need = []
    for r in found:
        cells = np.array(r["cells"]).reshape(TABLES, hashing.k)
        at = [offsets.get(tuple((cells[t] - own[r["q"], t]).tolist())) for t in range(TABLES)]
        need.append(min([int(rank[r["q"], t, a]) + 1 for t, a in enumerate(at) if a is not None], default=len(offsets)))
    need.sort()
    return need[min(len(need) - 1, math.ceil(TARGET * len(need)) - 1)] if need else 1


def nearest(spark: SparkSession, embeddings: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row
    for which the condition ``is_query`` on column ``vec_id`` holds."""
    ensure_checkpoint_dir(spark)
    keep = k + 1
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        "vec_id is not null and vec is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vec, x -> x <> 0)")
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out)
    dim = int(dims["dim"])
    rows = rows.filter(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("n") <= keep)
    heads = rows.groupBy("vec").agg(F.min("vec_id").alias("cid"))
    members = ranked.join(heads, "vec").select("cid", "vec_id")
    asked = rows.filter(is_query).join(heads, "vec").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query"))
    reps = _packed(heads.select("cid", "vec"), "cid").checkpoint()
    stats = heads.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    asked = asked.checkpoint()
    queries = reps.join(asked.select(F.col("query").alias("cid")).distinct(), "cid").select(F.col("cid").alias("query"), "vec")
    sample = queries.orderBy(F.xxhash64("query"), "query").limit(PROBE_QUERIES).collect()
    if not sample:
        return spark.createDataFrame([], out)
    hashing = Hashing(dim, math.sqrt(stats[1]) * (1 + 1e-9), stats[0])
    x = np.stack([np.frombuffer(r["vec"], dtype=np.float64) for r in sample])
    exact = _exact(reps, x, hashing, keep).collect()
    far = [math.sqrt(max(0.0, hashing.norm**2 + float(x[r["q"]] @ x[r["q"]]) - 2 * r["score"])) for r in exact]
    hashing.distance = max(1e-6 * hashing.norm, float(np.median(far)))
    visits = _visits(hashing, x, exact)
    cells = _cell_rows(reps, hashing)
    # classes of queries, by the exact scores of visited cells
    found = _best(_blocks(cells, _probe_rows(queries, hashing, visits), queries, keep).dropDuplicates(["query", "cid"]), keep).select("query", "cid").checkpoint()
    # queries that found too few visit every cell of the first table
    few = queries.join(found.groupBy("query").count().filter(F.col("count") >= min(keep, stats[0])), "query", "left_anti")
    first = cells.filter("tab = 0")
    every = first.select("tab", "cell").distinct()
    rest = _best(_blocks(first, few.select(F.lit(0).alias("tab"), "query").join(every, "tab"), few, keep), keep).select("query", "cid") if few.take(1) else found.limit(0)
    found = found.join(few, "query", "left_anti").unionByName(rest)
    # exact scores of the original vectors, in order of their parts
    vec = heads.select("cid", "vec")
    scored = found.join(vec, "cid").join(vec.select(F.col("cid").alias("query"), F.col("vec").alias("qvec")), "query").select(
        "query", "cid", F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p).alias("score"))
    classes = _best(scored.join(members, "cid"), keep, "query", "vec_id").drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(classes, "query").filter(F.col("query_id") != F.col("vec_id"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
