"""Vector codes, filter audit and sharding against brute force, and on odd rows."""

import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import filter_audit, sharding, vector_codes
from orderlens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CLASH = ["score", "row", "n", "q", "part", "mask", "prefix", "step", "words", "salt", "code", "error", "first", "x", "dim", "__place", "__rows"]


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit", "op13_sharding"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    key = lambda rows: sorted(tuple(str(r[c]) for c in cols) for r in rows)
    assert key(r.asDict() for r in got.collect()) == key(dict(zip(rel.columns, r)) for r in rel.fetchall())


# --- vector codes -------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The same by differences, one vector at a time."""
    kept = sorted((i, [int(np.floor(np.float64(x) * 4096)) for x in v], y) for i, v, y in rows)
    w = len(kept[0][1]) // parts
    books = [[list(v[p * w:(p + 1) * w]) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[near(p, v)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * w:(p + 1) * w] for (_, v, _), c in zip(kept, chosen[p]) if c == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for i, v, y in kept:
        best = [near(p, v) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), y))
    return out, np.array(books)


@pytest.mark.parametrize(("n", "dim"), [(400, 16), (7, 8), (40, 64)])
def test_codes_equal_brute_force(spark, n, dim):
    rnd = random.Random(n)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(dim)], rnd.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(n)]  # a large group of copies
    want, books = plain_codes(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in vector_codes.compress(spark, clashing(df)).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == {i: (c, e) for i, c, e, _ in want}
    by = {}
    for _, _, e, y in want:
        by[y] = by.get(y, 0) + e
    assert all(got[i].label_error == by[y] for i, _, _, y in want)
    assert {r.codebooks_sha256 for r in got.values()} == {vector_codes.books_sha256(books)}


def test_blocks_split_a_partition(spark, monkeypatch):
    rows = [(i, [float(i * (k + 1) % 17) for k in range(8)], i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    want = sorted(map(tuple, vector_codes.compress(spark, df).collect()))
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", 8 * 37)
    ints, dim = vector_codes.integers(df)
    assert vector_codes.blocks(spark, ints, dim).count() == 14
    assert sorted(map(tuple, vector_codes.compress(spark, df).collect())) == want


def test_odd_vectors(spark):
    one = [float(i) for i in range(8)]
    rows = [(3, one, 1), (3, one, 1), (None, one, None), (1, None, 1), (2, [*one[:7], None], 1), (4, [*one[:7], float("nan")], 1), (5, [*one[:7], float("inf")], 1),
            (6, [], 1), (7, [1.0], 1), (8, one + one, 1), (9, [3e38] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_codes.compress(spark, clashing(df)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.error) for r in got) == [(False, 3, 0), (False, 3, 0), (False, 9, 0), (True, 0, 0)]
    assert vector_codes.compress(spark, df.limit(0)).count() == 0
    assert vector_codes.compress(spark, df.filter("vec_id = 1")).count() == 0


# --- filter audit -------------------------------------------------------------

def plain_audit(docs, labels):
    says = {}
    for i, q, t in labels:
        g, x = says.get(i, (0, 0))
        says[i] = (max(g, q == 1), max(x, t == 1))
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    marks = []
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        bad = {c for c, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), i is not None and i > texts[t])) if f}
        marks.append((s or "", bad, *(says.get(i, (0, 0)) if i is not None else (0, 0))))
    out, shapley = {}, {}
    for part in {m[0] for m in marks}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [m for m in marks if m[0] == part]
            gone = []
            for k, c in enumerate(order, 1):
                now = [m for m in left if c in m[1]]
                left = [m for m in left if c not in m[1]]
                shapley[part, c] = shapley.get((part, c), 0) + len(now)
                out[part, order, k] = [len(left), len(now), sum(c in m[1] for m in gone), sum(m[0] == part and m[1] == {c} for m in marks), sum(m[2] for m in now), sum(m[3] for m in now)]
                gone += now
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["alpha", "Beta", "gamma", "DELTA", "x#y", "éà", "a" + str(rnd.randrange(400))])
    texts = [rnd.choice([" ", "\n", "\t", "\x0b", " "]).join(word() for _ in range(rnd.choice([0, 3, 150, 250, 600]))) for _ in range(40)]
    docs = [(rnd.choice([None, i, i, i, i // 2]), rnd.choice([None, "", *texts]), rnd.choice([None, "", "a", "a", "b"])) for i in range(300)]
    docs += [(1000 + i, texts[3], "a") for i in range(300)]  # a large group of copies
    labels = [(rnd.choice([None, rnd.randrange(300)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(spark, clashing(d), clashing(x)).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == plain_audit(docs, labels)
    assert len(got) == 600 * 3
    assert filter_audit.interactions(spark, d.limit(0), x).count() == 0
    assert filter_audit.interactions(spark, d, x.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_very_long_and_all_null(spark):
    d = spark.createDataFrame([(1, "Word! " * 400_000, "a"), (None, None, None), (None, None, None)], "doc_id long, text string, source string")
    x = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order[:1]): (r.kept, r.removed) for r in filter_audit.interactions(spark, d, x).filter("step = 1").collect()}
    assert got["a", "B"] == (0, 1) and got["a", "C"] == (0, 1) and got["a", "A"] == (1, 0) and got["", "A"] == (0, 2) and got["", "E"] == (2, 0)


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", m, 1, 0, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    got = filter_audit.audit(spark, cells, "XYZ").collect()
    assert len(got) == 6 * 3 and {r.shapley for r in got} == {14}  # 7 of 8 masks fail, 6 orders, 3 equal letters


# --- sharding -----------------------------------------------------------------

@pytest.mark.parametrize("rows", [1, 2, 3, 16, 17, 1000, 65_537])
@pytest.mark.parametrize("seed", [0, 7])
def test_places_are_a_permutation(rows, seed):
    got = sharding.permuted(np.arange(rows), rows, seed)
    assert sorted(got.tolist()) == list(range(rows))
    for i in range(0, rows, max(1, rows // 50)):
        assert sharding.row_at(int(got[i]) % 16, int(got[i]) // 16, rows, 16, seed) == i


def test_large_row_numbers():
    rows = 10 ** 13 + 7
    some = np.array([0, 1, 12345, rows // 3, rows - 1])
    got = sharding.permuted(some, rows, 3)
    assert len(set(got.tolist())) == 5 and (got < rows).all() and (got >= 0).all()
    assert [sharding.row_at(int(p) % 16, int(p) // 16, rows, 16, 3) for p in got] == some.tolist()


def test_shuffle_is_even():
    """Neighbours go to unrelated places: all pairs of shards of rows in turn."""
    shards = sharding.permuted(np.arange(100_000), 100_000) % 16
    pairs = np.bincount(shards[:-1] * 16 + shards[1:], minlength=256)
    assert abs(pairs - pairs.mean()).max() < 6 * pairs.mean() ** 0.5


@pytest.fixture()
def odd_docs(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, "é" * 5), (3, "x" * 300_000)] + [(7, "copy")] * 500
    return clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("shard", F.lit("mine")).withColumn("_metadata", F.lit(1))


def test_every_row_has_its_slot(spark, tmp_dir, odd_docs):
    path = os.path.join(tmp_dir, "docs")
    odd_docs.repartition(7).write.parquet(path)
    got = sharding.digests(spark, path).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sorted(map(str, sharding.digests(spark, path).repartition(3).collect())) == sorted(map(str, got))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert sorted(map(str, sharding.digests(spark, path).collect())) == sorted(map(str, got))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_rows_and_files(spark, tmp_dir, odd_docs, monkeypatch):
    path, out = os.path.join(tmp_dir, "docs"), os.path.join(tmp_dir, "out")
    odd_docs.repartition(3).write.parquet(path)
    placed = sharding.shard_table(spark, path, 3)
    assert set(odd_docs.columns) <= set(placed.columns) and dict(placed.dtypes)["shard"] == "int"
    monkeypatch.setattr(sharding, "FILE_ROWS", 50)
    sharding.write_shards(spark, path, out, 3)
    files = sorted(os.listdir(os.path.join(out, "shard=1")), key=lambda x: int(x.split("=")[1]))
    assert files == [f"block={b}" for b in range(4)]
    read = [r.row_number for f in files for r in spark.read.parquet(os.path.join(out, "shard=1", f)).coalesce(1).collect()]
    assert read == [sharding.row_at(1, k, 507, 3) for k in range(169)]
    monkeypatch.setattr(sharding, "BROADCAST_FILES", 0)
    assert sorted(map(str, sharding.shard_table(spark, path, 3).collect())) == sorted(map(str, placed.collect()))


def test_empty_table_and_any_frame(spark, tmp_dir, odd_docs):
    assert sharding.shard(spark, odd_docs.limit(0)).count() == 0
    assert sharding.shard(spark, odd_docs.filter("doc_id = 1")).count() == 3
