"""Every operator on nulls in any column, empty and very long texts, repeated
rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from orderlens.llm import ann, bpe, chat, decontam, jaccard_join, lm, pii, quality, secret_scan, toxicity

CLASH = ["score", "row", "key", "class", "bucket", "start", "end", "kind", "text_", "n", "root", "vec", "match", "label"]
LONG = "long words in a very long text with a.b@c.de and 4111111111111111 " * 4000
ROWS = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "one two three four five six eight"),
        (None, None), (4, LONG), (5, "   \n\t "), (6, "x" * 30_000), (7, "é ü 日本 " * 40), (8, 'api_key = "0123456789abcdef0123456789abcdef01234567"'), (9, "idiot you idiot moron"),
        (10, "word " * 50)]


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id long, text string")).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def labels(spark):
    return clashing(spark.createDataFrame([(1, 1, 0), (9, 0, 1), (9, 0, 1), (3, 1, 0), (None, 1, 1), (4, None, None), (10, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return clashing(spark.createDataFrame([(1, "ONE two  three four five six seven"), (2, None), (3, ""), (None, "no such item anywhere at all"), (4, "word")], "item_id long, text string"))


RUN = {
    "toxicity": lambda s, d, x, b: toxicity.toxicity(s, d, x),
    "pii": lambda s, d, x, b: pii.digests(s, d),
    "sanitise": lambda s, d, x, b: pii.sanitise(s, d),
    "secrets": lambda s, d, x, b: secret_scan.scan(s, d),
    "lm": lambda s, d, x, b: lm.score(s, d),
    "jaccard": lambda s, d, x, b: jaccard_join.join(s, d),
    "decontam": lambda s, d, x, b: decontam.contaminated(s, d, b),
    "bpe": lambda s, d, x, b: bpe.bpe(s, d),
    "quality": lambda s, d, x, b: quality.resample(s, d, x, 0.5),
}
PER_ROW = {"toxicity", "pii", "sanitise", "lm", "jaccard", "bpe"}


@pytest.fixture(scope="module", autouse=True)
def short_training():
    steps, lm.STEPS = lm.STEPS, 5
    yield
    lm.STEPS = steps


@pytest.mark.parametrize("name", sorted(RUN))
def test_odd_rows(spark, docs, labels, benchmark, name):
    got = RUN[name](spark, docs, labels, benchmark).collect()
    if name in PER_ROW:
        ids = lambda rows: sorted(str(r[0]) for r in rows)
        assert ids([(r["doc_id"],) for r in got]) == ids(ROWS)


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_tables(spark, docs, labels, benchmark, name):
    assert RUN[name](spark, docs.limit(0), labels.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality", "decontam"])
def test_nothing_to_learn_from_or_look_for(spark, docs, labels, benchmark, name):
    assert RUN[name](spark, docs, labels.limit(0), benchmark.limit(0)).count() == {"toxicity": len(ROWS), "decontam": 0}.get(name, RUN[name](spark, docs, labels.limit(0), benchmark).count())


def test_all_values_null(spark):
    none = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    lab = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    for name in sorted(PER_ROW):
        assert RUN[name](spark, none, lab, None).count() == 3, name


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (20, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [0.9, 0.1])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(spark, df, "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert ann.nearest(spark, df.limit(0), "vec_id % 20 = 0").count() == 0
    assert ann.nearest(spark, df.filter("vec_id = 3"), "vec_id % 20 = 0").count() == 0


def test_turns(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, None, None, None), (2, 1, "tool]", "[/ROLE]"), (2, 0, "assistant", "")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r.n_turns for r in chat.chat_digests(spark, df).collect()}
    assert got == {1: 3, None: 1, 2: 2, -1: 2}
    assert {r.conv_id for r in chat.chat_digests(spark, df.limit(0)).collect()} == {-1}
