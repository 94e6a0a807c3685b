"""Filter interaction audit by recursive enumeration of filter orders.

What a filter removes depends on what ran before it.  Each document is reduced
to the set of filters that it fails, a bit mask; documents of one part (source)
and mask are counted into a cell.  A recursive query then extends filter
prefixes with the letters not used yet, starting from the empty prefix and the
masks, and carries the bits applied so far: each recursion level says what its
last filter does to each mask (keeps it, removes it, comes too late, fails it
alone).  Joined with the counts of the cells, every prefix gives its step's
figures for every part at once; an order's five steps are its five prefixes, so
325 prefixes serve all 600 steps of the 120 orders.

The recursion runs over masks and letters alone: 32 masks and 326 prefixes,
whatever the data, so it and its broadcast are bounded, and Spark's bound on
recursed rows is not met.  Parts come in by one join of counted cells.  Texts
are read once, where they lie; what is shuffled of a document is its id, part,
mask and a digest of its text.

Filters (a document fails if it holds): A under 200 words; B fewer distinct
words than half its words; C more than 2 % of its code points in ``[A-Z]``;
D any of ``#$%&*|``; E its text is that of a smaller ``doc_id`` anywhere in the
table.  Words are maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive.

Cases: a null text is empty (and a copy of other empty texts), a null source is
the part ''; a null ``doc_id`` neither fails E nor makes others fail it, and has
no labels; rows of one id and text are all first or all copies; a document is
good or toxic if any of its label rows says so.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.session import ensure_checkpoint_dir

LETTERS = "ABCDE"
#: Thresholds of the filters A, B, C, and the characters of D.
FEWEST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, "#$%&*|"
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _bits(fails: dict[str, Column], letters: str = LETTERS) -> Column:
    mask = F.lit(0)
    for i, c in enumerate(letters):
        if c in fails:
            mask = mask + F.when(fails[c], 1 << i).otherwise(0)
    return mask.cast("int")


def text_marks(docs: DataFrame) -> DataFrame:
    """doc_id, part, the bits of the filters A to D and a digest of the text."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole.alias("text"),
                       F.filter(F.split(whole, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"))
    sized = read.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = {
        "A": F.col("n") < FEWEST_WORDS,
        "B": 100 * F.col("different").cast("long") < DISTINCT_PERCENT * F.col("n").cast("long"),
        "C": 100 * upper.cast("long") > UPPER_PERCENT * F.length("text").cast("long"),
        "D": F.col("text").rlike(f"[{SYMBOLS}]"),
    }
    return sized.select("doc_id", "part", _bits(fails).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part and mask: ``n``, ``good``, ``toxic``.

    Equal rows are counted before anything is joined, and the join that finds a
    text's first id goes by text and id, so a text with a third of all rows is
    spread over the tasks of its ids.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    keys = ["digest", "doc_id", "part", "mask"]
    rows = text_marks(docs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    known = rows.join(first, ["digest", "doc_id"], "left").join(says, "doc_id", "left")
    return known.groupBy("part", (F.col("mask") + copy).cast("int").alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _walk_sql(letters: str, masks: str) -> str:
    """The recursion, in SQL that Spark and DuckDB share; ``masks`` is a relation
    of one column ``mask`` with every mask."""
    listed = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    return f"""
  letters (letter, bit) AS (SELECT * FROM (VALUES {listed}) AS v (letter, bit)),
  walk (prefix, step, letter, mask, applied, kept, removed, redundant, alone) AS (
    SELECT '', 0, '', mask, 0, 1, 0, 0, 0 FROM {masks}
    UNION ALL
    SELECT concat(w.prefix, l.letter), w.step + 1, l.letter, w.mask, w.applied | l.bit,
      CASE WHEN w.mask & (w.applied | l.bit) = 0 THEN 1 ELSE 0 END,
      CASE WHEN w.mask & l.bit <> 0 AND w.mask & w.applied = 0 THEN 1 ELSE 0 END,
      CASE WHEN w.mask & l.bit <> 0 AND w.mask & w.applied <> 0 THEN 1 ELSE 0 END,
      CASE WHEN w.mask = l.bit THEN 1 ELSE 0 END
    FROM walk w JOIN letters l ON w.applied & l.bit = 0)"""


def walk(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """What the last filter of every prefix does to every mask."""
    masks = f"(SELECT CAST(id AS INT) AS mask FROM range({1 << len(letters)}))"
    return spark.sql(f"WITH RECURSIVE {_walk_sql(letters, masks)} SELECT * FROM walk WHERE step > 0")


def audit(spark: SparkSession, counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The figures of every step of every order of ``letters`` for each part of
    cells (part, mask, n, good, toxic)."""
    ensure_checkpoint_dir(spark)
    # a mask and a prefix each, whatever the data: 10,400 rows for five filters
    steps = walk(spark, letters).checkpoint()
    # orders that go on from a prefix of k letters: (letters - k)!
    weight = F.factorial(F.lit(len(letters)) - F.col("step"))
    met = counted.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("kept", "removed", "redundant")], F.sum(F.col("n") * F.col("alone")).alias("unique_fails"),
        *[F.sum(F.col(c) * F.col("removed")).alias(f"{c}_lost") for c in ("good", "toxic")])
    # a window holds the prefixes that end with one letter: 65 rows of a part
    met = met.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "letter")))
    orders = steps.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    places = places.select("filter_order", F.col("step").cast("int").alias("step"), F.expr("substring(filter_order, 1, step)").alias("prefix"))
    return met.drop("step").join(F.broadcast(places), "prefix").select("part", "filter_order", "step", *METRICS, "shapley")


def interactions(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over whole documents, by source."""
    return audit(spark, cells(docs, labels))


_SPLIT = "list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH RECURSIVE {_walk_sql(LETTERS, "(SELECT range AS mask FROM range(32))")},
docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT *, {_SPLIT} AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
marked AS (
  SELECT part, doc_id, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[{SYMBOLS}]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM sized),
says AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM marked LEFT JOIN says USING (doc_id) GROUP BY part, mask),
met AS (
  SELECT part, prefix, step, letter, sum(n * kept) AS kept, sum(n * removed) AS removed, sum(n * redundant) AS redundant, sum(n * alone) AS unique_fails,
    sum(good * removed) AS good_lost, sum(toxic * removed) AS toxic_lost
  FROM cells JOIN walk USING (mask) WHERE step > 0 GROUP BY ALL),
orders AS (SELECT DISTINCT prefix AS filter_order FROM walk WHERE step = 5),
every AS (
  SELECT part, filter_order, m.step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost
  FROM orders JOIN met m ON m.prefix = substring(filter_order, 1, m.step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in METRICS)},
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM every
"""
