"""Secret scan with a random forest for false-positive removal, in DataFrame
operations alone (the forest is Spark's own, trained from a DataFrame).

Candidates are runs of 20 or more key characters, shorter values assigned to a
credential's name, and private key blocks (also encrypted ones and those of
PGP).  A name before ``=`` is not part of a run.  The forest sees a candidate's length, class changes between neighbouring
characters, shares of digits and capitals, variety of characters, coverage by
dictionary words, whether it is part of a path, and the words and marks next
to it.  The dictionary holds the WORDS most frequent short words over all
documents.

Labelled findings come as a table (``candidates`` columns and ``label``); the
forest is fitted on at most SAMPLE of each label, those of smallest hash.
Without such a table ``seed_labels`` labels the candidates on which plain
rules agree: values assigned to a credential's name are findings, words and
paths are not.  All candidates of all whole texts are scored.

Cases: null or empty text has no candidates; repeated rows are each reported;
a null id is kept; an empty table, or labels of one kind only, gives no
findings but key blocks; offsets count code points; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm.pii import parts_of
from orderlens.session import ensure_checkpoint_dir

# --- fixed values: candidates and words next to them --------------------------
# a run before = and a value is a name
KEY = r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+(?!=[\"'`]?[A-Za-z0-9+/_-])={0,2}+"
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
# looks back for the name only where something is assigned
SHORT = (r"(?<=[=:>\x20\t\"'`])(?<=[=:>][\x20\t]{0,3}[\"'`]?|(?i:bearer)[\x20\t]{1,3})(?<=(?i:key|token|secret|passw|passwd|pwd|auth|credential|sign)[A-Za-z_-]{0,24}[\"']?[\x20\t]{0,3}(?:=>|=|:)[\x20\t]{0,3}[\"'`]?|(?i:bearer)[\x20\t]{1,3})"
         r"(?![^\s\"'`,;&<>(){}\[\]]*?[A-Za-z0-9+/_-]{20})(?![=:>])[^\s\"'`,;&<>(){}\[\]]{4,}+")
NAMES = r"(?i)(key|token|secret|passw|passwd|pwd|auth|credential|bearer|sign)[A-Za-z_-]*[\"']?\s*(=|:|=>|\s)\s*[\"'`]?$"
EXAMPLES = r"(?i)example|sample|dummy|placeholder|your[_-]|xxxx|changeme"

#: Code points next to a candidate that are looked at.
REACH = 48
#: Words of the dictionary; labelled findings of each label for the fit.
WORDS, SAMPLE = 300, 10_000
TREES, DEPTH, SEED = 24, 7, 11
THRESHOLD = 0.5

FEATURES = ["length", "changes", "digits", "capitals", "variety", "covered", "path", "named", "assigned", "quoted", "example", "hex"]


def dictionary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of 3 to 6 letters, by documents that have them."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z]+"))
    counted = docs.select(F.explode(words).alias("w")).filter(F.length("w").between(3, 6)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(WORDS).collect()]


def candidates(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with its features: (row, doc_id, kind, i, gap, match, ...)."""
    parts = parts_of(docs, id_col, text_col, {"key": KEY, "short": SHORT, "block": BLOCK},
                     {"key": "[A-Za-z0-9+/_-]{20}", "short": "(?i)key|token|secret|passw|pwd|auth|credential|bearer|sign", "block": "-----BEGIN "}, REACH)
    found = parts.filter("match is not null").withColumn("n", F.length("match")).drop("head")
    m, n = F.col("match"), F.col("n")
    share = lambda rx: F.regexp_count(m, F.lit(rx)) / n
    flag = lambda c: c.cast("double")
    cover = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "\\z"
    return found.select(
        "row", "doc_id", "kind", "i", "gap", "n", "match",
        n.cast("double").alias("length"), share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]").alias("changes"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"),
        (F.size(F.array_distinct(F.split(m, ""))) / F.least(n, F.lit(64))).alias("variety"), (1 - F.length(F.regexp_replace(F.lower(m), cover, "")) / n).alias("covered"),
        flag(m.rlike("/[a-z]+/") | F.col("tail").rlike(r"(://|www\.|\.[a-z]{2,4}/|/|\\)$")).alias("path"), flag(F.col("tail").rlike(NAMES)).alias("named"),
        flag(F.col("tail").rlike("[=:]\\s*[\"'`]?$")).alias("assigned"), flag(F.col("tail").rlike("[\"'`]$")).alias("quoted"),
        flag(F.concat("tail", "match").rlike(EXAMPLES)).alias("example"), flag(m.rlike("^[0-9a-fA-F]+$")).alias("hex"))


def seed_labels(found: DataFrame) -> DataFrame:
    """Labelled findings: candidates on which plain rules agree, with ``label``."""
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("variety") > 0.2)
    sure = (F.col("named") == 1) & (F.col("assigned") == 1) & mixed & (F.col("example") == 0) & (F.col("path") == 0)
    never = (F.col("digits") == 0) | (F.col("example") == 1) | (F.col("path") == 1) & (F.col("named") == 0)
    return found.filter("kind <> 'block'").withColumn("label", F.when(sure, 1.0).when(never, 0.0)).filter("label is not null")


def fit(spark: SparkSession, findings: DataFrame):
    """A forest from labelled findings; None without findings of both labels."""
    ensure_checkpoint_dir(spark)
    columns = findings.select("match", *FEATURES, "label")
    order = [F.xxhash64("match"), "match", *FEATURES]
    sample = columns.filter("label = 1").orderBy(*order).limit(SAMPLE).unionByName(columns.filter("label = 0").orderBy(*order).limit(SAMPLE)).checkpoint()
    if sample.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", cacheNodeIds=False)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def scored(found: DataFrame, forest) -> DataFrame:
    """Candidates with ``score``; a key block scores 1."""
    if forest is None:
        return found.withColumn("score", F.when(F.col("kind") == "block", 1.0).otherwise(0.0))
    rated = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return rated.withColumn("score", F.when(F.col("kind") == "block", 1.0).otherwise(vector_to_array("probability")[1]))


def _placed(rated: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, score, match) of accepted candidates."""
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    accepted: Column = F.col("score") >= THRESHOLD
    light = rated.select("row", "doc_id", "kind", "i", "gap", "n", "score", F.when(accepted, F.col("match")).alias("match"))
    return light.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(w)).filter(accepted).select(
        "row", "doc_id", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "score", "match")


def scan(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All findings of all whole texts: (doc_id, kind, start, end, score,
    match_sha256); the secret itself is not shown."""
    found = candidates(docs, dictionary(docs, text_col), id_col, text_col)
    forest = fit(spark, seed_labels(found) if findings is None else findings)
    return _placed(scored(found, forest)).select("doc_id", "kind", "start", "end", "score", F.sha2("match", 256).alias("match_sha256"))


def redacted(spark: SparkSession, docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with each finding replaced by ``[SECRET]``."""
    own = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__h", F.xxhash64(F.col(text_col).cast("string")))
    keyed = own.select(F.struct("__id", "__h").alias("__key"), F.col(text_col).alias("text"))
    found = candidates(keyed.select(F.xxhash64("__key").alias("key"), "text"), dictionary(docs, text_col), "key", "text")
    forest = fit(spark, seed_labels(found) if findings is None else findings)
    spans = _placed(scored(found, forest)).groupBy(F.col("doc_id").alias("__key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__s"))
    text = F.expr(f"""aggregate(__s, struct('' as done, 0L as at), (a, x) -> struct(
        concat(a.done, substr(`{text_col}`, cast(a.at as int) + 1, cast(greatest(x.start - a.at, 0) as int)), case when x.end <= a.at then '' else '[SECRET]' end) as done,
        greatest(a.at, x.end) as at), a -> concat(a.done, substr(`{text_col}`, cast(a.at as int) + 1)))""")
    joined = own.withColumn("__key", F.xxhash64(F.struct("__id", "__h"))).join(spans, "__key", "left")
    return joined.select(*[F.when(F.col("__s").isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])
