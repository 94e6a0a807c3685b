"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet under the checkpoint
folder and reads again as the next stage's documents.  All but the last return
the columns of ``documents``; the last returns the encoded documents.

Rows that a stage cannot judge stay: null or empty texts are not toxic, have
no shingles, benchmark passages or secrets, and encode to no ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import bpe, decontam, jaccard_join, secret_scan, toxicity
from orderlens.llm._common import fold_of, table
from orderlens.session import checkpoint_path

#: The learned and corpus-wide stages cannot be written in SQL.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(spark, docs, labels, fold_of("doc_id", 3) != 1)
    rated = toxicity.rejected(spark, docs, model)
    return rated.filter(F.col("toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that link by their shingles, the one with the smallest id (a null
    id after all others; of equal ids the one whose text has the smallest hash).

    Rows are numbered and written once, and go by that number, so that rows
    which share their id, or have none, are told apart.  Rows without words
    form no group and stay.
    """
    path = checkpoint_path(spark, f"numbered-{uuid.uuid4().hex}")
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    own = spark.read.parquet(path)
    rows, roots = jaccard_join.links_of(spark, own.select(F.col("__row").alias("doc_id"), "text"))
    rooted = rows.filter("n > 0").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select(F.col("doc_id").alias("__row"), F.coalesce("root", "class").alias("root"))
    many = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = rooted.join(many, "root", "left_semi").checkpoint()
    ids = own.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), "__row").alias("place"))
    first = member.join(ids, "__row").groupBy("root").agg(F.min("place").alias("place")).select("place.__row")
    gone = member.select("__row").join(first, "__row", "left_anti")
    return own.join(gone, "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, findings replaced in their texts; n_chars follows."""
    out = secret_scan.redacted(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text, with the digests of ids and round trip."""
    return bpe.bpe(spark, docs, with_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    root = checkpoint_path(spark, f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
