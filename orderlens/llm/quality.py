"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-gram models share BUCKETS hashed buckets of words and word pairs:
one of the raw text (all documents) and one of the target text (labelled good
documents).  A document's log weight is the mean over its n-grams of
``log(p_target / p_raw)``, times the square root of their number up to LENGTH,
so that a long text is surer than a short one without length alone deciding.
Gumbel top-k draws the sample without replacement: each document gets
``log weight / TEMPERATURE + Gumbel noise`` (noise from a hash of its id, text
and the seed, so that a rerun draws the same) and the k largest are kept.

The raw counts cover all documents; the target model is fitted on at most
TARGETS labelled good documents (those with the smallest hash of their id).
k is a share of all documents: the share of good ones among the labelled, if
none is given.

The k-th largest key is found by counting keys in ever narrower ranges, so
that neither a sort of all rows nor a global limit meets in one task.

Cases: null or empty text has no n-grams and weight 0; null ids are drawn like
others; equal rows share their noise, and ties at the border are all kept; a
document labelled both good and bad is not a target; without good labels the
weights are 0 and the draw is even; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm._common import batch, per_batch, texts, word_bytes
from orderlens.session import ensure_checkpoint_dir

BUCKETS = 1 << 14
#: Labelled good documents of the target model, at most.
TARGETS = 20_000
TEMPERATURE, LENGTH, SEED = 0.1, 400, 17
#: Added to each bucket's count.
SMOOTH = 1.0
HASHES_KEPT = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Buckets of the words and word pairs of a text; words are hashed once."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        if len(self.kept) >= HASHES_KEPT:
            self.kept.clear()
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self.kept[word] = got
        return got

    def buckets(self, text: bytes) -> np.ndarray:
        kept, word = self.kept, self.word
        h = np.array([kept[w] if w in kept else word(w) for w in word_bytes(text)], dtype=np.uint64)
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * _MIX) ^ (h[1:] + _MIX)
            both = np.concatenate([h, pairs])
            return ((both * _MIX) >> np.uint64(64 - 14)).astype(np.int64)


def _counts(rows: DataFrame) -> np.ndarray:
    """n-grams of all texts by bucket; a task sends one row for each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        hasher, total = Hasher(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in texts(b.column(0)):
                total += np.bincount(hasher.buckets(t), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield batch(schema, at.tolist(), total[at].tolist())

    out = np.zeros(BUCKETS)
    for r in rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def weights(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, log_weight, n_grams, noise) of every document, and the share of
    good ones among the labelled."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = lab.agg(F.avg("quality")).first()[0]
    good = lab.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS).select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = _counts(rows.select("text"))
    target = _counts(rows.join(F.broadcast(good), "doc_id", "left_semi").select("text"))
    if target.sum():
        ratio = np.log((target + SMOOTH) / (target + SMOOTH).sum()) - np.log((raw + SMOOTH) / (raw + SMOOTH).sum())
    else:
        ratio = np.zeros(BUCKETS)
    shared = spark.sparkContext.broadcast(ratio)
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("n_grams", pa.int64()), ("noise", pa.float64())])
    hashers: list[Hasher] = []

    def run(b: pa.RecordBatch):
        if not hashers:
            hashers.append(Hasher())
        weight, grams, noise = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            at = hashers[0].buckets(text)
            weight.append(float(shared.value[at].mean() * min(len(at), LENGTH) ** 0.5) if len(at) else 0.0)
            grams.append(len(at))
            h = hashlib.blake2b(b"%d:%r:" % (SEED, doc) + text, digest_size=8).digest()
            u = (int.from_bytes(h, "little") + 0.5) / 2**64
            noise.append(float(-np.log(-np.log(min(u, 1 - 1e-16)))))
        return [b.column(0), weight, grams, noise]

    return per_batch(rows, run, "doc_id long, log_weight double, n_grams long, noise double", schema), 0.5 if share is None else float(share)


def top_border(rows: DataFrame, key: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value of a column, by counts in narrowing ranges."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low is not None and low < high:
        width = (high - low) / bins
        if not low < low + width < high:
            break
        inside = rows.filter(F.col(key).between(low, high))
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["lo"], r["hi"]
        if r["n"] == k - above:
            return low
    return low


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The drawn documents: (doc_id, log_weight, n_grams, draw_key), a share of
    all documents by Gumbel top-k."""
    ensure_checkpoint_dir(spark)
    rated, good = weights(spark, docs, labels)
    keyed = rated.withColumn("draw_key", F.col("log_weight") / TEMPERATURE + F.col("noise")).drop("noise").checkpoint()
    n = keyed.count()
    k = round(n * (good if share is None else share))
    if not k:
        return keyed.limit(0)
    return keyed.filter(F.col("draw_key") >= top_border(keyed, "draw_key", k))
