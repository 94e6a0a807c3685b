"""No operator leaves out part of its input: what a cap, a sample or a gate
would lose is in the result."""

import glob
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import lm, pii, secret_scan, toxicity
from orderlens.session import ensure_checkpoint_dir


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- language model -------------------------------------------------------------

@pytest.fixture
def corpus(spark):
    rnd = random.Random(3)
    words = [f"w{i}x{i * 7 % 31}" for i in range(900)]
    return spark.createDataFrame([(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(900)], k=60))) for i in range(120)], "doc_id long, text string")


def test_lm_score_has_the_frequency_of_rare_words(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "_share", lambda *a: 0.4)
    every = rows(lm.score(spark, corpus))
    monkeypatch.setattr(lm, "HOT", 50)
    few = rows(lm.score(spark, corpus))
    for i, r in every.items():
        assert few[i].score == pytest.approx(r.score, rel=1e-6)


def test_lm_windows_of_training_hold_each_id_once():
    for n in (1, 5, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, 5 * lm.WINDOW, 333):
        stream = np.arange(1, n + 1)
        targets = lm.training_windows(stream, 0)[:, 1:].ravel()
        assert targets[targets > 0].tolist() == stream.tolist()


def test_lm_weights_learn_from_all_documents(spark, monkeypatch):
    """3,600 ids, 100 of them twice: each row's window is trained on."""
    seen = []
    whole = lm._dealt

    def dealt(*args):
        out = whole(*args)
        seen.extend(np.frombuffer(r.windows, np.uint16).reshape(-1, lm.WINDOW + 1) for r in out.collect())
        return out
    monkeypatch.setattr(lm, "_dealt", dealt)
    monkeypatch.setattr(lm, "STEPS", 3)
    docs = spark.range(0, 3600).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), F.col("id").cast("string"), F.lit(" b")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 100"))
    rows_ = docs.withColumn("trains", F.lit(True))
    before = lm.Model(np.ones(2 * lm.PIECES)).w
    fitted = lm.fit(spark, rows_)
    assert sum(map(len, seen)) == 3700
    assert any(np.abs(fitted.model.w[n] - before[n]).max() > 0.01 for n in ("q", "o", "u"))


def test_lm_rounds_of_shards_lower_the_loss(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 80)
    monkeypatch.setattr(lm, "BATCH", 16)
    corpus = corpus.withColumn("doc_id", F.explode(F.sequence("doc_id", F.col("doc_id") + 3000, F.lit(1000))))
    fitted = lm.fit(spark, corpus.withColumn("trains", F.lit(True)))
    pieces, begin = fitted.pieces, fitted.begin
    cutter = lm.Cutter(pieces)
    x = np.concatenate([lm.training_windows(np.array([i for w in [*r.text.encode().split(), b""] for i in lm.ids_of(cutter, w)]), begin) for r in corpus.collect()]).astype(np.int64)
    loss = lambda m: -m.log_probability(x[:, :-1], x[:, 1:]).mean()
    used = np.bincount(x[:, 1:].ravel(), minlength=2 * lm.PIECES)
    assert loss(fitted.model) < loss(lm.Model(used)) - 0.1


def test_lm_share_is_of_all_documents_and_any_layout(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    shares = []
    whole = lm._share
    monkeypatch.setattr(lm, "_share", lambda *a: shares.append(whole(*a)) or shares[-1])
    # a run of copies that leads the files
    docs = spark.createDataFrame([(1000 + i, "copy " * 50) for i in range(70)], "doc_id long, text string").unionByName(corpus)
    first = rows(lm.score(spark, docs.coalesce(1)))
    monkeypatch.setattr(lm, "HOT", 50)
    again = rows(lm.score(spark, docs.orderBy(F.desc("doc_id")).repartition(3)))
    assert shares[0] == pytest.approx(shares[1], rel=1e-3)
    assert all(again[i].score == pytest.approx(r.score, rel=1e-3) for i, r in first.items())


def test_lm_share_from_bins_equals_plain_sums():
    ratio = np.random.default_rng(2).normal(0, 5, 5000)
    ratio[:100] = -np.inf
    n, total = lm.binned(ratio)
    share = 0.5
    for _ in range(20):
        part = share * np.exp(ratio)
        share = (part / (part + 1 - share)).mean()
    assert lm._share(n[n > 0], total[n > 0]) == pytest.approx(share, rel=1e-4)


def test_lm_words_are_forgotten_between_texts(monkeypatch):
    monkeypatch.setattr(lm, "WORDS_KEPT", 3)
    monkeypatch.setattr(lm, "SLICE", 8)
    pieces = [bytes([b]) for b in range(256)] + [b"an", b"ban"]
    texts = [b"a banana", b"", b"Banana a ab\tb  banana", b"x" * 200, b"a"]
    words, found = lm.Words(pieces, lambda h: (h % np.uint64(7)).astype(np.int64)), []
    for lo, hi in lm.some_texts(texts):
        numbers, sizes = words.of(texts[lo:hi])
        ids, by_word = words.stream(numbers)
        assert len(ids) == by_word.sum() and sizes.sum() == len(numbers) and len(words.known) == len(words)
        found.extend(ids.tolist())
    cutter = lm.Cutter(pieces)
    assert found == [i for t in texts for w in [*lm.word_bytes(t), lm.END] for i in lm.ids_of(cutter, w)]


def test_lm_training_leaves_no_windows_on_disk(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 3)
    kept = lambda: set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/lm-*"))
    before = kept()
    lm.fit(spark, corpus.withColumn("trains", F.lit(True)))
    assert kept() == before


# --- personal data -----------------------------------------------------------------

def test_pii_terms_far_from_the_span_short_and_in_other_scripts(spark):
    common = [(i, f"common words everywhere in document {i} nothing else") for i in range(60)]
    far = "common words everywhere " * 30
    told = [(100 + i, f"Kim Anne-Marie O'Neill 李明 {far}wrote from quiet.harbour@mail.example {far}zephyrine signed and Kim") for i in range(3)]
    got = rows(pii.digests(spark, spark.createDataFrame(common + told, "doc_id long, text string")))
    for i, text in told:
        words = [text[int(a):int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        assert sorted(words) == sorted(["Kim", "Anne-Marie", "O'Neill", "李明", "wrote", "from", "zephyrine", "signed", "and", "Kim"])
    assert all(got[i].spans == "" for i in range(60))


# --- pipeline ------------------------------------------------------------------------

def test_pipeline_near_duplicates_go_by_row(spark):
    import corpus_pipeline
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows_ = [(1, text("a")), (None, text("a")), (None, text("b")), (None, None), (None, ""),  # a null id that copies a numbered document
             (5, text("c")), (5, text("d")), (4, text("c")),  # another text of an id that is a copy
             (6, text("e")), (6, text("e")), (6, text("f")),  # rows of one id, one of them unlinked
             (None, text("g")), (None, text("g"))]  # a group without ids
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows_, "doc_id long, text string"), "")
    want = [(1, text("a")), (None, text("b")), (None, None), (None, ""), (5, text("d")), (4, text("c")), (6, text("e")), (6, text("f")), (None, text("g"))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


# --- secrets ---------------------------------------------------------------------------

def test_secrets_of_all_forms_reach_the_forest(spark):
    rnd = random.Random(8)
    key = lambda n=40: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    long = {i: key() for i in range(40)}
    short = {100 + i: f"p4s!{key(8)}" for i in range(40)}
    texts = {i: f"export API_TOKEN={s}\nexport A_VERY_LONG_NAME_OF_A_TOKEN={s}" for i, s in long.items()} | {i: f"password: {s} for the site" for i, s in short.items()}
    texts |= {200 + i: f"see /usr/lib/some/very/long/path/to/file{i}.txt and extraordinarilylongcompoundword" for i in range(60)}
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\nabc\n-----END RSA PRIVATE KEY-----"
    pgp = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x-y\n\nabc\n-----END PGP PRIVATE KEY BLOCK-----"
    texts |= {300: f"a {pem} b {pgp} c", 301: "-----BEGIN PRIVATE KEY-----" + "a-" * 50_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in secret_scan.scan(spark, df).collect():
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start:r.end])
    assert all(got[i] == [s, s] for i, s in long.items())
    assert all(got[i] == [s] for i, s in short.items())
    assert {pem, pgp} <= set(got[300]) and not any(200 <= i < 260 for i in got)


# --- toxicity --------------------------------------------------------------------------

def test_toxicity_of_words_of_any_length():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "moron" * 20: 3.0}, {"idio": 2.0})
    assert lexicon.look("idiot" * 30) == (2.0, "idio*")
    assert lexicon.look("moron" * 20) == (3.0, "moron" * 20)
    assert lexicon.look("moron" * 19 + "moran")[1] == "moron" * 20
    assert lexicon.look("x" * 50_000) is None
