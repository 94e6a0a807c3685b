"""Each operator against a brute force, the public library, or held-out rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import ann, bpe, chat, decontam, jaccard_join, lm, pii, quality, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- BPE ------------------------------------------------------------------------

TEXTS = ["", "ΑΣ ΟΔΟΣ İstanbul ß ﬁ", "a<|startoftext|>b <|endoftext|><|endoftext|>", "x" * 3000, "don't we'll I'm 123 ½ ²  　 é   <|", "日本語 テスト🙂👍🏽",
         "'S 'T it'S", "\x00\x1f \x85a", "Ångström K Å", "ǅ Ǆ ẞ", "thsttionhe anding the"]


@tables
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    texts = TEXTS + [r.text or "" for r in read(spark, "documents").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, r in rows(bpe.bpe(spark, df)).items():
        want = lib.encode(texts[i], add_special_tokens=False).ids
        assert [int(x) for x in r.ids.split()] == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_bpe_merges_like_a_plain_loop():
    enc = bpe.Encoder(open(bpe.default_vocabulary(), "rb").read())
    rnd = random.Random(1)
    for _ in range(300):
        piece = "".join(rnd.choice("thesandionr") for _ in range(rnd.randint(1, 25)))
        ids = [enc.byte_ids[b] for b in piece.encode()[:-1]] + [enc.last_ids[piece.encode()[-1]]]
        while True:
            found = [(enc.merge[a << 16 | b] >> 16, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 16 | b in enc.merge]
            if not found:
                break
            _, i = min(found)
            ids[i:i + 2] = [enc.merge[ids[i] << 16 | ids[i + 1]] & 0xFFFF]
        assert enc.piece(piece) == ids


# --- chat -----------------------------------------------------------------------

def test_chat_round_trip_of_control_strings():
    rnd = random.Random(1)
    parts = ["</s>", "[INST]", "\\", "|", "<<SYS>>", "[/ROLE]", "<\\/s>", "a", " ", "\n", "[\\/INST]", "<", "s>", "<</SYS>>", "[ROLE ", "[ROLE 3]"]
    for _ in range(5000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "a]b\\", "", "[/ROLE]"]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 7)))) for _ in range(3)]
        assert chat.parse("".join(chat.format_turn(*t) for t in turns)) == turns


def test_chat_plain_text_is_not_escaped_and_bad_text_is_refused():
    assert chat.format_turn("user", "a </s> b") == "[INST]a </s> b[/INST]"
    assert chat.format_turn("assistant", "a </s> b") == "<s>a <\\/s> b</s>"
    assert chat.parse("no mark") is None and chat.parse("<s>never closed") is None


@tables
def test_chat_equals_oracle(spark):
    import duckdb

    from orderlens.llm.queries import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    rel = con.sql(ORACLE_SQL["op10_chat"])
    want = sorted(tuple(r) for r in rel.fetchall())
    df = QUERIES["op10_chat"](spark, SF)
    assert df.columns == rel.columns and sorted(tuple(r) for r in df.collect()) == want


# --- decontamination ----------------------------------------------------------------

def edits(item, text):
    before = [0] * (len(text) + 1)
    for c in item:
        now = [before[0] + 1]
        for j, t in enumerate(text):
            now.append(min(before[j] + (c != t), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_decontamination_equals_brute_force():
    rnd = random.Random(3)
    some = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    for _ in range(150):
        item = decontam.fold(some(rnd.randint(25, 80)))
        t = list(item)
        for _ in range(rnd.randint(0, 8)):
            p, how = rnd.randrange(len(t)), rnd.random()
            if how < 0.4:
                t[p] = rnd.choice("abcd")
            elif how < 0.7:
                del t[p]
            else:
                t.insert(p, rnd.choice("abcd"))
        text = f"{some(rnd.randint(0, 60))} {''.join(t)} {some(rnd.randint(0, 60))}"
        index = decontam.Index([(1, item)])
        got, want = decontam.matches(index, text), edits(item, decontam.fold(text))
        assert bool(got) == (want <= index.edits[0])
        assert not got or got[0][3] == want


@tables
def test_decontamination_of_the_tables(spark):
    docs, items = read(spark, "documents"), read(spark, "benchmark")
    texts, want = {r.doc_id: r.text or "" for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    got = decontam.contaminated(spark, docs, items).collect()
    exact = {(i, k) for i, t in texts.items() for k, x in want.items() if decontam.fold(x) in decontam.fold(t)}
    assert exact <= {(r.doc_id, r.item_id) for r in got}
    assert all(texts[r.doc_id][r.start:r.end] == want[r.item_id] for r in got if r.edits == 0)
    clean = {r.doc_id for r in decontam.clean(spark, docs, items).collect()}
    assert clean == set(texts) - {r.doc_id for r in got}


def test_decontamination_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"benchmark item number {i} with its own words {i * 7919}") for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before benchmark item  number {i} with its OWN words {i * 7919} after") for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 150)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, docs, items).filter("edits = 0").collect()}
    assert got == {(i, i) for i in range(12)}


# --- nearest neighbours ---------------------------------------------------------------

def test_neighbours_recall_ties_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16))
    x[100:130] = x[20]  # copies tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(spark, df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        hit += len(set(want) & {v for v, _ in got[q]})
        assert len(got[q]) == 20 and all(abs(sc - s[v]) < 1e-9 for v, sc in got[q])
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
    assert hit / (75 * 20) >= 0.9
    copies = [v for v, _ in got[20] if 100 <= v < 130]
    assert copies and copies == list(range(100, 100 + len(copies)))


# --- personal data ---------------------------------------------------------------------

def luhn(d):
    return sum((x if j % 2 == 0 else (2 * x) // 10 + 2 * x % 10) for j, x in enumerate(map(int, reversed(d)))) % 10 == 0


digits = lambda m: re.sub("[^0-9]", "", m)
PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]


def plain_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))
    return [f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in found]


def test_pii_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(5)
    texts = ["a.b@c.d_x@e.f, x@y..z a@b.c.d.e@f.g", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4", "4111 1111-1111 1111 and 4111111111111111 4111  1111", "+1 (555) 123-4567..( x +12 +123456789 +1234567890",
             "😀 a@b.co 😀 +44 20 7946 0958", "1" * 5000 + " " + "a" * 20000 + "@", "x." * 3000 + "@" + "y." * 3000 + "z"]
    texts += ["".join(rnd.choice(["1", "22", "4111", " ", "-", ".", "@", "a", "b.c", "+", "(", "é", "😀"]) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, r in rows(pii.digests(spark, df)).items():
        want = plain_spans(texts[i])
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k, *_ in PLAIN]


def test_pii_terms_that_disclose(spark):
    common = [(i, f"common words everywhere in document {i} nothing else") for i in range(60)]
    told = [(100 + i, "the quartermaster zephyrine wrote from quiet.harbour@mail.example today and common words everywhere") for i in range(3)]
    df = spark.createDataFrame(common + told, "doc_id long, text string")
    got = rows(pii.digests(spark, df))
    words = lambda i, t: {t[int(a):int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"}
    found = words(100, told[0][1])
    assert "zephyrine" in found and "common" not in found and got[0].spans == ""
    text = rows(pii.sanitise(spark, df))[100].text
    assert "[EMAIL]" in text and "zephyrine" not in text and "quiet.harbour" not in text and "common words" in text


# --- secrets ------------------------------------------------------------------------------

def test_secrets_found_and_redacted(spark):
    rnd = random.Random(6)
    key = lambda n=40: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    secrets = {i: key() for i in range(60)}
    texts = {i: f'settings\ntoken = "{s}" and more words' for i, s in secrets.items()}
    texts |= {100 + i: f"see /usr/lib/some/very/long/path/to/file{i}.txt and extraordinarilylongcompoundword" for i in range(60)}
    texts[200] = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, lang string")
    got = defaultdict(set)
    for r in secret_scan.scan(spark, df).collect():
        got[r.doc_id].add(texts[r.doc_id][r.start:r.end])
    assert all(got[i] == {s} for i, s in secrets.items()) and not any(got[100 + i] for i in range(60)) and len(got[200]) == 1
    out = rows(secret_scan.redacted(spark, df))
    assert all("[SECRET]" in out[i].text and s not in out[i].text for i, s in secrets.items())
    assert all(out[100 + i].text == texts[100 + i] for i in range(60)) and out[0].asDict().keys() == {"doc_id", "text", "lang"}


# --- quality ------------------------------------------------------------------------------

def test_quality_keeps_what_looks_like_the_target(spark):
    rnd = random.Random(8)
    good, bad = [f"good{i}" for i in range(50)], [f"junk{i}!!" for i in range(50)]
    docs = [(i, " ".join(rnd.choice(good if i % 4 else bad) for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.resample(spark, df, labels).collect()}
    assert len(kept) == 300 and sum(i % 4 > 0 for i in kept) >= 297
    again = {r.doc_id for r in quality.resample(spark, df.repartition(5), labels).collect()}
    assert kept == again


@pytest.mark.parametrize("k", [1, 7, 50, 99, 100])
def test_quality_border_is_the_kth_key(spark, k):
    rnd = random.Random(k)
    keys = [rnd.choice([0.5, 1.5, rnd.random() * 1e6, -rnd.random()]) for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in keys], "v double")
    assert quality.top_border(df, "v", k, bins=4) == sorted(keys, reverse=True)[k - 1]


# --- toxicity -----------------------------------------------------------------------------

def distance(a, b):
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, t in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != t)))
        before = now
    return before[-1]


def test_edit_automaton_equals_brute_force():
    terms = ["idiot", "moron", "scum", "worthless", "disgusting", "pathetic", "idiots"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {})
    rnd = random.Random(2)
    for _ in range(3000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            p, how = rnd.randrange(len(w)) if w else 0, rnd.random()
            if how < 0.4 and w:
                w[p] = rnd.choice("abcdeimorst")
            elif how < 0.7 and w:
                del w[p]
            else:
                w.insert(p, rnd.choice("abcdeimorst"))
        word = "".join(w)
        near = [(d, t) for t in terms if (d := distance(word, t)) <= toxicity.Lexicon.edits(t)]
        assert lexicon.nearest(word) == (min(near)[::-1] if near else None)


def test_quotation_counts_less_than_abuse():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {})
    abuse, quoted, plain = (lexicon.features(t) for t in ("you are an idiot", 'the report said "idiot" was written there', "an idiot walks"))
    assert abuse[0] > plain[0] > quoted[0] and quoted[4] == 1.0 and lexicon.features("nothing here") == [0.0] * toxicity.FEATURES


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(9)
    words, bad = [f"word{i}" for i in range(300)], ["zorgle", "blithrup", "quandrix"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        t = [rnd.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(4):
                b = rnd.choice(bad)
                t.insert(rnd.randrange(40), b if rnd.random() < 0.7 else b.replace("i", "1").replace("o", "0"))
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    d, x = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(spark, d, x).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) / len(held) > 0.97


# --- language model -----------------------------------------------------------------------

def test_lm_gradients():
    model, rng = lm.Model(np.ones(2 * lm.PIECES)), np.random.default_rng(0)
    x, y = rng.integers(0, 2 * lm.PIECES, (2, 3, 10))
    for n in model.w:
        model.w[n] = (model.w[n] + 0.1 * rng.standard_normal(model.w[n].shape)).astype(np.float64)
    loss, g = model.gradients(x, y)
    assert abs(loss + model.log_probability(x, y).mean()) < 1e-6
    for n in g:
        d, e = rng.standard_normal(model.w[n].shape), 1e-5
        model.w[n] += e * d
        a = -model.log_probability(x, y).mean()
        model.w[n] -= 2 * e * d
        b = -model.log_probability(x, y).mean()
        model.w[n] += e * d
        assert abs((a - b) / (2 * e) - (g[n] * d).sum()) < 1e-3 * abs((a - b) / (2 * e)) + 1e-8


def test_lm_is_causal_and_normalised():
    model, rng = lm.Model(np.ones(2 * lm.PIECES)), np.random.default_rng(1)
    for n in model.w:
        model.w[n] = model.w[n] + 0.3 * rng.standard_normal(model.w[n].shape).astype(np.float32)
    x = rng.integers(0, 2 * lm.PIECES, (1, 8))
    f = model._body(x)[-1][0, 5:6]
    every = np.arange(2 * lm.PIECES)
    assert abs(np.exp(model._next(np.repeat(f, len(every), 0), every).astype(float)).sum() - 1) < 1e-3
    other = x.copy()
    other[0, 6:] = 3  # what follows does not matter
    assert np.allclose(model._body(x)[-1][0, :6], model._body(other)[-1][0, :6])


def test_lm_windows_score_each_id_once():
    streams = [np.arange(1, n + 1) for n in (1, 37, 38, 39, 200)]
    source, target, place = lm.windows(streams, 0)
    first = lm.WINDOW - lm.FRESH
    fresh = place[:, first:]
    assert sorted(fresh[fresh >= 0]) == list(range(sum(map(len, streams))))
    flat = np.concatenate(streams)
    assert (target[place >= 0] == flat[place[place >= 0]]).all()
    starts = np.cumsum([0, *map(len, streams)])[:-1]
    inside = fresh[fresh >= 0]
    want = np.where(np.isin(inside, starts), 0, flat[inside - 1])
    assert (source[:, first:][fresh >= 0] == want).all()


@tables
def test_lm_counts_and_held_out_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 500)  # rare words take the other way
    monkeypatch.setattr(lm, "STEPS", 200)
    texts = {r.doc_id: (r.text or "").encode() for r in read(spark, "documents").collect()}
    c = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*lm.word_bytes(t), b""])
    n, v = sum(c.values()), len(c)
    got = rows(lm.score(spark, read(spark, "documents")))
    assert got.keys() == texts.keys()
    for i, r in got.items():
        words = [*lm.word_bytes(texts[i]), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(c[w] > 0 for w in words), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())


# --- Jaccard join -------------------------------------------------------------------------

def brute_components(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(least[root(k)], i)
    return {i: (len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(docs)}


@pytest.mark.parametrize("heavy, short", [(6, 32), (2, 2), (3, 4)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, heavy, short):
    monkeypatch.setattr(jaccard_join, "HEAVY_LOCAL", heavy)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    base, docs = [rnd.choice(words) for _ in range(60)], []
    for i in range(220):
        how = rnd.random()
        if how < 0.45:
            w = base[:]
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            w += [rnd.choice(words) for _ in range(rnd.randint(1, 15))] if rnd.random() < 0.3 else []
        elif how < 0.7:
            w = base[:30] + [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        else:
            w = [rnd.choice(words[:4]) for _ in range(rnd.randint(0, 14))]
        docs.append((i * 3 + 1, " ".join(w)))
    docs += [(5000, None), (5001, ""), (5003, "a b"), (5004, "A  b"), (5005, docs[0][1])]
    got = rows(jaccard_join.join(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    want = brute_components(docs)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_components_of_long_paths(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 100 != 99], "a long, b long")
    got = {r.node: r.root for r in jaccard_join.components(links).collect()}
    assert all(got[i] == i // 100 * 100 for i in range(n) if i in got) and len(got) == 300


# --- pipeline -------------------------------------------------------------------------------

@tables
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = read(spark, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before.keys()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            if name == "near_duplicates":
                groups = rows(jaccard_join.join(spark, spark.createDataFrame(list(before.items()), "doc_id long, text string")))
                assert ids == {i for i, r in groups.items() if r.component_id == i}
            if name == "decontamination":
                items = [decontam.fold(r.text) for r in read(spark, "benchmark").collect()]
                assert not any(x in decontam.fold(t or "") for t in after.values() for x in items)
            if name == "secrets":
                assert ids == before.keys() and not any(re.search(r'token = "[0-9a-f]{40}"', t or "") for t in after.values())
            before = after
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and ids == before.keys()


def test_pipeline_keeps_one_of_a_group_with_equal_ids(spark):
    import corpus_pipeline
    text = " ".join(f"w{i}" for i in range(30))
    rows_ = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (None, None, "d"), (3, "", "e"), (4, "other words in this one here", "f")]
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows_, "doc_id long, text string, lang string"), SF)
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("1", text), ("None", ""), ("3", ""), ("4", "other words in this one here")])


def test_bitmaps_pass_over_no_similar_pair(spark):
    rnd, pairs = random.Random(3), []
    for _ in range(300):
        n = rnd.choice([1, 5, 40, 300, 2000])
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        b = np.unique(np.append(a[rnd.randrange(n // 3 + 1):], np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(n // 3 + 1))], dtype=np.uint64)))
        marks = [np.frombuffer(jaccard_join.marks_of(x), np.int64).tolist() for x in (a, b)]
        marks = [[*m, sum((x % 2**64).bit_count() for x in m)] for m in marks]
        pairs.append([jaccard_join.similar(len(np.intersect1d(a, b)), len(a), len(b)), len(a), len(b), *marks[0], *marks[1]])
    names = [f"{c}{i}" for c in "ab" for i in range(jaccard_join.MARKS + 1)]
    df = spark.createDataFrame(pairs, "linked boolean, na long, nb long, " + ", ".join(f"{c} long" for c in names))
    got = df.select("linked", jaccard_join._may_link("na", "nb", "a", "b").alias("may")).collect()
    assert all(r.may for r in got if r.linked) and sum(r.linked for r in got) > 50
    assert sum(not r.may for r in got if not r.linked) > 20


def test_jaccard_strays_of_near_copies_cost_no_square(spark, monkeypatch):
    # copies with four changes link with those that have one, not with each other;
    # whichever of them a list begins with, no more than a few pairs a row are asked for
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(np.arange(3, 197, 8), 1 if i % 8 == 0 else 4, replace=False):
            words[at] = f"x{i}y{at}"
        docs.append((i, " ".join(words)))
    asked, whole = [], jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "SHORT", 8)
    monkeypatch.setattr(jaccard_join, "_verify", lambda s, d, o, pairs: asked.append(pairs.count()) or whole(s, d, o, pairs))
    got = rows(jaccard_join.join(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(2)))
    assert {r.component_id for r in got.values()} == {0}
    assert sum(asked) <= 4 * len(docs), asked


@pytest.mark.parametrize("numbers", [[], [0], [1, 255, 256, 65_536, 2**32 - 1]])
def test_small_numbers_are_packed_and_read_again(numbers):
    assert jaccard_join._wide(jaccard_join._small(np.array(numbers, dtype=np.int64))).tolist() == numbers


def test_jaccard_keys_are_dealt_in_few_bytes(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 400))) for i in range(40)]
    heavy = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    packed = jaccard_join._emit(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), heavy, 2, 64).filter("bucket >= 0").collect()
    keys = sum(len(r.keys) // 4 for r in packed)
    assert keys == 40 * jaccard_join.prefix_length(396)
    # a key and its owner's place took 8 bytes, a class in a bucket 20
    assert sum(len(x) for r in packed for x in r[1:]) < 14 * keys


def test_jaccard_frees_the_shuffle_files_of_each_step(spark, monkeypatch):
    key, seen, whole = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], jaccard_join._verify
    before = spark.conf.get(key, None)
    monkeypatch.setattr(jaccard_join, "_verify", lambda s, *x: seen.append(s.conf.get(key)) or whole(s, *x))
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    got = rows(jaccard_join.join(spark, spark.createDataFrame([(1, text), (2, text + " a"), (3, "z " * 9)], "doc_id long, text string")))
    assert seen == ["true"] and spark.conf.get(key, None) == before
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3}
