"""Toxicity of whole texts by a learned lexicon, misspellings included.

Lexicon: words and word beginnings whose frequency among labelled toxic texts
stands out against clean ones, with their log odds as weight.
The lexicon is a trie; Levenshtein automata of its whole words (one edit from
five letters on, two from eight) are intersected with it and determinised
lazily, so a word is matched by one dictionary step per character.  A word
that clean texts use is never taken for a misspelling.

Context: each hit gets a factor from the window of words around it: hits in
quotation marks or after a reporting verb count for less than hits that
address someone.  A logistic model over the windows' scores, their density
and the number of distinct terms gives the score.

Only labelled rows of the training folds are learned from.  The logistic model
learns from features that the lexicon of the other half of them gives.  Both
fit on at most SAMPLE texts of each class (those with the smallest hash of
their id); scoring covers every text whole.

Cases: null or empty text has no hits and gets the score of a text without
hits; null ids and null labels are not learned from, and a null id is scored
like any other; a document with several labels is toxic if one says so;
repeated rows are scored each; without labels of both classes every score is
the prior; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm._common import batch, fold_of, per_batch, strings
from orderlens.session import ensure_checkpoint_dir

#: Labelled texts of each class that the model is fitted on, at most.
SAMPLE = 3000
#: Terms of the lexicon and known clean words, at most (both are broadcast).
TERMS, KNOWN = 600, 50_000
#: A term's least log odds, and least share of the toxic texts that have it.
LEAST_ODDS, LEAST_SHARE = 1.2, 0.015
#: Beginnings of words that may become terms, in characters.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words of a context window to each side, and of a scored window.
CONTEXT, WINDOW = 6, 40
THRESHOLD = 0.7
WORDS_KEPT = 200_000
#: Occurrences of a term in one document that count for its weight.
REPEATS = 5

# --- fixed values: factors of a hit, and words of the context ---------------
QUOTED, ADDRESSED, PER_EDIT = 0.35, 1.25, 0.8
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes dit disait sagte sagt schrieb dijo dice escribió".split())
ADDRESS = frozenset("you your yours u ur du dich dir dein deine tu te toi vous ton votre tú ti usted".split())
QUOTES = "\"“”„«»"

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(rf"[^\W_]+|[{QUOTES}]")


@dataclass
class Lexicon:
    """Trie of terms with a lazily determinised edit automaton."""

    words: dict[str, float]
    prefixes: dict[str, float]
    known: frozenset[str] = frozenset()
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    term: dict[int, str] = field(default_factory=dict)
    most: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for w in sorted(self.words):
            at, k = 0, self.edits(w)
            self.most[0] = max(self.most[0], k)
            for c in w:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.most.append(0)
                at = self.nodes[at][c]
                self.most[at] = max(self.most[at], k)
            self.term[at] = w
        self.states: dict[frozenset, int] = {}
        self.members: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._closed({0: 0}))
        self.kept: dict[str, tuple[float, str] | None] = {}

    @staticmethod
    def edits(word: str) -> int:
        return 2 if len(word) >= 8 else 1 if len(word) >= 5 else 0

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that left-out characters reach."""
        todo = list(nodes)
        while todo:
            at = todo.pop()
            e = nodes[at] + 1
            for to in self.nodes[at].values():
                if e <= self.most[to] and e < nodes.get(to, 9):
                    nodes[to] = e
                    todo.append(to)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(nodes)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        """The next state, -1 if no term is left."""
        to: dict[int, int] = {}
        for at, e in self.members[state].items():
            for d, child in self.nodes[at].items():
                cost = e + (d != c)
                if cost <= self.most[child] and cost < to.get(child, 9):
                    to[child] = cost
            if e + 1 <= self.most[at] and e + 1 < to.get(at, 9):
                to[at] = e + 1
        self.steps[state][c] = got = self._state(self._closed(to)) if to else -1
        return got

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits (then the first in order)."""
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        found = [(e, self.term[at]) for at, e in self.members[state].items() if at in self.term and e <= self.edits(self.term[at])]
        return min(found)[::-1] if found else None

    def _look(self, word: str) -> tuple[float, str] | None:
        best = (self.words[word], word) if word in self.words else (0.0, "")
        for n in PREFIXES:
            if n > len(word):
                break
            p = word[:n]
            if self.prefixes.get(p, 0.0) > best[0]:
                best = (self.prefixes[p], p + "*")
        if not best[1] and word not in self.known and (near := self.nearest(word)) and near[1]:
            best = (self.words[near[0]] * PER_EDIT ** near[1], near[0])
        return best if best[1] else None

    def look(self, word: str) -> tuple[float, str] | None:
        """(weight, term) of a word; None if it is no term's."""
        try:
            return self.kept[word]
        except KeyError:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            if len(self.members) >= 20_000:  # the automaton is rebuilt from its start
                self.states, self.members, self.steps = {}, [], []
                self.start = self._state(self._closed({0: 0}))
            got = self._look(word)
            if len(word) <= 64:
                self.kept[word] = got
            return got

    def features(self, text: str) -> list[float]:
        """Features of a whole text."""
        lower = text.lower()
        words = _WORD.findall(lower)
        look, kept = self.look, self.kept
        if not any([kept[w] if w in kept else look(w) for w in words]):
            return [0.0] * FEATURES
        hits, quoted = self._context(lower)
        n = max(1, len(words))
        total = sum(w for _, w, _ in hits)
        windows: Counter[int] = Counter()
        for i, w, _ in hits:  # windows that overlap by half
            windows[i // (WINDOW // 2)] += w
            windows[i // (WINDOW // 2) - 1] += w
        terms = {t: w for _, w, t in hits}
        return [math.log1p(total), 10 * total / (n + 20), math.log1p(max(windows.values())), math.log1p(sum(terms.values())), quoted / len(hits),
                max(terms.values())]

    def _context(self, lower: str) -> tuple[list[tuple[int, float, str]], int]:
        """(place, weight in context, term) of the hits; how many are quoted."""
        tokens = _TOKEN.findall(lower)
        inside, open_, place, hits, quoted = [], False, 0, [], 0
        for t in tokens:
            if t in QUOTES:
                open_ = not open_
            inside.append(open_)
        for i, t in enumerate(tokens):
            if t in QUOTES:
                continue
            place += 1
            if got := self.look(t):
                around = tokens[max(0, i - CONTEXT):i + CONTEXT + 1]
                closes = any(x in QUOTES for x in tokens[i + 1:i + 30])
                said = inside[i] and closes or bool(REPORTING.intersection(tokens[max(0, i - CONTEXT):i]))
                quoted += said
                factor = QUOTED if said else ADDRESSED if ADDRESS.intersection(around) else 1.0
                hits.append((place, got[0] * factor, got[1]))
        return hits, quoted


FEATURES = 6


@dataclass
class Model:
    words: dict[str, float]
    prefixes: dict[str, float]
    known: frozenset[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, trains) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts of the training folds, at most SAMPLE of each class, and
    how many labelled documents each class has."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    lab = lab.filter(trains).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = lab.filter("toxic = 1").orderBy(*order).limit(SAMPLE).unionByName(lab.filter("toxic = 0").orderBy(*order).limit(SAMPLE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    return found.checkpoint(), counts


def _terms(sample: DataFrame) -> DataFrame:
    """(term, prefix, toxic, clean, toxic_n, clean_n): documents of each class
    that have it, and occurrences in them (up to REPEATS in a document)."""
    names = ["toxic", "clean", "toxic_n", "clean_n"]
    schema = pa.schema([("term", pa.string()), ("prefix", pa.bool_()), *[(n, pa.int64()) for n in names]])

    def run(batches):
        for b in batches:
            n: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(strings(b.column(0)), b.column(1).to_pylist(), strict=True):
                terms: Counter = Counter()
                for w, times in Counter(_WORD.findall(text.lower())).items():
                    terms[w, False] += times
                    for k in PREFIXES:
                        if len(w) > k:
                            terms[w[:k], True] += times
                for t, times in terms.items():
                    row = n.setdefault(t, [0, 0, 0, 0])
                    row[1 - toxic] += 1
                    row[3 - toxic] += min(times, REPEATS)
            if n:
                yield batch(schema, [k[0] for k in n], [k[1] for k in n], *map(list, zip(*n.values(), strict=True)))

    counted = sample.select("text", "toxic").mapInArrow(run, "term string, prefix boolean, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("term", "prefix").agg(*[F.sum(n).alias(n) for n in names])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x is standardised."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _lexicon_of(sample: DataFrame, t: int, c: int) -> Lexicon:
    """The lexicon of a sample with t toxic and c clean texts."""
    odds = F.log((F.col("toxic_n") + 0.5) / (t + 1.0)) - F.log((F.col("clean_n") + 0.5) / (c + 1.0))
    counted = _terms(sample).withColumn("odds", odds).checkpoint()
    least = max(2, math.ceil(LEAST_SHARE * t))
    terms = counted.filter((F.col("toxic") >= least) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term", "prefix").limit(TERMS).collect()
    known = counted.filter("not prefix and clean > 0").orderBy(F.desc("clean"), "term").limit(KNOWN).collect()
    return Lexicon({r["term"]: r["odds"] for r in terms if not r["prefix"]}, {r["term"]: r["odds"] for r in terms if r["prefix"]}, frozenset(r["term"] for r in known))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, trains) -> Model:
    """Fit on the labelled rows for which the condition ``trains`` holds."""
    ensure_checkpoint_dir(spark)
    sample, counts = _sample(docs, labels, trains)
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    none = Model({}, {}, frozenset(), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    prior = math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    none.weights[-1] = prior
    if any(not sizes.get((half, toxic)) for half in (0, 1) for toxic in (0, 1)):
        return none
    # each half's lexicon gives the features of the other half; all of them fit
    # the logistic model, and the lexicon of both halves is kept
    halves = [_lexicon_of(sample.filter(F.col("half") == h), sizes[h, 1], sizes[h, 0]) for h in (0, 1)]
    fit = [r for h in (0, 1) for r in _features(spark, sample.filter(F.col("half") != h).select("toxic", "text"), halves[h], "toxic int").collect()]
    x, y = np.array([r["x"] for r in fit], dtype=float).reshape(len(fit), -1), np.array([r["toxic"] for r in fit], dtype=float)
    lexicon = _lexicon_of(sample, sizes[0, 1] + sizes[1, 1], sizes[0, 0] + sizes[1, 0])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = _logistic((x - mean) / scale, y)
    # classes were picked evenly; the intercept goes back to their shares
    w[-1] += prior - math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return Model(lexicon.words, lexicon.prefixes, lexicon.known, mean, scale, w)


_LEXICONS: dict = {}


def _lexicon(shared) -> Lexicon:
    """The worker's lexicon of a broadcast (words, prefixes, known)."""
    if shared.id not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[shared.id] = Lexicon(*shared.value)
    return _LEXICONS[shared.id]


class _Shared:
    """A broadcast with an id by which a worker keeps what it builds of it."""

    def __init__(self, spark: SparkSession, value):
        import uuid

        self.id, self._of = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._of.value


def _features(spark: SparkSession, rows: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    shared = _Shared(spark, (lexicon.words, lexicon.prefixes, lexicon.known))
    schema = pa.schema([(key.split()[0], pa.int32()), ("x", pa.list_(pa.float64()))])
    return per_batch(rows, lambda b: [b.column(0), [_lexicon(shared).features(t) for t in strings(b.column(1))]], f"{key}, x array<double>", schema)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared, rest = _Shared(spark, (model.words, model.prefixes, model.known)), spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(b: pa.RecordBatch):
        lexicon = _lexicon(shared)
        x = np.array([lexicon.features(t) for t in strings(b.column(1))]).reshape(len(b), FEATURES)
        return [b.column(0), rest.value.scores(x).tolist()]

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double", schema)


def rejected(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with column ``toxic_score`` added, all columns kept."""
    shared, rest = _Shared(spark, (model.words, model.prefixes, model.known)), spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts):
        lexicon = _lexicon(shared)
        x = np.array([lexicon.features(t or "") for t in texts]).reshape(len(texts), FEATURES)
        import pandas as pd

        return pd.Series(rest.value.scores(x))

    return docs.withColumn("toxic_score", toxic(F.coalesce(F.col("text"), F.lit(""))))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from the folds that are not held out."""
    held = fold_of("doc_id", 3) == 1
    model = train(spark, docs, labels, ~held)
    return score(spark, docs, model).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score",
                                           (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
