"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m characters that occurs with at most e edits shares at
least ``m + 1 - q - q * e`` of its character q-grams with the place, and all
of them lie on nearby diagonals (place in the text minus place in the item).
Shared q-grams are therefore counted in overlapping bands of diagonals; bands
that reach the bound are regions, and each region is verified by a banded
alignment of the whole item.  Text and items are compared lower-cased with
white space folded; spans are given in the original text.

The items are indexed in blocks of a bounded number of characters; each block
is broadcast and all texts are read against it, whole.  No text is cut and no
q-gram is left out, however frequent.

Cases: null or empty text matches nothing; null and empty items are ignored;
items that are equal after folding are each reported; a null ``doc_id`` is
kept as it is; repeated rows are each reported; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm._common import batch, strings

Q = 8
#: Edits allowed, as a share of the item's characters.
EDITS = 0.1
#: Characters of one broadcast block of items.
BLOCK_CHARS = 4_000_000
#: Characters of texts that a task works on at a time (a longer text is one piece).
CHUNK_CHARS = 1_000_000
_BITS = 22
_P = np.uint64(0x9E3779B97F4A7C15)
_DDL = "doc_id long, item_id long, start long, end long, edits int, identity double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("identity", pa.float64())])
_WORD = re.compile(r"\S+")


def fold(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q code points from each position on (Q is a power of 2)."""
    h, width, p = codes.astype(np.uint64) + np.uint64(1), 1, _P
    with np.errstate(over="ignore"):
        while width < Q:
            h = h[:-width] * p + h[width:] if len(h) > width else h[:0]
            width, p = 2 * width, p * p
        return (h ^ h >> np.uint64(29)) * _P


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.codes = [code_points(t) for _, t in items]
        self.edits = [min(int(EDITS * len(c)), max(0, (len(c) - Q) // Q)) for c in self.codes]
        self.short = [k for k, c in enumerate(self.codes) if len(c) < Q]
        self.text = [t for _, t in items]
        grams = [gram_hashes(c) for c in self.codes]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        at = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.item, self.at = item[order], at[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        #: Half the width of a band: any place of an item with up to its edits
        #: lies whole in one of the bands that overlap by half.
        self.half = np.array([max(1, 2 * e + 1) for e in self.edits], dtype=np.int64)
        self.need = np.array([max(1, len(c) + 1 - Q - Q * e) for c, e in zip(self.codes, self.edits, strict=True)], dtype=np.int64)

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of bands with enough shared q-grams."""
        h = gram_hashes(codes)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.hash):
            return []
        k = np.searchsorted(self.hash, h[at])
        k[k == len(self.hash)] = 0
        same = self.hash[k] == h[at]
        at, k = at[same], k[same]
        n = self.last[k] - self.first[k]
        where = np.repeat(self.first[k] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        item = self.item[where]
        diagonal = np.repeat(at, n) - self.at[where]
        band = diagonal // self.half[item]
        key = item.astype(np.int64) * (1 << 40) + band + (1 << 39)
        found, count = np.unique(key, return_counts=True)
        out = []
        item, band = found >> 40, (found & ((1 << 40) - 1)) - (1 << 39)
        # band b and its right neighbour together, which may be missing
        right = np.searchsorted(found, found + 1)
        right[right == len(found)] = 0
        both = count + np.where(found[right] == found + 1, count[right], 0)
        for i in np.flatnonzero(both >= self.need[item]):
            out.append((int(item[i]), int(band[i] * self.half[item[i]])))
        return out


def align(item: np.ndarray, codes: np.ndarray, first: int, width: int, limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the item in a band of diagonals
    of a text, from ``first`` on (which may lie before the text); None beyond
    the limit.

    Row i holds the band of ``width`` diagonals: entry k is the fewest edits
    with which the first i characters of the item end at place i + k.
    """
    m, n, huge = len(item), len(codes), np.int64(1) << 32
    window, before = codes[max(0, first):max(0, first + m + width)], max(0, -first)
    padded = np.full(m + width, 0xFFFFFFFF, np.uint32)
    padded[before:before + len(window)] = window
    steps = np.arange(width, dtype=np.int64) * huge
    # edits and start travel in one number, so that the least edits win and
    # among them the latest start (the tightest place)
    row = np.int64(width) - np.arange(width, dtype=np.int64)
    for i in range(m):
        new = row + np.where(padded[i:i + width] == item[i], 0, huge)
        new[:-1] = np.minimum(new[:-1], row[1:] + huge)
        row = np.minimum.accumulate(new - steps) + steps
        if int(row.min() >> 32) > limit:
            return None
    best = int(np.argmin(row >> 32))
    edits = int(row[best] >> 32)
    start = first + width - int(row[best] & (huge - 1))
    return (edits, max(0, start), min(n, first + m + best)) if edits <= limit else None


def _spans(original: str, folded: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of folded text in the original, by the words they touch."""
    at, words, lower = 0, [], []
    for m in _WORD.finditer(original):
        words.append((at, m.start(), m.end(), len(m[0].lower()) == len(m[0])))
        at += len(m[0].lower()) + 1
        lower.append(words[-1][0])
    out = []
    for a, b in places:
        i = max(0, int(np.searchsorted(lower, a, side="right")) - 1)
        j = max(i, int(np.searchsorted(lower, b - 1, side="right")) - 1)
        (f0, s0, e0, same0), (f1, s1, e1, same1) = words[i], words[j]
        out.append((min(s0 + (a - f0), e0) if same0 else s0, min(s1 + (b - f1), e1) if same1 else e1))
    return out


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(list(items))


def matches(index: Index, text: str) -> list[tuple[int, int, int, int, float]]:
    """(item id, start, end, edits, identity) of the items in one text."""
    return _matches(index, text, fold(text), None)


def _matches(index: Index, text: str, folded: str, regions) -> list[tuple[int, int, int, int, float]]:
    codes = code_points(folded)
    found: dict[tuple[int, int, int], int] = {}
    for k, d in index.regions(codes) if regions is None else regions:
        item, e = index.codes[k], index.edits[k]
        got = align(item, codes, d - e, 2 * int(index.half[k]) + 2 * e + 1, e)
        if got:
            found[k, got[1], got[2]] = got[0]
    for k in index.short:
        at = folded.find(index.text[k])
        while at >= 0:
            found[k, at, at + len(index.text[k])] = 0
            at = folded.find(index.text[k], at + 1)
    # of places of one item that overlap, the one with the fewest edits stays
    kept: list[tuple[int, int, int, int]] = []
    for (k, a, b), e in sorted(found.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
        if not any(k == k2 and a < b2 and a2 < b for k2, a2, b2, _ in kept):
            kept.append((k, a, b, e))
    spans = _spans(text, folded, [(a, b) for _, a, b, _ in kept])
    return sorted((index.ids[k], s, t, e, 1 - e / max(1, len(index.codes[k]))) for (k, _, _, e), (s, t) in zip(kept, spans, strict=True))


def _search(index: Index, ids: list, docs: list[str]):
    """Rows of all matches in a batch of texts; texts share the array passes."""
    rows, chunk, size = [], [], 0

    def work():
        folded = [fold(t) for _, t in chunk]
        joined = ("\0" * Q).join(folded)
        begins = np.cumsum([0, *(len(f) + Q for f in folded)])[:-1]
        by: dict[int, list[tuple[int, int]]] = {}
        for k, d in index.regions(code_points(joined)):
            # a band may begin a little before its text
            lo = int(np.searchsorted(begins, d, side="right")) - 1
            hi = int(np.searchsorted(begins, d + 2 * int(index.half[k]) + len(index.codes[k]), side="right")) - 1
            for i in range(max(0, lo), hi + 1):
                by.setdefault(i, []).append((k, d - int(begins[i])))
        for i in (range(len(chunk)) if index.short else sorted(by)):
            rows.extend((chunk[i][0], *m) for m in _matches(index, chunk[i][1], folded[i], by.get(i, [])))

    for one in zip(ids, docs, strict=True):
        chunk.append(one)
        size += len(one[1])
        if size >= CHUNK_CHARS:
            work()
            chunk, size = [], 0
    if chunk:
        work()
    return rows


def _blocks(spark: SparkSession, benchmark: DataFrame):
    """Broadcast blocks of folded items, each of a bounded number of characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("trim(text) <> ''")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // BLOCK_CHARS) or 1
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        content = tuple(sorted(((r.item_id, f) for r in block.toLocalIterator() if (f := fold(r.text))), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        yield spark.sparkContext.broadcast(content)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All places of benchmark items in all texts: (doc_id, item_id, start,
    end, edits, identity), offsets in code points of the original text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _blocks(spark, benchmark):
        def run(batches, shared=shared):
            index = _index(shared.value)
            for b in batches:
                if got := _search(index, b.column(0).to_pylist(), strings(b.column(1))):
                    yield batch(_SCHEMA, *map(list, zip(*got, strict=True)))
        part = rows.mapInArrow(run, _DDL)
        out = part if out is None else out.unionByName(part)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that hold a benchmark item."""
    for shared in _blocks(spark, benchmark):
        @F.pandas_udf("boolean")
        def holds(column, shared=shared):
            found = {r[0] for r in _search(_index(shared.value), list(range(len(column))), [t or "" for t in column])}
            return column.index.to_series().reset_index(drop=True).isin(found)
        docs = docs.filter(~holds(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs
