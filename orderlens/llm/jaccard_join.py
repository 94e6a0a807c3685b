"""Exact Jaccard join of documents on word shingles, size-aware heavy-light.

Two documents link when ``100 * |A & B| >= 75 * |A | B|`` for their sets of
distinct 5-word shingles.  Documents with equal sets form a class; classes are
joined.

Candidates.  All sets are read in one order: light shingles by their hash,
then the heavy ones (the most frequent) by rank.  Of a set of n, a partner
shares a member of the first ``n - ceil(0.75 n) + 1`` shingles (the prefix), and
two members of the first one more.  Small sets are found by enumerating all
2-subsets of that longer prefix; large sets by scanning inverted lists of their
prefixes.  The boundary is the largest size for which the subsets of a set cost
no more than scanning its lists, whose mean length is measured over all
documents.  Small sets that could meet a large one are in the lists too.

Light shingles are dealt to buckets of the hash space as packed arrays, so
that a shuffle carries about 8 bytes for each; lists of a single class are
dropped there and equal lists are kept once.  Heavy shingles reach a prefix
only where more than three quarters of a set are heavy; those lists stay rows.
The order is exact for any choice of heavy shingles: which ones are listed
changes the work and not the result.

Links.  The members of each list are first compared with its smallest class,
in a list of more than SHORT classes also with the one that is in most lists (of
near copies, one with few changes), so that a list costs its length.  These links join most classes.  Then only
members of different components are left to compare: in a list of up to SHORT
classes all of them, in a longer one all members outside the component that
most of its members have, against all members of other components.  So a group
of near copies costs its size and not its square, and no link between
components is lost.  Pairs whose prefixes share too little to reach the overlap
are passed over, and so are those whose bitmaps of whole sets differ too much:
a bit that only one set has stands for a shingle that only it has.  The others
are verified on whole sets, for which the texts of one document of each class in
question are read again and shuffled compressed, which is less than their sets.

Hashes: shingles have 64 bits; classes have 96 bits, as each of the shuffles of
lists and pairs carries them and little else.

Cases: null or empty text has no shingles and links with nothing; a text of
fewer than five words is one shingle; null ids take part and count last for
the smallest id; repeated rows are of one class; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import bz2
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm._common import batch, small_batches, texts, word_bytes
from orderlens.session import ensure_checkpoint_dir, shuffles_freed

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 75, 100
#: Heavy shingles, at most (they are broadcast); a shingle is heavy from
#: HEAVY_LOCAL documents in a chunk of CHUNK documents on.
HEAVY, HEAVY_LOCAL, CHUNK = 200_000, 6, 4000
#: Shingles of one bucket of inverted lists that are aimed at.
BUCKET = 1_500_000
#: Bits of the filter that keeps texts no pair asks for from being read again,
#: in parts of PART_BITS.
FILTER_BITS, PART_BITS = 1 << 26, 1 << 18
HASHES_KEPT = 300_000
#: Words of texts that are shingled in one array; lists up to SHORT classes are
#: compared whole.
AT_ONCE, SHORT = 100_000, 32
#: Bytes of a class; lists that go to the JVM at once.
CLASS, LISTS_AT_ONCE = 12, 2000
#: Parts in which a list of more than SHORT heavy rows meets its smallest class.
SALTS = 16

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _Q
        return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes of many texts at a time; each word is hashed once
    in a while."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        if len(self.kept) >= HASHES_KEPT:
            self.kept.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self.kept[word] = got
        return got

    def sets(self, texts: list[bytes]):
        """The sorted distinct hashes of the shingles of each text."""
        kept, word = self.kept, self.word
        some, size = [], 0
        for t in texts:
            words = word_bytes(t)
            some.append([kept[w] if w in kept else word(w) for w in words])
            size += len(words)
            if size > AT_ONCE:
                yield from self._sets(some)
                some, size = [], 0
        yield from self._sets(some)

    @staticmethod
    def _sets(hashes: list[list[int]]):
        flat = np.array([h for hs in hashes for h in hs], dtype=np.uint64)
        rolled = _roll(flat, WORDS) if len(flat) >= WORDS else flat[:0]
        at = 0
        for hs in hashes:
            n = len(hs)
            yield np.unique(rolled[at:at + n - WORDS + 1]) if n >= WORDS else _roll(flat[at:at + n], n) if n else flat[:0]
            at += n


def _roll(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words that begin at each word."""
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        s = h[:n] + np.uint64(width)
        for i in range(1, width):
            s = _mix(s * _P) + h[i:n + i]
        return _mix(s * _P)


def class_of(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=CLASS).digest()


def least_overlap(n):
    """Shingles that any partner shares of a set of n."""
    return -(-NUM * n // DEN)


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + 1


def small_limit(mean_list: float) -> int:
    """The largest size at which the C(p + 1, 2) subsets of a set cost no more
    than p lists of the mean length and their entries."""
    n = 2
    while prefix_length(n + 1) <= 2 * mean_list + 1 and n < 64:
        n += 1
    return n


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _class_column(classes: np.ndarray) -> pa.Array:
    """A binary column of classes."""
    offsets = np.arange(len(classes) + 1, dtype=np.int32) * CLASS
    return pa.Array.from_buffers(pa.binary(), len(classes), [None, pa.py_buffer(offsets), pa.py_buffer(classes.tobytes())])


def _small(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32 that are mostly small, compressed by their bytes' places."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _wide(packed: bytes) -> np.ndarray:
    """The numbers that ``_small`` has packed."""
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


# --- pass 1: classes, frequent shingles, list lengths --------------------------

def _classes(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, n, class) of a document; kind 1: (key, n) a shingle of
    several classes in a chunk; kind 2: (key: shingles, n: sum of squares)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("key", pa.int64())])

    def chunk_rows(sets):
        keys, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = count >= HEAVY_LOCAL
        k, n = keys[often].view(np.int64).tolist(), count[often].tolist()
        return batch(schema, [1] * len(k) + [2], [None] * (len(k) + 1), [*n, int((count.astype(np.int64) ** 2).sum())], [None] * (len(k) + 1), [*k, int(count.sum())])

    def run(batches):
        shingler, seen, sets = Shingler(), set(), []
        for b in batches:
            n, cls = [], []
            for s in shingler.sets(texts(b.column(1))):
                c = class_of(s)
                n.append(len(s))
                cls.append(c)
                if c not in seen:
                    seen.add(c)
                    sets.append(s)
            yield batch(schema, [0] * len(n), b.column(0), n, cls, [None] * len(n))
            if len(sets) >= CHUNK:
                yield chunk_rows(sets)
                seen, sets = set(), []
        yield chunk_rows(sets)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, class binary, key long")


# --- pass 2: inverted lists -----------------------------------------------------

class Order:
    """The order of shingles: light by hash, then heavy by rank."""

    def __init__(self, heavy: np.ndarray):
        """heavy: hashes, the most frequent last."""
        self.at = np.argsort(heavy)
        self.hash = heavy[self.at]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def split(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(light by hash, heavy by rank) of a sorted set."""
        maybe = np.flatnonzero(self.bits[(members >> np.uint64(42)).astype(np.int64)])
        if not len(maybe):
            return members, members[:0]
        k = np.searchsorted(self.hash, members[maybe])
        k[k == len(self.hash)] = 0
        same = self.hash[k] == members[maybe]
        light = np.ones(len(members), bool)
        light[maybe[same]] = False
        return members[light], members[maybe[same]][np.argsort(self.at[k[same]])]

    def keys(self, members: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(light shingles, heavy shingles, subsets) by which a set is found."""
        n = len(members)
        p = prefix_length(n)
        light, heavy = self.split(members)
        none = members[:0]
        pairs = none
        if n <= limit:
            first = np.concatenate([light[:p + 1], heavy[:max(0, p + 1 - len(light))]])
            i, j = np.triu_indices(len(first), 1)
            a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            with np.errstate(over="ignore"):
                pairs = _mix(a * _P + _mix(b))
            if n < least_overlap(limit + 1):
                return none, none, pairs
        return light[:p], heavy[:max(0, p - len(light))], pairs


_PACKED = pa.schema([("bucket", pa.int32()), ("classes", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
#: The bucket of packed heavy shingles, which have all their 64 bits, and that of
#: the bitmaps of classes, of MARKS times 64 bits.
HEAVY_BUCKET, MARKS_BUCKET = -1, -2
MARKS = 16


def marks_of(members: np.ndarray) -> bytes:
    """The bitmap of a set."""
    bits = np.zeros(64 * MARKS, bool)
    bits[(members >> np.uint64(20)).astype(np.int64) % len(bits)] = True
    return np.packbits(bits).tobytes()


def _emit(docs: DataFrame, heavy, limit: int, buckets: int) -> DataFrame:
    """Packed keys and their sets: light shingles and subsets by bucket, heavy
    shingles in HEAVY_BUCKET; bitmaps, as keys, in MARKS_BUCKET.  Keys are in the
    order of their sets, each of which says how many are its own."""

    def packed(cls, sizes, keys, refs, at):
        order = np.argsort(at, kind="stable")
        keys, refs, at = keys[order], refs[order], at[order]
        cut = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(keys)], strict=True):
            used, count = np.unique(refs[lo:hi], return_counts=True)
            own = keys[lo:hi] if at[lo] == HEAVY_BUCKET else keys[lo:hi].astype(np.uint32)
            yield int(at[lo]), cls[used].tobytes(), _small(sizes[used]), own.tobytes(), _small(count)

    def flush(cls, sizes, keys, refs, often, owners, marks):
        cls, sizes = np.array(cls, dtype=f"V{CLASS}"), np.array(sizes, dtype=np.int64)
        out = [(MARKS_BUCKET, cls.tobytes(), b"", b"".join(marks), b"")]
        if keys:
            k, r = np.concatenate(keys), np.concatenate(refs)
            out += packed(cls, sizes, k, r, ((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
        if often:
            k, r = np.concatenate(often), np.concatenate(owners)
            out += packed(cls, sizes, k, r, np.full(len(k), HEAVY_BUCKET, dtype=np.int32))
        return batch(_PACKED, *map(list, zip(*out, strict=True)))

    def run(batches):
        shingler, order, seen = Shingler(), Order(heavy.value), set()
        kept, total = ([], [], [], [], [], [], []), 0
        for b in batches:
            for s in shingler.sets(texts(b.column(1))):
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:
                    continue
                if len(seen) < 500_000:  # else a copy is dropped later
                    seen.add(c)
                light, often, pairs = order.keys(s, limit)
                cls, sizes, keys, refs, heavies, owners, marks = kept
                if len(light) or len(pairs):
                    keys.append(np.concatenate([light, pairs]))
                    refs.append(np.full(len(keys[-1]), len(cls), dtype=np.uint32))
                    total += len(keys[-1])
                if len(often):
                    heavies.append(often)
                    owners.append(np.full(len(often), len(cls), dtype=np.uint32))
                    total += len(often)
                cls.append(c)
                sizes.append(len(s))
                marks.append(marks_of(s))
            if total > 400_000:
                yield flush(*kept)
                kept, total = ([], [], [], [], [], [], []), 0
        if total:
            yield flush(*kept)

    return docs.mapInArrow(run, "bucket int, classes binary, sizes binary, keys binary, counts binary")


def _heavy_rows(packed: DataFrame) -> DataFrame:
    """(key, class, n) of the heavy shingles in prefixes."""
    schema = pa.schema([("key", pa.int64()), ("class", pa.binary()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for cls, sizes, keys, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                counts = _wide(counts)
                yield batch(schema, pa.array(np.frombuffer(keys, np.int64)), _class_column(np.repeat(np.frombuffer(cls, dtype=f"V{CLASS}"), counts)), pa.array(np.repeat(_wide(sizes), counts)))

    return packed.filter(F.col("bucket") == HEAVY_BUCKET).select("classes", "sizes", "keys", "counts").mapInArrow(run, "key long, class binary, n long").distinct()


#: The words of a bitmap, and the number of its bits that are set.
_MARK_NAMES = [f"m{i}" for i in range(MARKS + 1)]


def _marks(packed: DataFrame) -> DataFrame:
    """(class, m0, m1, ...): the bitmap of every class."""
    schema = pa.schema([("class", pa.binary()), *((m, pa.int64()) for m in _MARK_NAMES)])

    def run(batches):
        for b in batches:
            for cls, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits = np.frombuffer(marks, np.int64).reshape(-1, MARKS)
                full = np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64)
                yield batch(schema, _class_column(np.frombuffer(cls, dtype=f"V{CLASS}")), *(pa.array(np.ascontiguousarray(x)) for x in bits.T), pa.array(full))

    ddl = "class binary, " + ", ".join(f"{m} long" for m in _MARK_NAMES)
    return packed.filter(F.col("bucket") == MARKS_BUCKET).select("classes", "keys").mapInArrow(run, ddl).dropDuplicates(["class"])


def _may_link(na: str, nb: str, a: str, b: str):
    """Whether sets of these sizes can be similar by their bitmaps, the columns
    named ``a`` and ``b`` and a number."""
    both = sum((F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.col(f"{b}{i}"))) for i in range(1, MARKS)), F.bit_count(F.col(f"{a}0").bitwiseAND(F.col(f"{b}0"))))
    most = F.least(F.col(na) - F.col(f"{a}{MARKS}"), F.col(nb) - F.col(f"{b}{MARKS}")) + both
    return DEN * most >= NUM * (F.col(na) + F.col(nb) - most)


_LIST = pa.schema([("key", pa.int64()), ("more", pa.int64()), ("times", pa.int64()), ("members", pa.list_(pa.struct([("class", pa.binary()), ("n", pa.int64())])))])


def _lists(group: pa.Table) -> pa.Table:
    """The inverted lists of a bucket with two classes or more; equal ones (by
    128 bits, "key" and "more") once, with their number."""
    cls = np.concatenate([np.frombuffer(x, dtype=f"V{CLASS}") for x in group["classes"].to_pylist()])
    sizes, counts = (np.concatenate([_wide(x) for x in group[c].to_pylist()]) for c in ("sizes", "counts"))
    keys = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group["keys"].to_pylist()])
    words = cls.view(np.uint32).reshape(-1, 3).astype(np.uint64)
    words = np.stack([words[:, 0] | words[:, 1] << np.uint64(32), words[:, 2]], axis=1)
    order = np.lexsort((words[:, 1], words[:, 0]))
    other = np.append(True, (words[order[1:]] != words[order[:-1]]).any(axis=1)) if len(cls) else np.zeros(0, bool)
    number = np.empty(len(cls), np.int64)
    number[order] = np.cumsum(other) - 1
    first = order[other]
    cls, sizes, words = cls[first], sizes[first], words[first]
    member = np.repeat(number, counts)
    order = np.lexsort((member, keys))
    keys, member = keys[order], member[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (member[1:] != member[:-1])
    keys, member = keys[new], member[new]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    length = np.diff(np.append(begin, len(keys)))
    with np.errstate(over="ignore"):
        name = [_mix(words[:, 0] * p ^ words[:, 1]) for p in (_P, _Q)]
        digest = np.array([np.add.reduceat(_mix(x[member] * _P), begin) if len(begin) else words[:0, 0] for x in name]).T
    begin, length, digest = begin[length > 1], length[length > 1], digest[length > 1]
    digest, at, times = np.unique(digest, axis=0, return_index=True, return_counts=True)
    begin, length = begin[at], length[at]
    take = np.repeat(begin - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum()) if len(begin) else begin
    flat = member[take]
    values = pa.StructArray.from_arrays([_class_column(cls[flat]), pa.array(sizes[flat])], names=["class", "n"])
    offsets = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
    found = pa.table([*(pa.array(np.ascontiguousarray(digest[:, i]).view(np.int64)) for i in (0, 1)), pa.array(times.astype(np.int64)), pa.ListArray.from_arrays(offsets, values)], schema=_LIST)
    return pa.Table.from_batches(found.to_batches(max_chunksize=LISTS_AT_ONCE), schema=_LIST)


# --- verification ----------------------------------------------------------------

def _spot(doc_id: str):
    """The place of a document in the filter; null ids have one place."""
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the places of ``doc_id``."""
    def part(group: pa.Table) -> pa.Table:
        bits = np.zeros(PART_BITS, bool)
        bits[group["spot"].to_numpy() % PART_BITS] = True
        return pa.table({"at": pa.array([group["at"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()])})

    # at most PART_BITS different places meet in one part
    spots = ids.select(_spot("doc_id").alias("spot")).distinct().withColumn("at", F.floor(F.col("spot") / PART_BITS))
    out = np.zeros((FILTER_BITS // PART_BITS, PART_BITS // 8), np.uint8)
    for r in spots.groupBy("at").applyInArrow(part, "at long, bits binary").collect():
        out[r["at"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def similar(shared: int, a: int, b: int) -> bool:
    return DEN * shared >= NUM * (a + b - shared)


def _verify(spark: SparkSession, docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; owners: (class,
    doc_id), one document of each class."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().checkpoint()
    bits = spark.sparkContext.broadcast(_filter_of(owners.join(asked, "class", "left_semi")))
    packed = pa.schema([("class", pa.binary()), ("text", pa.binary())])

    def read(batches):
        shingler, sent = Shingler(), set()
        for b in batches:
            cls, sent_now = [], []
            at = b.column(1).to_numpy()
            used = texts(b.column(0).filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))))
            for t, s in zip(used, shingler.sets(used), strict=True):
                if not len(s):
                    continue
                c = class_of(s)
                if c in sent:
                    continue
                if len(sent) < 500_000:
                    sent.add(c)
                cls.append(c)
                sent_now.append(bz2.compress(b" ".join(word_bytes(t))))
            yield batch(packed, cls, sent_now)

    # dealt by class once, for either side of the pairs
    table = docs.select("text", _spot("doc_id").alias("spot")).mapInArrow(read, "class binary, text binary").join(asked, "class", "left_semi").dropDuplicates(["class"])
    both = (pairs.join(table.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
            .join(table.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def check(batches):
        shingler = Shingler()
        for b in batches:
            left, right = (b.column(i).to_pylist() for i in (0, 1))
            each = dict(zip([*left, *right], [*b.column(2).to_pylist(), *b.column(3).to_pylist()], strict=True))
            sets = dict(zip(each, shingler.sets([bz2.decompress(t) for t in each.values()]), strict=True))
            keep = [similar(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y])) for x, y in zip(left, right, strict=True)]
            keep = pa.array(keep, type=pa.bool_())
            yield batch(out, b.column(0).filter(keep), b.column(1).filter(keep))

    return both.mapInArrow(check, "a binary, b binary").checkpoint()


# --- components --------------------------------------------------------------------

def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, by hooking
    each node to the smallest label around it and jumping along labels."""
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct().checkpoint()
    labels = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root")).checkpoint()
    while True:
        around = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("low"))
        # a root follows the lowest label that one of its members has found
        lead = hooked.groupBy("root").agg(F.min("low").alias("lead"))
        moved = hooked.join(lead, "root").select("node", F.col("root").alias("old"), F.least("low", "lead").alias("mid"))
        jump = moved.select(F.col("node").alias("mid"), F.col("mid").alias("next"))
        after = moved.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("next", "mid")).alias("root")).checkpoint()
        changed = after.filter("root <> old").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


# --- the join ------------------------------------------------------------------------

def _sizes_fit(a, b):
    return (DEN * F.least(a, b)) >= (NUM * F.greatest(a, b))


def _needed(a, b):
    """What the prefixes of two similar sets of these sizes share at least."""
    return F.ceil((a + b) * NUM / (NUM + DEN)) - F.ceil(F.greatest(a, b) * NUM / DEN) + 1


def _common_keys(a, b, limit: int):
    """The lists in which two similar sets of these sizes meet at least: those of
    the shingles that their prefixes share; of two small sets, those of the
    2-subsets of what their longer prefixes share, which is one more."""
    n = _needed(a, b)
    return F.when(F.greatest(a, b) <= limit, n * (n + 1) / 2).otherwise(n)


def _enough(pairs: DataFrame, in_long: DataFrame, limit: int) -> DataFrame:
    """The pairs that share enough of their prefixes.

    Of the set whose prefix ends first in the order, at most ``size - overlap``
    members are not the partner's, so the prefixes of a pair share at least
    ``overlap - least overlap of the larger + 1``.  ``shared`` counts what they
    share in short lists; in long ones they share no more than either has
    there.
    """
    a, b = (in_long.select(F.col("class").alias(c), F.col("long").alias(f"l{c}"), *(F.col(m).alias(f"{c}{i}") for i, m in enumerate(_MARK_NAMES))) for c in ("a", "b"))
    most = F.col("shared") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return pairs.join(a, "a").join(b, "b").filter((most >= _common_keys(F.col("na"), F.col("nb"), limit)) & _may_link("na", "nb", "a", "b"))


def links_of(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, roots): (doc_id, n, class) of every document, and (node,
    root) of the classes that have links."""
    ensure_checkpoint_dir(spark)
    with shuffles_freed(spark):
        return _links(spark, docs)


def _links(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    small_batches(spark)
    rows = _rows(docs)
    first = _classes(rows).checkpoint()
    documents = first.filter("kind = 0").select("doc_id", "n", "class")
    shingles, squares = first.filter("kind = 2").agg(F.sum("key"), F.sum("n")).first()
    top = first.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HEAVY).collect()
    heavy = spark.sparkContext.broadcast(np.array([r["key"] for r in reversed(top)], dtype=np.int64).view(np.uint64))
    limit = small_limit((squares or 1) / max(1, shingles or 1))
    buckets = max(8, math.ceil((shingles or 1) * (DEN - NUM) / DEN / BUCKET))
    packed = _emit(rows, heavy, limit, buckets).checkpoint()
    lists = packed.filter(F.col("bucket") >= 0).groupBy("bucket").applyInArrow(_lists, "key long, more long, times long, members array<struct<class:binary,n:long>>")
    light = lists.groupBy("key", "more").agg(F.sum("times").alias("times"), F.first("members").alias("members")).drop("more").checkpoint()
    entries = light.select("key", "times", F.size("members").alias("m"), F.explode("members").alias("x")).select("key", "times", "m", "x.class", "x.n")
    star = light.select(F.explode("members").alias("x"), F.array_min("members").alias("p")).select("x.class", "x.n", "p")
    if top:
        often = _heavy_rows(packed).checkpoint()
        lengths = often.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("m"), F.min(F.struct("class", "n")).alias("p")).filter("m > 1").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = often.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(lengths, ["key", "salt"]).select(
            "key", F.lit(1).cast("long").alias("times"), "m", "class", "n", "p").checkpoint()
        entries = entries.unionByName(spread.drop("p"))
        star = star.unionByName(spread.select("class", "n", "p"))
    owners = documents.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    # the members of every list with its smallest class and those of a long one with
    # the class that is in most lists: no more than two pairs an entry
    in_lists = entries.groupBy("class").agg(F.sum("times").alias("all"), F.sum(F.when(F.col("m") > SHORT, F.col("times"))).alias("long")).join(_marks(packed), "class").checkpoint()
    long_ = entries.filter(F.col("m") > SHORT)
    centre = long_.join(in_lists.select("class", "all"), "class").groupBy("key").agg(F.max(F.struct("all", "class", "n")).alias("c")).select(
        "key", F.struct("c.class", "c.n").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    star = star.unionByName(long_.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(centre, ["key", "salt"]).select("class", "n", "p"))
    star = star.filter((F.col("class") != F.col("p.class")) & _sizes_fit(F.col("n"), F.col("p.n"))).withColumn("x", F.struct("class", "n"))
    pairs = star.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).select(
        F.col("a.class").alias("a"), F.col("b.class").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.lit(0).cast("long").alias("shared")).distinct()
    asked = _enough(pairs, in_lists.withColumn("long", F.col("all")), limit).select("a", "b").checkpoint()
    near = _verify(spark, rows, owners, asked)
    roots = components(near).checkpoint()
    # then the members of a list that are in different components
    rooted = roots.withColumnRenamed("node", "class")
    # in short lists, each of which is gathered once, with the keys that a pair
    # shares there: such a pair has different components in each of its lists, so
    # all of them are counted
    short = entries.filter(F.col("m") <= SHORT).join(rooted, "class", "left").select("key", "times", "class", "n", F.coalesce("root", "class").alias("root"))
    x, y = F.col("x"), F.col("y")
    beside = (short.repartition("key").groupBy("key", "times").agg(F.collect_list(F.struct("class", "n", "root")).alias("members"))
              .select("times", "members", F.explode("members").alias("x"))
              .select("times", "x", F.explode(F.filter("members", lambda o: (x["class"] < o["class"]) & (x["root"] != o["root"]) & _sizes_fit(x["n"], o["n"]))).alias("y")))
    counted = beside.groupBy(x["class"].alias("a"), y["class"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")).agg(F.sum("times").alias("shared"))
    # in long ones, those outside the component that most members have
    rooted = entries.filter(F.col("m") > SHORT).join(rooted, "class", "left").withColumn("root", F.coalesce("root", "class"))
    main = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    open_ = rooted.join(main.filter("roots > 1").select("key", F.col("main.root").alias("main")), "key").checkpoint()
    # pairs that share a short list are settled by it, so what the others share
    # is in long lists.  These are read in one order, the shorter first: from its
    # first common list on, a pair shares no more than either has left ("ahead").
    left_ = Window.partitionBy("class").orderBy(F.desc("m"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = open_.withColumn("ahead", F.sum("times").over(left_)).join(in_lists.select("class", *_MARK_NAMES), "class")
    stray = ranked.filter("root <> main").select("key", F.col("class").alias("s"), F.col("n").alias("sn"), F.col("root").alias("sr"), F.col("ahead").alias("sa"),
                                                 *(F.col(m).alias(f"s{i}") for i, m in enumerate(_MARK_NAMES)))
    reach = F.least("ahead", "sa") >= _common_keys(F.col("n"), F.col("sn"), limit)
    once = (F.col("root") == F.col("main")) | (F.col("class") < F.col("s"))
    across = ranked.join(stray, "key").filter((F.col("root") != F.col("sr")) & _sizes_fit(F.col("n"), F.col("sn")) & once & reach & _may_link("n", "sn", "m", "s"))
    one = F.col("class") < F.col("s")
    met = across.select(F.least("class", "s").alias("a"), F.greatest("class", "s").alias("b"), F.when(one, F.col("n")).otherwise(F.col("sn")).alias("na"),
                        F.when(one, F.col("sn")).otherwise(F.col("n")).alias("nb")).distinct()
    more = counted.unionByName(met.withColumn("shared", F.lit(0).cast("long")))
    rest = _enough(more, in_lists, limit).select("a", "b").distinct().join(asked, ["a", "b"], "left_anti").checkpoint()
    if rest.take(1):
        roots = components(near.unionByName(_verify(spark, rows, owners, rest))).checkpoint()
    return documents, roots


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    documents, roots = links_of(spark, docs)
    rooted = documents.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "class")))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
