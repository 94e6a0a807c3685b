"""BPE encoding and decoding with a published vocabulary.

Merging keeps the symbols of a piece in a doubly linked list and the possible
merges in a priority queue of (rank, position).  An entry whose symbols have
changed since it was queued is stale and skipped.  Decoding concatenates the
vocabulary strings.  No vocabulary is trained; the file is a parameter.

Cases: null text is empty text and gives no ids; an empty table gives an empty
result; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm._common import per_batch, strings

#: Distinct pieces a worker keeps encoded; the store is emptied when full.
PIECES_KEPT = 150_000
#: Longer pieces are encoded each time they occur.
LONGEST_KEPT = 48

_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    out, free = [], 256
    for b in range(256):
        own = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b if own else free))
        free += not own
    return out


class Encoder:
    """Encoder and decoder for one vocabulary file's content."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if max(self.ids.values()) >= 1 << 16:
            raise ValueError("ids of the vocabulary must be below 65,536")
        #: id pair -> rank and id of the merged symbol, packed in one number each
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[self.ids[a] << 16 | self.ids[b]] = rank << 16 | self.ids[a + b]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *added.items()]}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern, regex.V1).findall
        self.byte_ids = [self.ids[c] for c in byte_symbols()]
        self.last_ids = [self.ids[c + self.suffix] for c in byte_symbols()]
        self.kept: dict[str, tuple[str, str]] = {}

    def piece(self, piece: str) -> list[int]:
        """Ids of one pre-tokenised piece."""
        merge = self.merge.get
        raw = piece.encode()
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.last_ids[raw[-1]]
        n = len(ids)
        # an entry is rank and position in one number, a merge rank and new id
        queue = [(m >> 16 << 32) | i for i in range(n - 1) if (m := merge(ids[i] << 16 | ids[i + 1], -1)) >= 0]
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            e = pop(queue)
            i = e & 0xFFFFFFFF
            left = ids[i]
            j = after[i]
            if left < 0 or j < 0 or (m := merge(left << 16 | ids[j], -1)) >> 16 != e >> 32:
                continue  # stale
            ids[i] = new = m & 0xFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := merge(new << 16 | ids[k], -1)) >= 0:
                    push(queue, (m >> 16 << 32) | i)
            if (h := before[i]) >= 0 and (m := merge(ids[h] << 16 | new, -1)) >= 0:
                push(queue, (m >> 16 << 32) | h)
        return [x for x in ids if x >= 0]

    def _strings(self, piece: str) -> tuple[str, str]:
        """Decimal ids and vocabulary strings of a piece, each joined by a space."""
        got = self.kept.get(piece)
        if got is None:
            ids = self.piece(piece)
            got = " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids])
            if len(piece) <= LONGEST_KEPT:
                if len(self.kept) >= PIECES_KEPT:
                    self.kept.clear()
                self.kept[piece] = got
        return got

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def parts(self, text: str) -> list[tuple[str, str]]:
        """(decimal ids, vocabulary strings) of each piece of a whole text.

        The vocabulary's special strings are found in the raw text first; the
        text between them is normalised and split into pieces.  Folding white
        space is not needed, since the pieces never hold any.
        """
        got, kept, out = self._strings, self.kept, []
        for i, part in enumerate(self.split_added.split(text) if self.split_added and "<|" in text else [text]):
            if i % 2:
                out.append((str(self.added[part]), part))
            elif part:
                out += [kept.get(p) or got(p) for p in self.pieces(self.normalise(part))]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _ in self.parts(text) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space, as a tokenizer file without a
        decoder has it; special tokens stay."""
        return " ".join([self.strings[i] for i in ids])


_ENCODERS: dict[str, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The worker's encoder for a vocabulary, built once per process."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
        with_text: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns the id, ``n_tokens``, the digests of ids and decoded text and,
    with ``with_text``, ``ids`` (decimal, joined by one space) and ``decoded``.
    ``vocabulary`` is a file on the driver; its content (a published file of
    fixed size) is broadcast.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    ddl = _DDL if with_text else _DDL.partition(", ids ")[0]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                        *[(c, pa.string()) for c in ("ids", "decoded") if with_text]])

    def run(b: pa.RecordBatch):
        enc = encoder(content.value)
        n, ids, decoded, hashes = [], [], [], ([], [])
        for t in strings(b.column(1)):
            parts = enc.parts(t)
            i, d = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
            n.append(i.count(" ") + 1 if i else 0)
            hashes[0].append(hashlib.sha256(i.encode()).hexdigest())
            hashes[1].append(hashlib.sha256(d.encode()).hexdigest())
            if with_text:
                ids.append(i)
                decoded.append(d)
        return [b.column(0), n, *hashes, *([ids, decoded] if with_text else [])]

    out = per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, ddl, schema)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
