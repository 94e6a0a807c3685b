"""Chat formatting with a grammar round trip.

The template is a small deterministic grammar::

    conversation = turn*
    turn         = "<<SYS>>" text "<</SYS>>"           role system
                 | "[INST]"  text "[/INST]"            role user
                 | "<s>"     text "</s>"               role assistant
                 | "[ROLE " n "]" role text "[/ROLE]"  any other role of n characters

Each turn is first rendered with its text as it is and parsed again.  If the
parser does not recover exactly that turn, the control strings in the text are
escaped (one backslash after the first character of each; strings that already
look escaped get one more) and the turn is parsed again.  The parser removes
one backslash everywhere, so the second form always comes back identical.

Rendering and the per-turn round trip run where the rows are.  Then the rows
of a conversation meet in turn order and are streamed: formatted text is
parsed and hashed turn by turn, never held whole, so that a conversation with
a third of all rows needs no more memory than a short one.

Cases: null text or role is empty; rows of a null ``conv_id`` form one
conversation; null turns come first; rows of one turn number are ordered by
role, then text, and repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm._common import batch, per_batch, strings

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "[/ROLE]")
_CONTROL = sorted({m for pair in [*MARKS.values(), OTHER] for m in pair}, key=len, reverse=True)
_PLAIN = re.compile("|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in _CONTROL))
_ESCAPED = re.compile("|".join(re.escape(m[0]) + r"\\+" + re.escape(m[1:]) for m in _CONTROL))
_OPEN = re.compile("|".join(re.escape(m) for m in (p[0] for p in MARKS.values())) + r"|\[ROLE (\d+)\]")

#: The conversation that the query adds: both texts are control strings.
EXTRA = (-1, "</s>[INST] ok [/INST]")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(role: str, text: str, escaped: bool) -> str:
    e = escape if escaped else str
    if role in MARKS:
        return MARKS[role][0] + e(text) + MARKS[role][1]
    return f"{OTHER[0]}{len(role)}]{role}{e(text)}{OTHER[1]}"


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of formatted text; None where it is not of the grammar."""
    at, turns = 0, []
    while at < len(formatted):
        opened = _OPEN.match(formatted, at)
        if not opened:
            return None
        begin = opened.end() + int(opened[1] or 0)
        role, close = next(((r, p[1]) for r, p in MARKS.items() if p[0] == opened[0]), (formatted[opened.end():begin], OTHER[1]))
        end = formatted.find(close, begin)
        if end < 0:
            return None
        turns.append((role, unescape(formatted[begin:end])))
        at = end + len(close)
    return turns


def format_turn(role: str, text: str) -> str:
    """The first rendering that parses back to exactly this turn."""
    for escaped in (False, True):
        out = render(role, text, escaped)
        if parse(out) == [(role, text)]:
            return out
    raise ValueError(f"no rendering of {role!r} turn round-trips")


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string())])
_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted) of every row; concatenated in turn
    order, ``formatted`` is the formatted conversation."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return per_batch(rows, lambda b: [b.column(0), b.column(1), b.column(2), [format_turn(r, t) for r, t in zip(strings(b.column(2)), strings(b.column(3)), strict=True)]],
                     "conv_id long, turn long, role string, formatted string", _TURNS)


class _Reader:
    """Digests of one conversation, read back from its formatted text."""

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode())

    def row(self, conv):
        return conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from formatted turns."""
    rows = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "formatted")

    def run(batches):
        now, reader, done = None, None, []
        for b in batches:
            for conv, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                if reader is None or conv != now:
                    if reader:
                        done.append(reader.row(now))
                    now, reader = conv, _Reader()
                reader.feed(text)
            if len(done) > 1000:
                yield batch(_OUT, *map(list, zip(*done, strict=True)))
                done = []
        if reader:
            done.append(reader.row(now))
        if done:
            yield batch(_OUT, *map(list, zip(*done, strict=True)))

    return rows.select("conv_id", "formatted").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Format all conversations and conversation -1, and read them back."""
    extra = spark.range(2).select(F.lit(EXTRA[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA[1]).alias("text"))
    return read_back(format_turns(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))
