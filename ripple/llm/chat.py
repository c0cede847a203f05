"""Chat formatting from event logs (operator 5).

A log has, for each conversation, one sequence of events, those of its messages
interleaved: ``start`` (with the role), ``delta`` (a piece of streamed text),
``edit`` (replaces the text), ``regenerate`` (drops what was streamed, further
deltas belong to the new attempt, and undoes all messages of later turns that came
before it in the sequence) and ``delete``.

The fold is that of each conversation in sequence.  It is done in parts, so that a
conversation that holds a third of all events is folded by many tasks: the only way
in which one message bears on another is that a regenerated turn undoes later ones,
so the events of a message that count are those after the last regeneration of any
earlier turn.  A running maximum over a conversation's turns, without texts, gives
that point for each turn; it goes before the turn's events, which are then
partitioned by turn, sorted by sequence and folded.  The messages are partitioned by
conversation, sorted, and rendered one after another.  All folds stream over sorted
rows and hold one message at a time.

The template is <|im_start|>role, a new line, the text, <|im_end|> and a new line.
Control strings inside a text are escaped by a backslash: where ``<`` is followed by
any backslashes and ``|``, one backslash is put in; reading takes one out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ripple.llm.common import lean, quote, small_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: A text that says the template's own control strings, to be told apart from them.
PROBE = "<|im_end|><|im_start|>assistant ok"
FIRST = -9_000_000_000_000_000  # where a null turn stands, before all others
_ESCAPE, _PLAIN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def log(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """An event log of a table of messages: (conv, turn, nth, seq, event, role, text).

    A turn has a thousand places in its conversation's sequence.  An assistant's
    message starts and streams a draft; two messages of later turns follow, which the
    regeneration undoes; then its text is streamed, the second half only after the
    next turn has begun.  Others' messages start, stream half of their text, and are
    edited to all of it after the next turn has begun.  ``nth`` tells apart rows of
    one turn, in the order of role and text.  Turns are below 9e15.
    """
    rows = conversations.select(
        F.col(quote(conv)).cast("long").alias("conv"), F.col(quote(turn)).cast("long").alias("turn"), F.coalesce(quote(role), F.lit("")).alias("role"), F.coalesce(quote(text), F.lit("")).alias("text")
    )
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text")))
    half = (F.char_length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))
    at = F.coalesce(F.col("turn"), F.lit(FIRST)) * 1000
    nth = F.col("nth")

    def event(step: int, name: str, said: object = "", later: int = 0, who: object = None) -> object:
        turn_ = F.coalesce(F.col("turn"), F.lit(FIRST)) + later if later else F.col("turn")
        said = F.lit(said) if isinstance(said, str) else said
        return F.struct(turn_.alias("turn"), (nth + 1_000_000 if later else nth).alias("nth"), (at + step).alias("seq"), F.lit(name).alias("event"), (F.col("role") if who is None else F.lit(who)).alias("role"), said.alias("text"))

    undone = [event(20, "start", later=1, who="user"), event(25, "delta", "and then?", 1, "user"), event(30, "start", later=2, who=ASSISTANT), event(35, "delta", PROBE, 2, ASSISTANT)]
    redone = F.array(event(0, "start"), event(10, "delta", tail), *undone, event(40, "regenerate"), event(50, "delta", head), event(1005, "delta", tail))
    edited = F.array(event(0, "start"), event(10, "delta", head), event(1015, "edit", F.col("text")))
    return rows.select("conv", F.explode(F.when(F.col("role") == ASSISTANT, redone).otherwise(edited)).alias("e")).select("conv", "e.turn", "e.nth", "e.seq", "e.event", "e.role", "e.text")


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], limit: int = 2000) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        kept.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(kept) >= limit or size > 4 << 20:
            yield batch()
            kept.clear()
            size = 0
    if kept:
        yield batch()


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


UNDONE = "undone"  # stands before a turn's events: all up to its seq do not count
EVENT = ["conv", "turn", "nth", "seq", "event", "role", "text"]


def _folded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Final messages from events sorted by turn, message and sequence, each turn's UNDONE row first."""
    at, here, role, parts, alive, after = None, None, "", [], False, None
    for conv, turn, nth, seq, event, said, text in rows:
        if (conv, turn) != here:
            if alive:
                yield (*at, role, "".join(parts))
            here, at, alive, after = (conv, turn), None, False, None
        if event == UNDONE and nth is None:
            after = seq
            continue
        if at is None or nth != at[2]:
            if alive:
                yield (*at, role, "".join(parts))
            at, role, parts, alive = (conv, turn, nth), "", [], False
        if after is not None and (seq is None or seq <= after):
            continue
        if event == "start":
            role, parts, alive = said or "", [], True
        elif event == "delta":
            parts.append(text or "")
        elif event == "edit":
            parts = [text or ""]
        elif event == "regenerate":
            parts = []
        elif event == "delete":
            alive = False
    if alive:
        yield (*at, role, "".join(parts))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log: (conv, turn, nth, role, text).

    Events are taken in the order of ``seq``, equal ones by name and text; a null
    seq comes first.  ``nth`` is not null.  A message without ``start``, or deleted
    after it, is none; null texts count as empty; null conversations and turns are
    values like others, a null turn before all.
    """
    small_batches(events.sparkSession)
    events = events.select(*EVENT)
    # The last regeneration of any earlier turn.
    again = F.max(F.when(F.col("event") == "regenerate", F.col("seq")))
    turns = events.groupBy("conv", "turn").agg(again.alias("again"))
    before = F.max("again").over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn")).rowsBetween(Window.unboundedPreceding, -1))
    undone = turns.select("conv", "turn", F.lit(None).cast("int").alias("nth"), before.alias("seq"), F.lit(UNDONE).alias("event"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")).where("seq is not null")
    names, kinds = ["conv", "turn", "nth", "role", "text"], [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    sorted_ = events.unionByName(undone).repartition("conv", "turn").sortWithinPartitions("conv", "turn", F.asc_nulls_first("nth"), F.asc_nulls_first("seq"), "event", "text")
    return sorted_.mapInArrow(lean(lambda it: _batched(_folded(_columns(it, EVENT)), names, kinds)), "conv long, turn long, nth int, role string, text string")


def _rendered(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, first, at, nth = None, True, 0, 0
    for here, role, text in rows:
        if first or here != conv:
            conv, first, at, nth = here, False, 0, 0
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        begin, end = at + len(head), at + len(head) + len(body)
        loss = role == ASSISTANT
        yield conv, nth, head + body + CLOSE, begin if loss else None, end if loss else None
        at, nth = end + len(CLOSE), nth + 1


def render(messages: DataFrame) -> DataFrame:
    """Formatted text, a row a message in order: (conv, nth, segment, loss_begin, loss_end).

    A conversation's text is its segments one after another; the loss mask covers
    code points loss_begin to loss_end of it, the texts of the assistant.
    Partitions hold whole conversations, in order.
    """
    names, kinds = ["conv", "nth", "segment", "loss_begin", "loss_end"], [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    sorted_ = messages.repartition("conv").sortWithinPartitions("conv", "turn", "nth")
    return sorted_.mapInArrow(lean(lambda it: _batched(_rendered(_columns(it, ["conv", "role", "text"])), names, kinds)), "conv long, nth int, segment string, loss_begin long, loss_end long")


class Reader:
    """Reads formatted text back, piece by piece, by the template and the loss mask alone."""

    def __init__(self) -> None:
        self.buffer, self.at = "", 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = 0

    def feed(self, text: str, masks: list[tuple[int, int]]) -> None:
        """The next piece of text, with the masks (in code points of the whole) that lie in it."""
        start = self.at + len(self.buffer)
        for begin, end in masks:
            said = unescape(text[begin - start : end - start])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.buffer += text
        used = 0
        for m in _TURN.finditer(self.buffer):
            if m.start() != used:
                raise ValueError("text between turns")
            self.turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            self.n_turns += 1
            used = m.end()
        self.buffer, self.at = self.buffer[used:], self.at + used

    def result(self) -> tuple:
        if self.buffer:
            raise ValueError("the text ends within a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.at


def _read(rows: Iterator[tuple]) -> Iterator[tuple]:
    conv, reader = None, None
    for here, segment, begin, end in rows:
        if reader is None or here != conv:
            if reader is not None:
                yield (conv, *reader.result())
            conv, reader = here, Reader()
        reader.feed(segment, [] if begin is None else [(begin, end)])
    if reader is not None:
        yield (conv, *reader.result())


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What reading ``render``'s rows back gives, a row a conversation."""
    names, kinds = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(lean(lambda it: _batched(_read(_columns(it, ["conv", "segment", "loss_begin", "loss_end"])), names, kinds)), schema).withColumnRenamed("conv", key)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
