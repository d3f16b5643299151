"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events (conv_id, seq, kind, turn, role, text):
* `delta` appends its text to the message of its turn, as streamed answers do;
* `edit` replaces the message of its turn and drops all later turns, which answered the old one;
* `regenerate` drops the message of its turn and all later ones; deltas then build it anew.

So an event survives if no later edit or regeneration is at its turn or an earlier one. That is one running minimum over
the log in reverse order. The survivors, sorted by turn and sequence, are folded into messages as they stream by, and each
message is rendered at once as a segment of its own. Spark partitions the log by conversation and sorts it, spilling to
disk if need be; a task holds one message at a time, so neither many nor long conversations need memory. One conversation
is read by one task, since its digests run over all of its text in order.

Template: `<|role|>` and a line feed, the text, `</s>` and a line feed. In roles and texts a backslash follows each `<`,
`[`, `|` and backslash, so that no control string of this or of common other templates can appear, and taking it out
again gives the text back. The loss mask covers the texts of assistant messages.

Null texts and roles are empty. Events with equal sequence numbers are ordered by kind, turn, role and text; repeated rows
are events of their own. A null turn comes before all others, a null conv_id is a conversation. Conversations without a
surviving message have no row. Empty logs give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import batch_of, ship

EVENTS = ["conv_id", "seq", "kind", "turn", "role", "text"]
SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.large_string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)
SEGMENT = "conv_id long, position long, segment string, loss_start long, loss_end long"
DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ESCAPED = re.compile(r"([<\[|\\])\\")
_PLAIN = re.compile(r"([<\[|\\])")
_SEGMENT = re.compile(r"<\|((?:[<\[|\\]\\|[^<\[|\\])*)\|>\n((?:[<\[|\\]\\|[^<\[|\\])*)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message as a segment, and where its loss mask begins and ends (in characters; empty unless an assistant's)."""
    head = f"<|{escape(role)}|>\n"
    body = escape(text)
    end = len(head) + len(body) if role == "assistant" else len(head)
    return f"{head}{body}</s>\n", len(head), end


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    found = _SEGMENT.fullmatch(segment)
    if found is None:
        raise ValueError("not a rendered message")
    return unescape(found[1]), unescape(found[2])


def survivors(events: DataFrame) -> DataFrame:
    """The events that no later edit or regeneration takes back."""
    turn = F.coalesce(F.col("turn"), F.lit(-(1 << 62)))
    resets = F.when(F.col("kind").isin("edit", "regenerate"), turn)
    order = [F.col(c).desc() for c in ("seq", "kind", "turn", "role", "text")]
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    alive = events.select(*EVENTS).withColumn("reset", F.min(resets).over(later))
    return alive.where((F.col("reset").isNull() | (turn < F.col("reset"))) & (F.col("kind") != "regenerate")).drop("reset")


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]], bool]]:
    """(conversation, message, is the first of its conversation) from survivors sorted by conversation and turn."""
    key, role, texts = None, "", []
    started, last = False, None
    for batch in batches:
        for conv, turn, who, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if started and (conv, turn) == key:
                texts.append(text or "")
                continue
            if started:
                yield key[0], role, "".join(texts), last != (key[0],)
                last = (key[0],)
            started, key, role, texts = True, (conv, turn), who or "", [text or ""]
    if started:
        yield key[0], role, "".join(texts), last != (key[0],)


def _render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size, position = [], 0, 0
    for conv, role, text, first in _messages(batches):
        position = 0 if first else position + 1
        segment, start, end = render(role, text)
        rows.append((conv, position, segment, start, end))
        size += len(segment)
        if size > 1 << 20:
            yield batch_of(SEGMENTS, list(zip(*rows, strict=True)))
            rows, size = [], 0
    if rows:
        yield batch_of(SEGMENTS, list(zip(*rows, strict=True)))


def format_chat(events: DataFrame) -> DataFrame:
    """Rendered messages: conv_id, position, segment, loss_start, loss_end (characters within the segment).

    A conversation's segments in the order of `position` are its formatted text. Rows of a conversation stand together
    and in order within a partition, so a narrow step may read them as a stream.
    """
    ship(events.sparkSession)
    rows = survivors(events).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return rows.select("conv_id", "turn", "role", "text").mapInArrow(_render, SEGMENT.replace("string", "string"))


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, end: int) -> None:
        role, text = parse(segment)
        masked = unescape(segment[start:end])
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows = None, []
    for batch in batches:
        for conv, position, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if position == 0:
                if now:
                    rows.append(now.row())
                now = _Digest(conv)
            now.add(segment, start, end)
        if len(rows) > 10_000:
            yield batch_of(DIGESTS, list(zip(*rows, strict=True)))
            rows = []
    if now:
        rows.append(now.row())
    if rows:
        yield batch_of(DIGESTS, list(zip(*rows, strict=True)))


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, counts and digests read back from the output of `format_chat`."""
    return segments.mapInArrow(_digest, DIGEST)


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as logs: every row is one event, in the order of turns.

    Rows that share a turn are messages of their own, in the order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("seq", place)
    return rows.select("conv_id", "seq", F.lit("delta").alias("kind"), F.col("seq").alias("turn"), "role", "text")
