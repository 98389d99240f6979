"""Chat formatting with a template that is only rendered, never looked into.

``render`` turns a list of (role, text) into a string. The turns of a conversation are rendered
prefix by prefix; what an output adds to the one before is the new turn's span. Where a turn's
text lies in its span comes from two probes, renderings with two texts that share no character:
what both begin and end with is the template's. A prefix whose output does not continue the one
before shows a template that rewrites history. Then every turn's text is located in the last
output, by the same two probes for each turn, and a turn that leaves no trace has no span.

Rows are dealt by conversation, sorted by turn and streamed. A conversation is put out in parts;
one part holds what WINDOW turns add, and the prefixes that follow start with the CONTEXT turns
before, so a conversation with a third of all rows costs memory and time for a window, not for its
length squared. Conversations of up to WINDOW turns are rendered whole, in one part; in longer
ones a template must not look back further than CONTEXT turns.

The production template, ``render_turns``, is ``### role: text</turn>`` and a line end per turn.
In roles and texts ``\\`` becomes ``\\\\``, ``##`` becomes ``#\\#`` and ``</`` becomes ``<\\/``, so no
control string can occur there, and dropping one backslash of each brings the text back.

Defined cases: null texts and roles are empty; a null conversation number is a conversation of its
own, sorted first; rows of one turn are ordered by role and text, and repeated rows are turns of
their own; null turns come first; texts of any length are kept whole; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices

Messages = list[tuple[str, str]]
Render = Callable[[Messages], str]

WINDOW, CONTEXT = 64, 4
PROBES = ("\ue000", "\ue001")
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render_turns(messages: Messages) -> str:
    return "".join(f"{OPEN}{escape(role).replace(':', chr(92) + ':')}{COLON}{escape(text)}{CLOSE}" for role, text in messages)


def parse_turns(formatted: str) -> Messages:
    """The turns of a formatted part, read back from its control strings alone."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        m = re.match(r"### ((?:\\.|[^\\:])*): ", turn, re.DOTALL)
        if not m:
            raise ValueError(f"no turn begins with {turn[:40]!r}")
        out.append((unescape(m[1]), unescape(turn[m.end() :])))
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning; slices are compared, not characters."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def frame(render: Render, messages: Messages, at: int) -> tuple[str, str] | None:
    """What stands before and after the text of turn ``at`` in the output; None if it leaves no trace."""
    a, b = (render([*messages[:at], (messages[at][0], p), *messages[at + 1 :]]) for p in PROBES)
    if a == b:
        return None
    start = _common(a, b)
    return a[:start], a[len(a) - _common(a[:start:-1], b[:start:-1]) :]


def located(output: str, around: tuple[str, str] | None) -> tuple[int, int] | None:
    """The text's span in ``output``, if it stands between what the probes have shown."""
    if around and len(output) >= sum(map(len, around)) and output.startswith(around[0]) and output.endswith(around[1]):
        return len(around[0]), len(output) - len(around[1])
    return None


class Window:
    """The turns rendered so far: the last part's CONTEXT turns, then up to WINDOW new ones."""

    def __init__(self, render: Render) -> None:
        self.render, self.messages, self.known = render, [], 0
        self.output = self.base = ""
        self.spans: list[tuple[int, int] | None] = []
        self.rewritten: int | None = None

    def add(self, role: str, text: str) -> None:
        self.messages.append((role, text))
        output = self.render(self.messages)
        if not output.startswith(self.output) and self.rewritten is None:
            self.rewritten = len(self.messages) - 1 - self.known
        self.spans.append(located(output, frame(self.render, self.messages, len(self.messages) - 1)))
        self.output = output

    def part(self) -> tuple[str, list[tuple[str, int | None, int | None]], int | None]:
        """What the new turns add, the role and the text's span of each, and the first turn that rewrote history."""
        spans, base = self.spans, self.base
        if self.rewritten is not None:
            spans = [located(self.output, frame(self.render, self.messages, i)) for i in range(self.known, len(self.messages))]
            base = self.output[: _common(self.base, self.output)]
        out = [(role, *((s[0] - len(base), s[1] - len(base)) if s and s[0] >= len(base) else (None, None))) for (role, _), s in zip(self.messages[self.known :], spans, strict=True)]
        return self.output[len(base) :], out, self.rewritten

    def next(self) -> None:
        self.messages = self.messages[-CONTEXT:]
        self.known, self.spans, self.rewritten = len(self.messages), [], None
        self.output = self.base = self.render(self.messages)


_SPAN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("turns", pa.list_(_SPAN)), ("rewritten_at", pa.int32())])
PART_DDL = "conv_id bigint, part int, formatted string, turns array<struct<role: string, start: bigint, end: bigint>>, rewritten_at int"
#: Characters of formatted text after which a batch of parts is handed on.
BATCH_CHARS = 8 << 20


def _parts(render: Render) -> Callable:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, part, window = None, 0, None

        def close() -> tuple:
            formatted, turns, rewritten = window.part()
            return key[0], part, formatted, [{"role": r, "start": a, "end": b} for r, a, b in turns], None if rewritten is None else part * WINDOW + rewritten

        for batch in slices(batches):
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if window is None or key != (conv,):
                    if window:
                        yield close()
                    key, part, window = (conv,), 0, Window(render)
                elif len(window.messages) - window.known == WINDOW:
                    yield close()
                    part += 1
                    window.next()
                window.add(role, text)
        if window:
            yield close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in parts(batches):
            held.append(row)
            size += len(row[2])
            if size >= BATCH_CHARS or len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PART, strict=True)], schema=_PART)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PART, strict=True)], schema=_PART)

    return run


def format_conversations(conversations: DataFrame, render: Render = render_turns) -> DataFrame:
    """(conv_id, part, formatted, turns, rewritten_at): ``turns`` has each turn's role and the span
    of its text in ``formatted``; the loss mask is the spans of assistant turns. ``rewritten_at`` is
    the first turn, from 0, whose output changed what stood before, or null. Parts of a
    conversation lie in one partition, in order."""
    empty = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    rows = conversations.select(quoted("conv_id").cast("bigint").alias("conv_id"), quoted("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_parts(render), PART_DDL)


_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of parts in order; a conversation's digests go on from part to part."""
    done, key, state = [], None, None

    def close() -> tuple:
        return key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    for batch in slices(batches, 64):
        for conv, formatted, turns in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if key != (conv,):
                if key:
                    done.append(close())
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse_turns(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for t in turns:
                if t["role"] == "assistant" and t["start"] is not None:
                    loss = unescape(formatted[t["start"] : t["end"]])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
            state[4] += len(formatted)
        if len(done) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _BACK, strict=True)], schema=_BACK)
            done = []
    if key:
        done.append(close())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _BACK, strict=True)], schema=_BACK)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from the formatted parts alone, as
    format_conversations() puts them out (a conversation's parts in one partition, in order)."""
    return parts.mapInArrow(_read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
