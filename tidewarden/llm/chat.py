"""Chat formatting: a state machine over roles and a declarative template give text segments with loss flags.

A `Template` says for each role what stands before and after a text and whether the text counts for the
loss, and which roles may follow which. `segments` sorts the turns by conversation and turn, walks each
partition as a stream and emits, per turn, the head, the escaped text and the tail as segments. Control
strings inside texts are escaped reversibly: a backslash is doubled, and one is put behind the first
character of every control string, so the concatenated segments can be read back turn by turn with
`read_back`, whatever the texts hold. No conversation is gathered: only its running state is kept, so a
conversation of any length passes through in bounded memory, and a lost task starts its partition again.

Roles outside the template are written by `other`, with the escaped role in the head. A conversation is
`valid` while every turn's role may follow the one before, from the state "start", and complete at an
accepting role. Defined cases: a null text or role is an empty one; null conversation ids form one
conversation and null turns come first; turns with equal numbers are ordered by role and text, repeated
rows included; an empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    head: str
    tail: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    other: tuple[str, str, str]  # before the role, between role and text, after the text
    follows: dict[str, tuple[str, ...]] = field(default_factory=dict)
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        found = {s for t in self.turns.values() for s in (t.head, t.tail)} | set(self.other)
        return sorted({p for s in found for p in re.findall(r"\S+", s)}, key=lambda s: (-len(s), s))


#: Fixed values of a widespread instruction format.
INSTRUCTION = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", "</s>", loss=True),
    },
    other=("<<ROLE>>", "<</ROLE>>\n", "\n<</TURN>>\n"),
    follows={
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
)

SEGMENT_COLUMNS = ("seq", "role", "kind", "text", "loss", "valid", "complete")


def escaper(template: Template):
    """A function that escapes a text: control strings are broken behind their first character."""
    controls = "|".join(re.escape(c[1:]) for c in template.controls() if len(c) > 1)
    firsts = "".join(sorted({re.escape(c[0]) for c in template.controls() if len(c) > 1}))
    whole = "|".join(re.escape(c) for c in template.controls() if len(c) > 1)
    pattern = re.compile(rf"\\|(?=(?:{whole}))[{firsts}]") if controls else re.compile(r"\\")
    return lambda text: pattern.sub(lambda m: m[0] + ESCAPE, text)


_ESCAPED = re.compile(r"\\(\\?)")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(turns: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """conv_id, seq (order in the conversation), role, kind (head, text, tail), text, loss, valid (up to
    this turn) and complete (valid and at an accepting role); rows of a conversation stand together and in
    order within one partition."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    role = F.coalesce(F.col("role"), F.lit("")).alias("role")
    ordered = turns.select("conv_id", "turn", role, text).repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = escaper(template)
        before, state, seq = object(), "start", 0
        for batch in batches:
            ids, out = batch.column("conv_id"), {c: [] for c in SEGMENT_COLUMNS}
            numbers = []
            rows = zip(ids.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for i, (conv, name, words) in enumerate(rows):
                if conv != before:
                    before, state, seq = conv, "start", 0
                state = name if state is not None and name in template.follows.get(state, ()) else None
                turn = template.turns.get(name)
                if turn is None:
                    a, b, c = template.other
                    turn = Turn(a + escape(name) + b, c)
                for what, piece, loss in (
                    ("head", turn.head, False),
                    ("text", escape(words), turn.loss),
                    ("tail", turn.tail, False),
                ):
                    numbers.append(i)
                    row = (seq, name, what, piece, loss, state is not None, state in template.accepting)
                    for column, value in zip(SEGMENT_COLUMNS, row, strict=True):
                        out[column].append(value)
                    seq += 1
            columns = [ids.take(pa.array(numbers, pa.int64()))]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            columns += [pa.array(out[c], k) for c, k in zip(SEGMENT_COLUMNS, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", *SEGMENT_COLUMNS])

    schema = f"conv_id {kind}, seq long, role string, kind string, text string, loss boolean, valid boolean, complete boolean"
    return ordered.mapInArrow(write, schema)


class Reader:
    """Reads turns back from formatted text that comes piece by piece: (role, text) pairs."""

    def __init__(self, template: Template):
        self.marks = [(role, t.head, t.tail) for role, t in template.turns.items()]
        self.other = template.other
        self.unread = ""

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """The turns that are complete by now. Text is looked at again only from the current turn's start."""
        self.unread += piece
        at = 0
        while at < len(self.unread):
            found = self._turn(at)
            if found is None:
                break
            role, text, at = found
            yield role, text
        self.unread = self.unread[at:]
        if last and self.unread:
            raise ValueError(f"not a formatted turn: {self.unread[:80]!r}")

    def _turn(self, at: int) -> tuple[str, str, int] | None:
        for role, head, tail in self.marks:
            if self.unread.startswith(head, at):
                end = self.unread.find(tail, at + len(head))
                if end < 0:
                    return None
                return role, unescape(self.unread[at + len(head) : end]), end + len(tail)
        a, b, c = self.other
        if self.unread.startswith(a, at):
            middle = self.unread.find(b, at + len(a))
            end = self.unread.find(c, middle + len(b)) if middle >= 0 else -1
            if end >= 0:
                text = unescape(self.unread[middle + len(b) : end])
                return unescape(self.unread[at + len(a) : middle]), text, end + len(c)
        return None


def digests(formatted: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Per conversation, from its segments alone: turns read back from the formatted text and hashed, the
    text under the loss mask unescaped and hashed, and the length of the formatted text. Takes the result of
    `segments` as it stands, with its order within partitions."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Digest(template)
        for batch in batches:
            done = []
            names = ("conv_id", "seq", "text", "loss", "valid", "complete")
            for conv, seq, text, loss, valid, complete in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if seq == 0:
                    if now.begun:
                        done.append(now.row())
                    now = _Digest(template, conv)
                now.add(text, loss, valid, complete)
            if done:
                yield _rows(done, batch.schema.field("conv_id").type)
            conv_type = batch.schema.field("conv_id").type
        if now.begun:
            yield _rows([now.row()], conv_type)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, complete boolean"
    return formatted.mapInArrow(read, schema)


class _Digest:
    def __init__(self, template: Template, conv=None):
        self.conv, self.begun, self.n_turns, self.loss_chars, self.formatted = conv, False, 0, 0, 0
        self.turns, self.loss, self.reader = hashlib.sha256(), hashlib.sha256(), Reader(template)
        self.valid = self.complete = False

    def add(self, text: str, loss: bool, valid: bool, complete: bool) -> None:
        self.begun, self.valid, self.complete = True, valid, complete
        self.formatted += len(text)
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.read(text)

    def read(self, text: str, last: bool = False) -> None:
        for role, said in self.reader.feed(text, last):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())

    def row(self) -> tuple:
        self.read("", last=True)
        return (
            self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.formatted, self.valid, self.complete,
        )


def _rows(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete"]
    kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    arrays = [pa.array(list(v), k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)
