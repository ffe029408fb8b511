"""Chat formatting: a finite-state machine over roles, and a declarative template of text segments.

Turns stream through in order. Every turn becomes three segments (what opens it, its text, what
closes it), each with a loss flag; texts and roles are escaped so that the template's marks never
occur inside them, and reading the marks back gives the turns again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written.

    Both marks must begin with a character that `escaped` hides, and neither may begin the other;
    the first pair of `escaped` hides the escape character itself.
    """

    opening: str = "<|"
    after_role: str = "|>\n"
    closing: str = "</>\n"
    escape: str = "\\"
    escaped: tuple[tuple[str, str], ...] = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
    loss_roles: tuple[str, ...] = ("assistant",)
    # From each state, the role that may come next; a role is also the state it leads to.
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def hide(self, text: str) -> str:
        for plain, code in self.escaped:  # the escape character comes first
            text = text.replace(plain, code)
        return text

    def show(self, text: str) -> str:
        back = {code[len(self.escape) :]: plain for plain, code in self.escaped}
        return re.sub(re.escape(self.escape) + r"(.)", lambda m: back[m[1]], text, flags=re.DOTALL)


DEFAULT = Template()
SEGMENTS = "turn_no long, segment int, text string, loss boolean, problem string"
INNER = "_conv, _turn, _role, _text"


def _segments(batches: Iterator[pa.RecordBatch], template: Template, name: str) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by conversation and turn; the state is all that is carried from row to row."""
    fresh = object()
    current, state, number = fresh, "", 0
    for batch in batches:
        keys, out = batch.column(0).to_pylist(), [[] for _ in range(6)]
        for key, role, text in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != current:
                current, state, number = key, "", 0
            role, text = role or "", text or ""
            allowed = template.order.get(state, ())
            problem = None if role in allowed else f"{role or 'no role'} after {state or 'the start'}"
            loss = role in template.loss_roles
            for k, (part, flag) in enumerate((
                (template.opening + template.hide(role) + template.after_role, False),
                (template.hide(text), loss),
                (template.closing, False),
            )):
                for column, value in zip(out, (key, number, k, part, flag, problem), strict=True):
                    column.append(value)
            state, number = role, number + 1
        kinds = (batch.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            [name, *(f.split()[0] for f in SEGMENTS.split(", "))],
        )


def format_chats(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = DEFAULT
) -> DataFrame:
    """Segments of all conversations, in order within each: key, turn_no, segment, text, loss, problem.

    The text of a conversation is its segments one after the other; `loss` marks those to be
    learned; `problem` says which role came where the state machine allows another. Turns follow
    `turn` (null first), then role and text, so repeated rows and ties have one order. A null role
    or text counts as empty, a null key is a conversation of its own, an empty table gives none.

    Conversations are dealt by key and stream through sorted, spilling in Spark's sort: a very long
    one takes as long as its turns but never more memory than a batch.
    """
    kind = turns.schema[key].dataType.simpleString()
    rows = turns.select(
        F.col(key).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text")
    )
    ordered = rows.repartition("_conv").sortWithinPartitions(*INNER.split(", ")).select("_conv", "_role", "_text")
    return ordered.mapInArrow(lambda batches: _segments(batches, template, key), f"`{key}` {kind}, {SEGMENTS}")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, problems long"


class _Reader:
    """Reads one conversation back from its formatted text, segment by segment."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.problems = 0
        self.role: str | None = None  # of the open turn
        self.mark = re.compile(
            f"({re.escape(template.opening)}(.*?){re.escape(template.after_role)}|{re.escape(template.closing)})", re.DOTALL
        )

    def _body(self, part: str, loss: bool) -> None:
        if self.role is None:
            if part:
                raise ValueError("text outside a turn")
            return
        text = self.template.show(part)
        self.turns.update(text.encode())
        if loss:
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def read(self, segment: str, loss: bool) -> None:
        self.chars += len(segment)
        at = 0
        for mark in self.mark.finditer(segment):
            self._body(segment[at : mark.start()], loss)
            if mark[2] is not None:
                self.role = self.template.show(mark[2])
                self.turns.update(self.role.encode() + b"\n")
            else:
                self.turns.update(b"\n")
                self.n_turns, self.role = self.n_turns + 1, None
            at = mark.end()
        self._body(segment[at:], loss)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.problems


def _digest(batches: Iterator[pa.RecordBatch], template: Template, name: str) -> Iterator[pa.RecordBatch]:
    reader, current, kind, done = None, None, None, []

    def rows():
        columns = list(zip(*done, strict=True))
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [name, *(f.split()[0] for f in DIGEST.split(", "))],
        )

    for batch in batches:
        kind = batch.column(0).type
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for key, segment, text, loss, problem in zip(*columns, strict=True):
            if reader is None or key != current:
                if reader is not None:
                    done.append((current, *reader.row()))
                reader, current = _Reader(template), key
            reader.read(text, loss)
            reader.problems += segment == 0 and problem is not None
        if done:
            yield rows()
            done = []
    if reader is not None:
        done.append((current, *reader.row()))
        yield rows()


def read_chats(segments: DataFrame, key: str = "conv_id", template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, from the formatted segments alone: digests of its turns and of its learned text.

    The segments must come in the order `format_chats` gives, each conversation in one partition.
    """
    kind = segments.schema[key].dataType.simpleString()
    return segments.select(key, "segment", "text", "loss", "problem").mapInArrow(
        lambda batches: _digest(batches, template, key), f"`{key}` {kind}, {DIGEST}"
    )
