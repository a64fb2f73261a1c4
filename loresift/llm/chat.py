"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes three segments: a header that names the role, the text, and
an end mark. Only the texts of roles under the template's loss are marked for
training. The machine follows the roles and notes where a conversation breaks
the turn order; such a conversation is formatted all the same.

Inside headers and texts, control strings are escaped so that none is left,
and parsing gives back the exact role and text.

Defined results: turns are taken by ``turn`` (null first), ties by role and
text, repeated rows once each. A null text or role is empty. A role that the
template does not know has the template's other header, and is out of order.
An empty table gives an empty result. Other columns are ignored.

Memory is bounded by the longest turn: rows stream through sorted partitions,
and a conversation is never held as a whole. Its turns meet in one task, as
the order of its text requires.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import filled, small_batches


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like, and which turn orders it allows."""

    header: str = "### {}: "
    end: str = "</turn>\n"
    names: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    other: str = "Role {}"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state: {role: next state}; a state is named after the role before it.
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    last: frozenset[str] = frozenset({"assistant"})

    @cached_property
    def controls(self) -> list[str]:
        """Strings that may not occur inside a text: the marks and the backslash of the escapes."""
        before, after = self.header.split("{}")
        known = [before + name + after for name in self.names.values()]
        marks = [self.end, self.end.strip(), *known, before + self.other.split("{}")[0]]
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))

    @cached_property
    def _pattern(self) -> re.Pattern:
        return re.compile("|".join([re.escape("\\"), *map(re.escape, self.controls)]))

    def escape(self, text: str) -> str:
        """A backslash is doubled; the first character of a control string becomes a backslash, its code and ``;``."""
        done, at = [], 0
        while found := self._pattern.search(text, at):
            first = found[0][0]
            done += [text[at : found.start()], "\\\\" if first == "\\" else f"\\{ord(first):x};"]
            at = found.start() + 1  # the rest may begin another control string
        return "".join([*done, text[at:]])

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(?:\\|([0-9a-f]+);)", lambda m: chr(int(m[1], 16)) if m[1] else "\\", text)

    def head(self, role: str) -> str:
        name = self.names.get(role)
        return self.header.format(self.other.format(self.escape(role)) if name is None else name)

    def role_of(self, head: str) -> str:
        before, after = self.header.split("{}")
        name = head[len(before) : len(head) - len(after)]
        for role, known in self.names.items():
            if name == known:
                return role
        return self.unescape(name[len(self.other.split("{}")[0]) :])


_SEGMENTS = "conv_id long, position long, segment int, text string, loss boolean, in_order boolean"
_READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "turns_in_order boolean, complete boolean"
)


def _schema(sql: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in sql.split(", "))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, weight = [], 0

    def made() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= chars:
            yield made()
            held, weight = [], 0
    if held:
        yield made()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _formatter(template: Template) -> Callable:
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, position, state = object(), 0, ""
        for row in _rows(batches):
            if row["conv_id"] != current:
                current, position, state = row["conv_id"], 0, ""
            role = row["role"]
            follows = template.order.get(state, {}).get(role)
            state = follows or role
            ordered = follows is not None
            learnt = role in template.loss_roles
            parts = ((template.head(role), False), (template.escape(row["text"]), learnt), (template.end, False))
            for number, (text, loss) in enumerate(parts):
                yield current, position, number, text, loss, ordered
            position += 1

    return lambda batches: _batches(segments(batches), _schema(_SEGMENTS))


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Text segments of each conversation in order: conv_id, position of the turn, segment, text, loss, in_order."""
    small_batches(rows)
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        filled(F.col("role")).alias("role"),
        filled(F.col("text")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatter(template or Template()), _SEGMENTS)


def _reader(template: Template) -> Callable:
    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, state = object(), None

        def result() -> tuple:
            return (current, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(),
                    state["chars"], state["in_order"], state["role"] in template.last)

        for row in _rows(batches):
            if row["conv_id"] != current or state is None:
                if state is not None:
                    yield result()
                current = row["conv_id"]
                state = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0,
                         "in_order": True, "role": ""}
            text = row["text"]
            state["chars"] += len(text)
            state["in_order"] &= row["in_order"]
            if row["segment"] == 0:
                state["role"] = template.role_of(text)
                state["turns"] += 1
            elif row["segment"] == 1:
                plain = template.unescape(text)
                state["all"].update(f"{state['role']}\n{plain}\n".encode())
                if row["loss"]:
                    state["loss"].update(plain.encode())
                    state["loss_chars"] += len(plain)
            elif text != template.end:
                raise ValueError(f"conversation {current}: end mark expected, found {text!r}")
        if state is not None:
            yield result()

    return lambda batches: _batches(conversations(batches), _schema(_READ))


def read_conversations(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse stored segments back: one row of counts and digests per conversation."""
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "position", "segment")
    return ordered.mapInArrow(_reader(template or Template()), _READ)
