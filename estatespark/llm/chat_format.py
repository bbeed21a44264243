"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template.

Turns come sorted by conversation and turn, and are formatted as they stream by: the state machine needs the state only, so a
conversation of any length is never held. Each turn gives its segments, its state and whether the order allowed it.

Control strings inside texts are broken up by an escape, so no text can forge a mark, and the escape can be taken back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPE = "\\"
BREAK = "\\|"
START = "start"


@dataclass(frozen=True)
class Mark:
    """What stands before and after a role's text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role; `other` formats any role not named, its name in place of {role}. `order` has the roles that may follow each."""

    roles: Mapping[str, Mark]
    other: Mark
    order: Mapping[str, frozenset[str]]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [*self.roles.values(), self.other]
        spelled = {s.strip() for m in marks for part in (m.before, m.after) for s in part.split("{role}")}
        object.__setattr__(self, "controls", tuple(sorted(spelled - {""}, key=len, reverse=True)))
        edges = [s for m in marks for part in (m.before, m.after) for s in part.split("{role}")]
        for control in self.controls:
            if ESCAPE in control or len(control) < 2:
                raise ValueError(f"{control!r} can't be a mark")
            for cut in range(1, len(control)):
                if any(e.endswith(control[:cut]) or e.startswith(control[cut:]) for e in edges if e):
                    raise ValueError(f"{control!r} could arise where a text meets a mark")
                if any(other.startswith(control[cut:]) for other in self.controls):
                    raise ValueError(f"{control!r} can overlap another mark")

    def escape(self, text: str) -> str:
        text = text.replace(ESCAPE, ESCAPE + ESCAPE)
        for control in self.controls:
            if control in text:
                text = text.replace(control, control[0] + BREAK + control[1:])
        return text

    def unescape(self, text: str) -> str:
        if ESCAPE not in text:
            return text
        return regex.sub(r"\\([\\|])", lambda m: ESCAPE if m[1] == ESCAPE else "", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) pieces of a turn."""
        mark = self.roles.get(role)
        if mark is None:
            mark = Mark(self.other.before.replace("{role}", self.escape(role)), self.other.after, self.other.loss)
        return [(mark.before, False), (self.escape(text), mark.loss), (mark.after, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """(role, text) of a formatted turn."""
        for role, mark in self.roles.items():
            if formatted.startswith(mark.before) and formatted.endswith(mark.after):
                return role, self.unescape(formatted[len(mark.before) : len(formatted) - len(mark.after)])
        head, tail = self.other.before.split("{role}")
        end = formatted.index(tail, len(head))
        inner = formatted[end + len(tail) : len(formatted) - len(self.other.after)]
        return self.unescape(formatted[len(head) : end]), self.unescape(inner)


INSTRUCT = Template(
    roles={
        "system": Mark("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Mark("[INST] ", " [/INST]"),
        "assistant": Mark("<s> ", " </s>\n", loss=True),
    },
    other=Mark("[ROLE] {role} [/ROLE] ", " [/TURN]\n"),
    order={
        START: frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
)

SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())]))


def format_turns(
    turns: DataFrame, template: Template = INSTRUCT, conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """One row per turn: conv, turn, role, segments, in_order.

    Turns of a conversation go by turn, then by role and text; a missing turn number comes first. Missing roles and texts count as
    empty, and roles that the template doesn't name are formatted by its `other` mark and are never in order. After a turn out
    of order the machine goes on from that turn's role. Rows without a conversation id are one conversation. Repeated rows
    are repeated turns.
    """
    source = {"conv": conv_column, "turn": turn_column, "role": role_column, "text": text_column}
    narrow = turns.select(*[F.col(f"`{c}`").alias(n) for n, c in source.items()])
    sorted_turns = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = T.StructType(
        [narrow.schema["conv"], narrow.schema["turn"], T.StructField("role", T.StringType()), T.StructField("segments", SEGMENTS),
         T.StructField("in_order", T.BooleanType())]
    )
    return sorted_turns.mapInArrow(_formatting(template), schema).withColumnsRenamed({"conv": conv_column, "turn": turn_column})


def _formatting(template: Template) -> Callable:
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]):
        last, state = object(), START
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = [t or "" for t in batch.column(3).to_pylist()]
            segments, allowed = [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), roles, texts):
                if conv != last:
                    last, state = conv, START
                allowed.append(role in template.order.get(state, ()))
                state = role
                segments.append([{"text": s, "loss": loss} for s, loss in template.segments(role, text)])
            columns = [batch.column(0), batch.column(1), pa.array(roles), pa.array(segments, kind), pa.array(allowed)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "turn", "role", "segments", "in_order"])

    return run


def read_back(formatted: DataFrame, template: Template = INSTRUCT, conv_column: str = "conv_id") -> DataFrame:
    """Per conversation, from the segments alone: n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars,
    loss_sha256 (the text under the loss flags, unescaped), formatted_chars, in_order.

    `formatted` comes straight from `format_turns`, whose tasks hold whole conversations in order; digests take up turn after turn.
    """
    kind = formatted.schema[conv_column].dataType
    long, text = T.LongType(), T.StringType()
    fields = [("n_turns", long), ("turns_sha256", text), ("loss_chars", long), ("loss_sha256", text), ("formatted_chars", long)]
    schema = T.StructType([T.StructField(conv_column, kind), *[T.StructField(n, t) for n, t in fields], T.StructField("in_order", T.BooleanType())])
    return formatted.select(conv_column, "segments", "in_order").mapInArrow(_reading(template, schema), schema)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars, self.in_order = conv, 0, 0, 0, True
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return (self.conv, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.in_order)


def _reading(template: Template, schema: T.StructType) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]):
        open_conv = None
        for batch in batches:
            done = []
            for conv, segments, allowed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if open_conv is None or conv != open_conv.conv:
                    if open_conv is not None:
                        done.append(open_conv.row())
                    open_conv = _Digest(conv)
                whole = "".join(s["text"] for s in segments)
                role, text = template.read(whole)
                learnt = "".join(template.unescape(s["text"]) for s in segments if s["loss"])
                open_conv.turns += 1
                open_conv.turns_hash.update(f"{role}\n{text}\n".encode())
                open_conv.loss += len(learnt)
                open_conv.loss_hash.update(learnt.encode())
                open_conv.chars += len(whole)
                open_conv.in_order &= allowed
            yield rows(done)
        if open_conv is not None:
            yield rows([open_conv.row()])

    return run
