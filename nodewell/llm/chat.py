"""Chat formatting: a finite-state machine over roles, segments with loss flags from a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nodewell.llm.workers import tidy


@dataclass(frozen=True)
class Template:
    """begin opens a conversation; turns has per role what stands before and after a turn's text, and whether the
    text counts for the loss. Roles without an entry use `other`, whose opening holds {role}. Every opening starts
    and every closing ends with a control string, with a space between it and the text."""

    begin: str = "<s>"
    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>> ", " <</SYS>>", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("[ANSWER] ", " </s>", True),
        }
    )
    other: tuple[str, str, bool] = ("[ROLE] {role} [TEXT] ", " [/ROLE]", False)
    #: From a state (the last role, "" at the start) to the roles that may follow; the last of a conversation must be in `ends`.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        parts = [self.begin, *[x for a, b, _ in [*self.turns.values(), self.other] for x in (a.replace("{role}", " "), b)]]
        return sorted({c for p in parts for c in p.split()}, key=len, reverse=True)


class Marks:
    """Escaping and reading for a template. A backslash is doubled, and one is put after the first character wherever a
    control string starts, so that no control string is left in a text and a text is got back by dropping them."""

    def __init__(self, template: Template):
        self.template = template
        any_control = "|".join(map(re.escape, template.controls()))
        self._start = re.compile(f"(?=(?:{any_control}))(.)", re.S)
        self._drop = re.compile(r"\\(.)", re.S)

    def escape(self, text: str) -> str:
        return self._start.sub(lambda m: m[1] + "\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return self._drop.sub(r"\1", text)

    def parts(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn: opening, text, closing."""
        before, after, loss = self.template.turns.get(role, self.template.other)
        if role not in self.template.turns:
            before = before.replace("{role}", self.escape(role))
        return [(before, False), (self.escape(text), loss), (after, False)]

    def closings(self) -> tuple[str, ...]:
        return tuple(after for _, after, _ in [*self.template.turns.values(), self.template.other])

    def read(self, text: str, at: int = 0) -> tuple[str, str, int]:
        """(role, text, end) of the formatted turn that starts at a place; escaped texts hold no closing."""
        for role, (before, after, _) in self.template.turns.items():
            if text.startswith(before, at) and (end := text.find(after, at + len(before))) >= 0:
                return role, self.unescape(text[at + len(before) : end]), end + len(after)
        head, middle = self.template.other[0].split("{role}")
        after = self.template.other[1]
        if not text.startswith(head, at) or (end := text.find(after, at)) < 0:
            raise ValueError(f"not a turn of this template: {text[at : at + 40]!r}")
        role, _, own = text[at + len(head) : end].partition(middle)
        return self.unescape(role), self.unescape(own), end + len(after)


def format_conversations(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment: conv, seg (from 0), turn_no (-1 for the opening), role, text, loss, fault.

    The concatenated texts of a conversation, by seg, are its formatted form. fault is null or says why the machine
    does not allow the turn (on its first segment), or the end (on its last): the turn is formatted all the same.
    Rows go to tasks by conversation and pass in order, one at a time, so a conversation of any length needs no memory.
    Null text and role: empty. Turns are ordered by turn (null first), then role and text; repeated rows are turns of
    their own. All rows with a null conv are one conversation.
    """
    template = template or Template()
    marks_of = template

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(marks_of)
        state, now, seg, no = "", object(), 0, 0
        kind = pa.int64()
        held: list | None = None  # the last segment waits, as the end may be at fault
        for b in batches:
            out: list[list] = []
            for c, r, t in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if c != now:
                    if held:
                        out.append(_ended(held, state, marks_of))
                        held = None
                    now, state, seg, no = c, "", 1, 0
                    out.append([c, 0, -1, None, marks_of.begin, False, None])
                if held:
                    out.append(held)
                fault = None if r in marks_of.follows.get(state, ()) else f"{r or 'no role'} after {state or 'the start'}"
                parts = marks.parts(r, t)
                for i, (piece, loss) in enumerate(parts):
                    row = [c, seg, no, r, piece, loss, fault if i == 0 else None]
                    seg += 1
                    if i < len(parts) - 1:
                        out.append(row)
                    else:
                        held = row
                state, no = r, no + 1
            kind = b.schema.field(0).type
            yield _segments(out, kind)
        if held:
            yield _segments([_ended(held, state, marks_of)], kind)

    kind = df.schema[conv].dataType.simpleString()
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("_n"), *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "_n", "role", "text").select("conv", "role", "text")
    return dealt.mapInArrow(tidy(run), f"conv {kind}, seg bigint, turn_no bigint, role string, text string, loss boolean, fault string")


def _ended(row: list, state: str, template: Template) -> list:
    return [*row[:6], None if state in template.ends else f"ends after {state or 'no role'}"]


def _segments(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv", "seg", "turn_no", "role", "text", "loss", "fault"])


def read_conversations(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted text itself says, one row per conversation: conv, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid, fault (the first). Takes the output of format_conversations, in its order within tasks.

    The turns are parsed from the concatenated text alone, by the template's control strings; the loss digest is of the text
    under the loss flags of the segments. Both are fed to running digests, so of a conversation one turn is held at a time.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, own, kind = Marks(template), None, pa.int64()
        for b in batches:
            done, kind = [], b.schema.field(0).type
            for c, seg, text, loss, fault in zip(*[b.column(n).to_pylist() for n in ("conv", "seg", "text", "loss", "fault")], strict=True):
                if seg == 0:
                    if own:
                        done.append(own.row(marks))
                    own = _Read(c)
                own.add(marks, text, loss, fault)
            yield _digests(done, kind)
        if own:
            yield _digests([own.row(marks)], kind)

    kind = segments.schema["conv"].dataType.simpleString()
    return segments.mapInArrow(tidy(run), f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, fault string")


class _Read:
    def __init__(self, conv):
        self.conv, self.opened, self.held, self.fault = conv, False, [], None
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, marks: Marks, text: str, loss: bool, fault: str | None) -> None:
        self.held.append(text)
        self.chars += len(text)
        self.fault = self.fault or fault
        if loss:
            plain = marks.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        if text.endswith(marks.closings()):
            self.take(marks)

    def take(self, marks: Marks) -> None:
        """Reads the turns in what is held."""
        text, at = "".join(self.held), 0
        self.held = []
        if not self.opened:
            if not text.startswith(marks.template.begin):
                raise ValueError("a conversation must open with the template's begin")
            self.opened, at = True, len(marks.template.begin)
        while at < len(text):
            role, plain, at = marks.read(text, at)
            self.turns.update(f"{role}\n{plain}\n".encode())
            self.n += 1

    def row(self, marks: Marks) -> tuple:
        self.take(marks)
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.fault is None, self.fault


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "fault"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
