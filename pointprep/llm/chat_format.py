"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template names each role's header, what closes a turn, which roles carry loss, which strings are control
strings and which role may follow which. The machine reads a conversation's turns in order, one at a time; each
step checks the role against the state it is in and emits the turn as segments of text, each with a loss flag.
Control strings inside texts and role names are escaped, so the formatted text can be taken apart again exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from pointprep.llm.common import arrow_map

START, LOST = "start", "lost"


@dataclass(frozen=True)
class Template:
    """``headers`` by role; a role without one is named between the two parts of ``other``. ``order`` says which roles a
    state accepts; the state after a turn is its role, or LOST after one that no state knows."""

    headers: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ",
    })
    other: tuple[str, str] = ("### Role ", "</role> ")
    close: str = "</turn>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = ("###", "</turn>", "</role>")
    order: dict[str, frozenset[str]] = field(default_factory=lambda: {
        START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}), LOST: frozenset(),
    })
    final: frozenset[str] = frozenset({"assistant"})

    @cached_property
    def _special(self) -> re.Pattern:
        # The first character of every control string, wherever one begins, and the escape character itself.
        return re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)]))

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\" + m.group(), text)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn of ``role`` and whether ``state`` accepts it."""
        return role if role in self.order else LOST, role in self.order[state]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as (text, loss); of a role with loss only its own text carries it."""
        head = self.headers.get(role)
        if head is None:
            head = self.other[0] + self.escape(role) + self.other[1]
        body, loss = self.escape(text), role in self.loss_roles
        return [(head, False), (body, True), (self.close, False)] if loss else [(head + body + self.close, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn of a formatted text."""
        at = 0
        while at < len(formatted):
            for role, head in self.headers.items():
                if formatted.startswith(head, at):
                    at += len(head)
                    break
            else:
                if not formatted.startswith(self.other[0], at):
                    raise ValueError(f"no header at {at}")
                role, at = _until(formatted, at + len(self.other[0]), self.other[1])
            text, at = _until(formatted, at, self.close)
            yield role, text


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _until(text: str, at: int, mark: str) -> tuple[str, int]:
    """What stands before the first ``mark`` that is not escaped, and where that mark ends."""
    begin = at
    while True:
        end = text.find(mark, at)
        if end < 0:
            raise ValueError("a turn has no end")
        # An escaped mark follows an odd number of backslashes.
        back = end
        while back > begin and text[back - 1] == "\\":
            back -= 1
        if (end - back) % 2 == 0:
            return unescape(text[begin:end]), end + len(mark)
        at = end + 1


SEGMENTS = "conv_id long, position long, segments array<struct<text: string, loss: boolean>>, state string, accepted boolean"


def format_turns(convs: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn's ``segments``, the machine's ``state`` after it and whether the turn was ``accepted``.

    Turns of a conversation come by ``turn`` (null first), rows of one turn by role and text; ``position`` counts from 0.
    Null role and text count as empty, a role without header is written out by name. A turn the machine does not accept
    is formatted like any other, and the machine goes on from its role. Rows with a null number are one conversation.
    Other columns are not read; no rows give none. The turns of a conversation stay together and in order in their
    partition; a task holds one batch of turns, however long the conversation.
    """
    ordered = (
        convs.select(
            F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
            F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
        )
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def rows(batches: Iterator[dict]):
        now, position, state = object(), 0, START
        for batch in batches:
            for c, r, t in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"]):
                if c != now:
                    now, position, state = c, 0, START
                state, accepted = template.step(state, r)
                yield c, position, [{"text": s, "loss": loss} for s, loss in template.segments(r, t.as_py())], state, accepted
                position += 1

    return arrow_map(ordered, rows, SEGMENTS, out_rows=1_000)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what its formatted turns hold, taken from their segments alone.

    ``formatted`` is as ``format_turns`` leaves it, or anything else whose conversations are together and in order. Returns
    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``, ``n_faults`` (turns not
    accepted) and ``valid`` (none, and the last turn may be the last). Digests run along; no conversation is held.
    """

    def rows(batches: Iterator[dict]):
        now, seen = object(), None
        for batch in batches:
            for c, segments, state, accepted in zip(*(batch[f].to_pylist() if f != "segments" else batch[f] for f in ("conv_id", "segments", "state", "accepted"))):
                if c != now:
                    if seen is not None:
                        yield seen.row(now, template)
                    now, seen = c, _Seen()
                seen.add([(s["text"], s["loss"]) for s in segments.as_py()], state, accepted, template)
        if seen is not None:
            yield seen.row(now, template)

    return arrow_map(
        formatted, rows,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_faults long, valid boolean",
    )


class _Seen:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.faults = 0
        self.state = START

    def add(self, segments: list[tuple[str, bool]], state: str, accepted: bool, template: Template) -> None:
        whole = "".join(s for s, _ in segments)
        for role, text in template.parse(whole):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        learnt = unescape("".join(s for s, loss in segments if loss))
        self.loss.update(learnt.encode())
        self.loss_chars += len(learnt)
        self.chars += len(whole)
        self.faults += not accepted
        self.state = state

    def row(self, conv: int | None, template: Template) -> tuple:
        valid = not self.faults and self.state in template.final
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.faults, valid
