"""Chat formatting by a finite-state machine over roles.

A declarative template gives, for each role, the text before and after a turn and whether the turn's text is learned; the machine
gives the roles that may follow each state. Output is one row per segment, with its own loss flag, in order; the whole formatted
conversation is the concatenation of its segments, and is never built in one piece, so a conversation may be of any length.

Control strings inside texts are escaped reversibly: the escape character is doubled first, then put behind the first character of every control
string. After that no control string is left in a text, and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around the turns of each role; roles that aren't listed are formatted as `other`, with their name."""

    begin: str = "<s>"
    end: str = "</s>"
    before: dict[str, str] = field(default_factory=lambda: {"system": "[SYS] ", "user": "[INST] ", "assistant": "[ANS] "})
    after: dict[str, str] = field(default_factory=lambda: {"system": " [/SYS]", "user": " [/INST]", "assistant": " [/ANS]"})
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    learned: tuple[str, ...] = ("assistant",)
    #: Roles that may follow a state; the state after a turn is its role. A conversation ends well in a state of `final`.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({x.strip() for x in (self.begin, self.end, *self.before.values(), *self.after.values(), *self.other) if x.strip()}, key=lambda x: (-len(x), x))

    def escaped(self, text: str) -> str:
        rx = re.compile("|".join(map(re.escape, self.controls)))
        return rx.sub(lambda m: m[0][0] + ESCAPE + "." + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))

    def unescaped(self, text: str) -> str:
        # a doubled escape stands for itself; an escape and a full stop were put in
        return re.sub(r"\\(\\|\.)", lambda m: ESCAPE if m[1] == ESCAPE else "", text)


_SEGMENTS = "conv {0}, turn long, place long, part string, role string, text string, loss boolean, state string, error string"


def formatted(conversations: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per segment: conv, turn, place (order within the conversation), part (begin, before, text, after, end), role, text, loss,
    state (of the machine after it) and error (null, or why the turn may not stand here, or why the end is not a good one).

    Turns are read by turn number; ties by role, then text, nulls first. Null texts are empty, null roles are named "". Conversations
    with errors are formatted too, so that the caller decides. A null conv is a conversation of its own. Repeated rows are
    turns of their own, an empty table gives no segments, and only the four columns are read, so others may have any name. Partitions are read as sorted streams, so memory
    doesn't grow with a conversation.
    """
    t = template or Template()
    kind = conversations.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, place, began = None, "start", 0, False
        rows: list[tuple] = []

        def add(turn, part, role, text, loss, error=None):
            nonlocal place
            rows.append((now, turn, place, part, role, text, loss, state, error))
            place += 1

        def close():
            add(None, "end", None, t.end, False, None if state in t.final else f"ends in {state}")

        for b in batches:
            for conv, turn, role, text in zip(b["conv"], b["turn"], b["role"], b["text"], strict=True):
                conv = None if pd.isna(conv) else conv
                if not began or conv != now:
                    if began:
                        close()
                    now, state, place, began = conv, "start", 0, True
                    add(None, "begin", None, t.begin, False)
                role, text, turn = role or "", text or "", None if pd.isna(turn) else int(turn)
                error = None if role in t.follows.get(state, ()) else f"{role or 'no role'} after {state}"
                state = role
                before, after = (t.before[role], t.after[role]) if role in t.before else (t.other[0] + t.escaped(role) + t.other[1], t.other[2])
                add(turn, "before", role, before, False, error)
                add(turn, "text", role, t.escaped(text), role in t.learned)
                add(turn, "after", role, after, False)
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows.clear()
        if began:
            close()
            yield pd.DataFrame(rows, columns=columns)

    columns = [x.split()[0] for x in _SEGMENTS.format("x").split(", ")]
    rows = conversations.select(column(conv_col).alias("conv"), column(turn_col).cast("long").alias("turn"), column(role_col).alias("role"), column(text_col).alias("text"))
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a conversation is one stream of text with one digest: it stays in one task, read turn by turn
    return rows.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "role", "text").mapInPandas(run, _SEGMENTS.format(kind))


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from segments in order: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, errors.

    Reads the segments as formatted() returns them (each partition in order); digests are fed turn by turn.
    """
    t = template or Template()
    kind = segments.schema["conv"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, errors long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        rows: list[tuple] = []
        turns = loss = None
        n = n_loss = chars = errors = 0
        for b in batches:
            for conv, part, text, is_loss, error in zip(b["conv"], b["part"], b["text"], b["loss"], b["error"], strict=True):
                if part == "begin":
                    turns, loss, n, n_loss, chars, errors = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                chars += len(text)
                errors += error is not None
                if part == "before":
                    role = next((r for r, x in t.before.items() if x == text), None)
                    if role is None:
                        role = t.unescaped(text[len(t.other[0]) : len(text) - len(t.other[1])])
                    turns.update(role.encode("utf-8", "surrogatepass") + b"\n")
                elif part == "text":
                    plain = t.unescaped(text)
                    data = plain.encode("utf-8", "surrogatepass")
                    turns.update(data + b"\n")
                    n += 1
                    if is_loss:
                        n_loss += len(plain)
                        loss.update(data)
                elif part == "end":
                    rows.append((None if pd.isna(conv) else conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars, errors))
            if rows:
                yield pd.DataFrame(rows, columns=names)
                rows.clear()

    return segments.mapInPandas(run, schema)
