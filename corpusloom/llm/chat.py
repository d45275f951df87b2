"""Chat formatting in budgeted windows that end between turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of common chat templates, none of which may stand in a text.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, SEP, END = CONTROL[:3]
GUARD = "\\"
_PLAIN = re.compile("|".join(f"{re.escape(c[0])}(?:{re.escape(GUARD)})*{re.escape(c[1:])}" for c in CONTROL))
_GUARDED = re.compile("|".join(f"{re.escape(c[0])}(?:{re.escape(GUARD)})+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    """Put a guard behind the first character of every control string, guarded ones included."""
    return _PLAIN.sub(lambda m: m[0][0] + GUARD + m[0][1:], text)


def unescape(text: str) -> str:
    """The text before ``escape``: one guard less in each."""
    return _GUARDED.sub(lambda m: m[0][0] + m[0][1 + len(GUARD) :], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its (escaped) text lies in it."""
    head = f"{START}{escape(role)}{SEP}"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


class Packer:
    """Cuts the turns of one conversation, as they come, into windows. Holds one window's turns and
    the history before it, never the conversation."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.before: list[Turn] = []
        self.new: list[Turn] = []
        self.sum, self.past_sum = 0, 0  # prefix sums of the new turns, of the history before them
        self.turns = self.windows = 0

    def add(self, turn: Turn) -> Iterator[dict]:
        if self.turns == 0 and turn.role == "system":
            self.system = turn
        system = self.system.tokens if self.system and self.windows else 0
        if self.new and system + self.past_sum + self.sum + turn.tokens > self.budget:
            yield self.close()
            system = self.system.tokens if self.system else 0
        while self.before and system + self.past_sum + self.sum + turn.tokens > self.budget:
            self.past_sum -= self.before.pop(0).tokens  # history gives way to new turns
        self.new.append(turn)
        self.sum += turn.tokens
        self.turns += 1

    def close(self) -> dict:
        repeated = [self.system] if self.system and self.windows else []
        repeated += self.before
        parts, at, starts, ends = [], 0, [], []
        for k, t in enumerate([*repeated, *self.new]):
            text, s, e = turn_text(t.role, t.text)
            if t.role == "assistant" and k >= len(repeated):
                starts.append(at + s)
                ends.append(at + e)
            parts.append(text)
            at += len(text)
        row = {
            "window_no": self.windows, "first_turn": self.turns - len(self.new), "n_turns": len(self.new),
            "n_repeated": len(repeated), "n_tokens": sum(t.tokens for t in [*repeated, *self.new]),
            "formatted": "".join(parts), "loss_starts": starts, "loss_ends": ends,
        }
        past = [t for t in [*self.before, *self.new] if t is not self.system]
        keep, total = len(past), 0
        while keep and total + past[keep - 1].tokens <= self.history:
            keep -= 1
            total += past[keep].tokens
        self.before, self.past_sum = past[keep:], total
        self.new, self.sum = [], 0
        self.windows += 1
        return row


WINDOW_SCHEMA = (
    "conv_id long, window_no int, first_turn int, n_turns int, n_repeated int, n_tokens int, "
    "formatted string, loss_starts array<int>, loss_ends array<int>"
)


def format_windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", budget: int = 2048, history: int = 256) -> DataFrame:
    """Windows of each conversation, a row each (WINDOW_SCHEMA).

    A turn's tokens are its words and four for the template. Their prefix sums choose the spans: a
    window takes whole turns while the system turn, the repeated history and the new turns stay
    within ``budget``; a turn above it alone is a window of its own, whole. Later windows start
    with the system turn (a first turn of that role) and as many turns before the window as
    ``history`` tokens hold. ``loss_starts``/``loss_ends`` are code point spans of the texts of
    assistant turns that are new in the window; the ``n_repeated`` turns in front are masked, so
    every target counts once.

    A conversation streams through one task, sorted by (turn, role, text); a task holds one window
    at a time. Null roles and texts are empty, rows with a null conversation are one conversation,
    null turns come first, repeated rows are turns of their own.
    """
    col = lambda c: F.col(f"`{c}`")
    turns = df.select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).cast("long").alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, owner, out, held = None, None, [], 0
        for f in frames:
            for conv, is_null, role, text in zip(f["conv_id"].fillna(0), f["conv_id"].isna(), f["role"], f["text"]):
                key = None if is_null else int(conv)
                if packer is None or key != owner:
                    if packer:
                        out.append(packer.close() | {"conv_id": owner})
                    packer, owner = Packer(budget, history), key
                for row in packer.add(Turn(role, text, len(text.split()) + 4)):
                    out.append(row | {"conv_id": owner})
                if len(out) >= 256:
                    yield frame(out)
                    out = []
        if packer:
            out.append(packer.close() | {"conv_id": owner})
        if out:
            yield frame(out)

    def frame(rows: list[dict]) -> pd.DataFrame:
        f = pd.DataFrame(rows)
        f["conv_id"] = f["conv_id"].astype("Int64")
        return f

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(run, WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: ``n_turns``, ``turns_sha256`` (role, newline, text,
    newline of each turn), ``loss_chars`` and ``loss_sha256`` (the unescaped text under the loss
    mask), ``formatted_chars`` and ``n_windows``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, state, out = None, None, []

        def close() -> dict:
            return {
                "conv_id": owner, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(),
                "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(),
                "formatted_chars": state["formatted"], "n_windows": state["windows"],
            }

        for f in frames:
            for conv, is_null, formatted, skip, starts, ends in zip(
                f["conv_id"].fillna(0), f["conv_id"].isna(), f["formatted"], f["n_repeated"], f["loss_starts"], f["loss_ends"]
            ):
                key = None if is_null else int(conv)
                if state is None or key != owner:
                    if state:
                        out.append(close())
                    owner = key
                    state = {"n": 0, "chars": 0, "formatted": 0, "windows": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, text in parse(formatted)[skip:]:
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                for s, e in zip(starts, ends):
                    text = unescape(formatted[s:e])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["formatted"] += len(formatted)
                state["windows"] += 1
            if len(out) > 1000:
                yield pd.DataFrame(out).astype({"conv_id": "Int64"})
                out = []
        if state:
            out.append(close())
        if out:
            yield pd.DataFrame(out).astype({"conv_id": "Int64"})

    ordered = windows.select("conv_id", "window_no", "formatted", "n_repeated", "loss_starts", "loss_ends")
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "window_no").mapInPandas(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_windows long",
    )
