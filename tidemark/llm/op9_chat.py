"""Chat formatting in budgeted windows.

The rows of a conversation, ordered by turn, become one or more windows of text. Prefix sums of the
turns' tokens choose spans of whole turns within a budget: each window holds the system turns that open
the conversation, a little of the history before its span, and the span. Only fresh assistant turns are
targets: repeated history is masked, so every assistant text is under the mask once. The opening system turns
are in every window whatever their length. A turn that doesn't fit beside them has a window of its own with
them, which then exceeds the budget; nothing is cut.

The template marks a turn as ``<|role|>``, a line feed, the text, ``<|end|>`` and a line feed. Control
strings inside roles and texts get a backslash after their first character, and backslashes are doubled,
so reading back is exact.

Conversations are streamed in order through sorted partitions; only the turns of one window are held, so
a conversation of any length needs little memory. Its hash runs over all of its turns in order, which
makes one task read each conversation.

Defined results: a null text or role is empty; a null turn comes first and equal turns are ordered by
role and text; a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op5_bpe import load
from .textscan import bounded_batches, chunks, utf8

#: Tokens of a window, and of the history that a window repeats.
BUDGET, HISTORY = 1024, 128
#: Tokens that the template adds to a turn.
MARKS = 8
# fixed values: control strings of this and other templates, which texts may hold
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)
WINDOWS = "conv_id long, window long, text string, fresh_from int, targets array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    """The text without control strings; ``unescape`` gives it back."""
    text = text.replace("\\", "\\\\")
    while (again := _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)) != text:
        text = again
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], fresh_from: int) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and the ranges of its targets: fresh assistant texts."""
    out, at, targets = [], 0, []
    for k, (role, text) in enumerate(turns):
        head, body = f"<|{escape(role)}|>\n", escape(text)
        if k >= fresh_from and role == "assistant":
            targets.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), targets


class Conversation:
    """Cuts the turns of one conversation, as they come, into windows."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: list[tuple[str, str, int]] = []
        self.past: list[tuple[str, str, int]] = []
        self.span: list[tuple[str, str, int]] = []
        self.opening, self.first = True, True
        self.used = 0

    def add(self, role: str, text: str, tokens: int) -> list[tuple[list[tuple[str, str]], int]]:
        """A window if the turn doesn't fit into the one that is open."""
        turn, out = (role, text, tokens + MARKS), []
        self.opening &= role == "system"
        if self.opening:
            self.system.append(turn)
        # the opening system turns stay together; what follows may still be within the budget beside them
        if self.span and not self.opening and self.used + turn[2] > self.budget and not (self.first and len(self.span) == len(self.system)):
            out.append(self.close())
        if not self.span:
            self.used = turn[2] if self.first else turn[2] + sum(t[2] for t in self.system) + sum(t[2] for t in self.past)
            while self.past and self.used > self.budget:
                self.used -= self.past.pop(0)[2]
        else:
            self.used += turn[2]
        self.span.append(turn)
        return out

    def close(self) -> tuple[list[tuple[str, str]], int]:
        before = [] if self.first else self.system + self.past
        window = [t[:2] for t in before + self.span], len(before)
        # history: the last turns that fit, but not the system turns that open every window
        turns = self.past + (self.span[len(self.system) :] if self.first else self.span)
        self.past, size = [], 0
        for t in reversed(turns):
            size += t[2]
            if size > self.history:
                break
            self.past.insert(0, t)
        self.span, self.first = [], False
        return window


def ordered(turns: DataFrame) -> DataFrame:
    """Each conversation in one partition, its turns in order."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of all conversations; those of one conversation follow each other in one partition."""
    bounded_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        none = object()
        now, number, talk = none, 0, None
        rows: list[tuple] = []

        def put(window: tuple[list[tuple[str, str]], int]) -> None:
            nonlocal number
            text, targets = render(*window)
            rows.append((now, number, text, window[1], targets))
            number += 1

        def flush() -> pa.RecordBatch:
            conv, nr, text, fresh, targets = zip(*rows, strict=True)
            spans = pa.array([[{"start": a, "end": b} for a, b in t] for t in targets], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            batch = pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(nr, pa.int64()), pa.array(text, pa.string()), pa.array(fresh, pa.int32()), spans], ["conv_id", "window", "text", "fresh_from", "targets"])
            rows.clear()
            return batch

        for b in chunks(batches):
            _, to = bpe.encode_batch(*utf8(b.column("text")))
            for conv, role, text, tokens in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), np.diff(to).tolist(), strict=True):
                if talk is None or conv != now:
                    if talk is not None:
                        put(talk.close())
                    now, number, talk = conv, 0, Conversation(budget, history)
                for window in talk.add(role, text, tokens):
                    put(window)
            if rows:
                yield flush()
        if talk is not None:
            put(talk.close())
            yield flush()

    return ordered(turns).mapInArrow(run, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows in order: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None
        rows: list[tuple] = []

        def put() -> None:
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return batch

        for b in batches:
            for r in b.to_pylist():
                if r["window"] == 0:
                    if state is not None:
                        put()
                    now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for k, m in enumerate(_TURN.finditer(r["text"])):
                    if k >= r["fresh_from"]:
                        state[0] += 1
                        state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for span in r["targets"]:
                    text = unescape(r["text"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(r["text"])
            if rows:
                yield flush()
        if state is not None:
            put()
            yield flush()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
