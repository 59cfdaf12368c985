"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of whole turns. Running sums of the turns' tokens, as formatted, choose
how many new turns fit; a window starts with the system turn and a limited repeat of the history. The loss mask covers the
assistant texts among the new turns only, so each is a target once. Texts are escaped, and reading the windows
back gives the turns exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import small_batches
from .tokens import WORD_BPE, forget, word_tokens
from .words import tidy

BUDGET = 1024  # tokens of a window, its marks included; only a single turn above it makes a window larger
HISTORY_TURNS, HISTORY_TOKENS = 4, 256
# The template.
OPEN, CLOSE, END = "<turn ", ">\n", "</turn>\n"
_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)
_OUT = [("conv_id", pa.int64()), ("window", pa.int32()), ("system", pa.bool_()), ("history", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
_OUT_DDL = "conv_id long, window int, system boolean, history int, n_tokens long, text string, mask array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    """The text with a backslash before each backslash and angle bracket: no template mark is left in it."""
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _turn(role: str, body: str) -> str:
    return f"{OPEN}{escape(role)}{CLOSE}{escape(body)}{END}"


def _tokens(turns: list[tuple]) -> int:
    return sum(t[2] for t in turns)


def _window(conv_id: int | None, number: int, system: list[tuple], history: list[tuple], new: list[tuple]) -> tuple:
    text, at, mask = [], 0, []
    for k, (role, body, _) in enumerate([*system, *history, *new]):
        turn = _turn(role, body)
        if role == "assistant" and k >= len(system) + len(history):
            begin = at + len(OPEN) + len(escape(role)) + len(CLOSE)
            mask.append({"start": begin, "end": at + len(turn) - len(END)})
        text.append(turn)
        at += len(turn)
    return conv_id, number, bool(system), len(history), _tokens([*system, *history, *new]), "".join(text), mask


class _Windows:
    """Windows of one conversation, turn by turn; holds the open window, the history and the system turn."""

    def __init__(self, conv_id: int | None, budget: int):
        self.conv_id, self.budget, self.number = conv_id, budget, 0
        self.system: list[tuple] = []  # the conversation's
        self.shown: list[tuple] = []  # the open window's
        self.history: list[tuple] = []
        self.new: list[tuple] = []
        self.total = 0  # running sum of the open window's tokens

    def add(self, turn: tuple) -> tuple | None:
        """Take the next (role, text, tokens); the window that it closes, if it does."""
        done = None
        if self.new and self.total + turn[2] > self.budget:
            done = self.close()
            self.shown = self.system if _tokens(self.system) + turn[2] <= self.budget else []
            # the latest turns that fit both limits, and leave room for the new turn
            room = min(HISTORY_TOKENS, self.budget - turn[2] - _tokens(self.shown))
            kept: list[tuple] = []
            for t in reversed(self.history):
                room -= t[2]
                if room < 0 or len(kept) == HISTORY_TURNS:
                    break
                kept.insert(0, t)
            self.history = kept
            self.total = _tokens([*self.shown, *kept])
        self.new.append(turn)
        self.total += turn[2]
        return done

    def close(self) -> tuple:
        out = _window(self.conv_id, self.number, self.shown, self.history, self.new)
        if not self.number and self.new[0][0] == "system":
            self.system = self.new[:1]
            self.new = self.new[1:]
        self.history = [*self.history, *self.new][-HISTORY_TURNS:]
        self.new, self.number = [], self.number + 1
        return out


def format_conversations(turns: DataFrame, budget: int = BUDGET, vocabulary: str = WORD_BPE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of all conversations: conv_id, window, system, history, n_tokens, text, mask.

    ``system`` and ``history`` say how many turns at the start are repeats (none in window 0); ``mask`` holds
    code point spans of the target texts. ``n_tokens`` counts the window's text, marks included, and is above
    ``budget`` only where a single turn is; such a turn is alone. Where the system turn and a turn do not fit
    together, the system turn is left out of that window. Null texts and roles are empty; turns of one number are ordered by
    role and text, null numbers come last; null conv_ids are one conversation; repeated rows are turns each.
    An empty table gives no windows. A task streams through sorted turns and holds one window.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, open_, rows = word_tokens(vocabulary), None, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if open_ is None or conv_id != open_.conv_id:
                    if open_ is not None:
                        rows.append(open_.close())
                    open_ = _Windows(conv_id, budget)
                done = open_.add((role, text, len(tokens.encode(_turn(role, text))) // 4))
                if done:
                    rows.append(done)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if open_ is not None:
            rows.append(open_.close())
        if rows:
            yield _batch(rows)
        forget()

    small_batches(turns.sparkSession)
    text_or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    return ordered.mapInArrow(tidy(windows), _OUT_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _OUT, strict=True)], [n for n, _ in _OUT])


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    found, end = [], 0
    for m in _TURN.finditer(text):
        if m.start() != end:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        end = m.end()
    if end != len(text):
        raise ValueError("the window is not well formed")
    return found


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows hold, a row a conversation; repeats are skipped, targets read under the mask.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Windows stream in order.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, rows = None, None, []

        def closed() -> tuple:
            n, turns, chars, loss, formatted = state
            return at[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            for x in batch.to_pylist():
                if at is None or at[0] != x["conv_id"]:
                    if at is not None:
                        rows.append(closed())
                    at, state = (x["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(x["text"])[x["system"] + x["history"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in x["mask"]:
                    target = unescape(x["text"][span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(x["text"])
            if len(rows) >= 1000:
                yield _digest_batch(rows)
                rows = []
        if at is not None:
            rows.append(closed())
        if rows:
            yield _digest_batch(rows)

    ordered = windows.select("conv_id", "window", "system", "history", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(tidy(digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
