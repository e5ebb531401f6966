"""Conversations as training text in budgeted windows, with masks over what is to be learned.

A turn is rendered as ``### role: text</turn>`` and a newline. In texts and roles ``\\``, ``#`` and the ``<`` of
``</turn>`` (in roles ``:`` too) are escaped, so neither mark can appear inside a turn and the text can be read back.
Token counts of the rendered turns are summed up along a conversation; each window takes the longest span of
whole turns that its budget leaves room for by these prefix sums, after the system turn (if the conversation
begins with one) and as many of the turns before the span as fit in the history limit. The loss mask
covers the assistant texts of the span alone: each is learned once, and repeated turns never.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.bpe import coder_of, load_ranks, long_white
from tallyweave.llm.common import map_arrow

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
_CODES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_BACK = {code[1]: char for char, code in _CODES.items()}
_IN_TEXT, _IN_ROLE, _ESCAPED = re.compile(r"\\|#|<(?=/turn>)"), re.compile(r"\\|#|<(?=/turn>)|:"), re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends."""
    head = f"{OPEN}{escape(role, True)}{BETWEEN}"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


class Windows:
    """The windows of one conversation, made as its turns arrive; holds no more than a window and its history."""

    def __init__(self, conv: int | None, count: Callable[[str], int], budget: int, history: int):
        self.conv, self.count, self.budget, self.history = conv, count, budget, history
        self.system: tuple | None = None
        self.past: list[tuple] = []  # turns before the span, for history
        self.span: list[tuple] = []  # turns of the window to come
        self.sums = [0]  # prefix sums of the span's tokens
        self.seen = self.number = 0

    def add(self, role: str, text: str) -> Iterator[dict]:
        whole, a, b = rendered(role, text)
        turn = (role, whole, a, b, self.count(whole))
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1
        self.span.append(turn)
        self.sums.append(self.sums[-1] + turn[4])
        if len(self.span) > 1 and self.sums[-1] > self.room():
            yield self.cut(len(self.span) - 1)

    def context(self) -> list[tuple]:
        """What is repeated before the span: the system turn, then the last turns within the history limit."""
        if not self.number:
            return []
        kept, left = [], self.history
        for turn in reversed(self.past):
            if turn[4] > left or turn is self.system:
                break
            kept.append(turn)
            left -= turn[4]
        while kept and sum(t[4] for t in kept) + (self.system[4] if self.system else 0) + self.span[0][4] > self.budget:
            kept.pop()  # the span's first turn comes before history
        return [self.system] * bool(self.system) + kept[::-1]

    def room(self) -> int:
        return self.budget - sum(t[4] for t in self.context())

    def cut(self, n: int) -> dict:
        """The window of the span's first n turns."""
        context, own = self.context(), self.span[:n]
        spans, at = [], sum(len(t[1]) for t in context)
        for role, whole, a, b, _ in own:
            if role == "assistant":
                spans.append({"start": at + a, "end": at + b})
            at += len(whole)
        tokens = sum(t[4] for t in context) + self.sums[n]
        out = {"conv_id": self.conv, "window": self.number, "first_turn": self.seen - len(self.span), "n_turns": n, "n_context": len(context)}
        out |= {"n_tokens": tokens, "over_budget": tokens > self.budget, "text": "".join(t[1] for t in (*context, *own)), "loss": spans}
        self.past = [*self.past, *own]
        total = 0
        for i in range(len(self.past) - 1, -1, -1):
            total += self.past[i][4]
            if total > self.history:
                self.past = self.past[i + 1 :]
                break
        self.span = self.span[n:]
        self.sums = [0]
        for t in self.span:
            self.sums.append(self.sums[-1] + t[4])
        self.number += 1
        return out

    def end(self) -> Iterator[dict]:
        while self.span and self.seen:
            n = next((i for i in range(len(self.span), 1, -1) if self.sums[i] <= self.room()), 1)
            yield self.cut(n)


SCHEMA = "conv_id long, window long, first_turn long, n_turns long, n_context long, n_tokens long, over_budget boolean, text string, loss array<struct<start: long, end: long>>"
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "window", "first_turn", "n_turns", "n_context", "n_tokens")]
    + [("over_budget", pa.bool_()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
_local: dict[tuple, object] = {}


def _counter(ranks: dict[bytes, int], pattern: str) -> Callable[[str], int]:
    import tiktoken

    key = (len(ranks), pattern)
    if key not in _local:
        _local[key] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder_of(ranks, pattern).encode(text)) // 4 if long_white(text) else len(_local[key].encode_ordinary(text))


def formatted(turns: DataFrame, ranks_path: str, pattern: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows of all conversations in ``turns`` (conv_id, turn, role, text; other columns are not read).

    Returns conv_id, window (from 0), first_turn (its span's first turn, by position), n_turns, n_context (turns
    repeated before the span), n_tokens, over_budget, text and loss (spans of code points in the text). A turn
    that is longer than the budget alone is a window over the budget, never cut. Turns are ordered by turn
    (null first), then role and text, so rows that repeat a turn are turns of their own in a fixed order. A
    null role or text is empty; rows with a null conv_id are one conversation. No turns, no windows. A
    conversation passes through one task in order, but only its current window is held in memory.
    """
    shared = turns.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, rows = _counter(*shared.value), None, []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows += now.end()
                    now = Windows(conv, count, budget, history)
                rows += now.add(role or "", text or "")
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        if now is not None:
            rows += now.end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    dealt = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id")
    return map_arrow(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"), run, SCHEMA)


def parsed(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window."""
    out = []
    for part in text.split(CLOSE)[:-1]:
        role, body = part[len(OPEN) :].split(BETWEEN, 1)
        out.append((unescape(role), unescape(body)))
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, from their texts, context counts and loss spans alone.

    Returns conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn, repeated turns once),
    loss_chars, loss_sha256 (all text under the mask, unescaped) and formatted_chars, a row a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[list] = []
        now: list | None = None

        def close() -> None:
            if now is not None:
                done.append([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]])

        for batch in batches:
            for conv, context, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parsed(text)[context:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    dealt = windows.select("conv_id", "window", "n_context", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_arrow(dealt.select("conv_id", "n_context", "text", "loss"), run, kinds)
