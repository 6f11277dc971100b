"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as one string, each turn as <turn>role<text>body</turn> and a line feed. The marks are added
tokens, so the tokenizer splits at them and no token straddles a mark and a text. Backslash, < and # in roles and bodies
are written \\\\, \\l and \\h: an escaped text holds no mark, whatever it says, and unescaping is exact. The whole string is encoded once
with offsets; the spans of the trained roles' bodies are found among the sorted token spans by binary search, which gives token ranges and,
clipped to the body, character spans.

Rows are dealt by conversation and sorted by turn inside the partitions (role and text settle ties), then read as a stream:
a task holds `at_once` characters of conversations, or one conversation if that is longer, as an ordered rendering must.

Defined cases: a null text or role is an empty one; null turns come first; rows with a null id form one conversation; an empty
assistant text adds no loss; repeated rows are turns of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
_ESCAPE = str.maketrans({"\\": "\\\\", "<": "\\l", "#": "\\h"})
_PLAIN = {"\\": "\\", "l": "<", "h": "#"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn>([^<]*)<text>([^<]*)</turn>\n")
SPAN = "array<struct<start:int,stop:int>>"
FORMATTED = f"conv_id long, n_turns long, formatted string, ids array<int>, loss_tokens {SPAN}, loss_spans {SPAN}"


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]], trained: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the character spans of the trained roles' bodies, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{BODY}", escape(text)
        if role in trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def align(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For sorted spans, the ranges of tokens that touch them, and what these tokens cover of them."""
    starts, stops = [a for a, _ in offsets], [b for _, b in offsets]
    tokens, covered = [], []
    for a, b in spans:
        first, last = bisect_right(stops, a), bisect_left(starts, b)
        if first < last:
            tokens.append((first, last))
            covered.append((max(a, starts[first]), min(b, stops[last - 1])))
    return tokens, covered


def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(x, normalized=False) for x in (OPEN, BODY, CLOSE)])
    return tokenizer


def format_chats(rows: DataFrame, tokenizer_path: str, trained: tuple[str, ...] = ("assistant",), at_once: int = 1 << 20) -> DataFrame:
    """A row per conversation: the string, its ids, and the loss mask as token ranges and character spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, roles = _tokenizer(tokenizer_path), frozenset(trained)
        waiting: list[tuple[int | None, list[tuple[str, str]]]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = []
            rendered = [render(turns, roles) for _, turns in waiting]
            for (conv, turns), (text, spans), e in zip(waiting, rendered, tokenizer.encode_batch([t for t, _ in rendered], add_special_tokens=False)):
                tokens, covered = align(e.offsets, spans)
                out.append((conv, len(turns), text, e.ids, [{"start": a, "stop": b} for a, b in tokens], [{"start": a, "stop": b} for a, b in covered]))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), span, span)
            names = ["conv_id", "n_turns", "formatted", "ids", "loss_tokens", "loss_spans"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if not waiting or waiting[-1][0] != conv:
                    if held >= at_once:
                        yield flush()
                        waiting.clear()
                        held = 0
                    waiting.append((conv, []))
                waiting[-1][1].append((role or "", text or ""))
                held += len(text or "") + 32
        if waiting:
            yield flush()

    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted rows say: all turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
