"""Conversations rendered by a template, encoded once, with a loss mask aligned by offsets.

A turn is ``<s>role\\ntext</s>``.  Control strings inside roles and texts are broken by a backslash after their
first character, and backslashes are doubled, so ``parse`` returns exactly what was rendered.  A conversation is
encoded as a whole with offsets; the sorted spans of the assistant's texts and those of the tokens are intersected
by binary search.  A token that has any character of a learnt text is under the mask; where it also has some of the
template, only the characters it shares with the text count as learnt.  The learnt text is read back from the mask and
the offsets alone, clipped so; tokens that leave out a character of a learnt text are an error.

Defined cases: a null role or text is an empty one; a null conv_id is a conversation of its own; turns that repeat
keep an order by role and text, null turns first; a conversation of any length is rendered and encoded whole, so a
task holds one conversation, or several short ones; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebar.llm.common import Scratch, text_or_empty
from tidebar.llm.encoder import vocabulary_path

OPEN, CLOSE = "<s>", "</s>"
_CONTROL = re.compile(r"(<)(s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])")
_TURN = re.compile(r"<s>((?:\\.|[^\\\n])*)\n(.*?)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

_FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("input_ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32())),
        ("loss_mask", pa.list_(pa.int8())),
    ]
)
_FORMATTED_SQL = (
    "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>, "
    "input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\3\\\2\4", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn, and where in it the text starts; the text ends before the closing mark."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    return f"{head}{escape(text)}{CLOSE}", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("a rendered conversation is damaged")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("a rendered conversation is damaged")
    return out


def token_mask(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """1 for tokens [start, end) that share a character with one of the sorted spans."""
    if not len(span_starts):
        return np.zeros(len(starts), np.int8)
    at = np.searchsorted(span_ends, starts, "right")  # the first span that ends behind the token's start
    inside = at < len(span_starts)
    return (inside & (span_starts[np.minimum(at, len(span_starts) - 1)] < ends)).astype(np.int8)


def learnt(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> list[tuple[int, int]]:
    """The runs of characters that tokens under the mask share with the sorted spans, each character once, in order."""
    on = mask > 0
    starts, ends = starts[on], ends[on]
    if not len(starts) or not len(span_starts):
        return []
    first = np.searchsorted(span_ends, starts, "right")
    each = np.maximum(np.searchsorted(span_starts, ends, "left") - first, 0)  # spans a token shares characters with
    token = np.repeat(np.arange(len(starts)), each)
    span = np.arange(len(token)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    a, b = np.maximum(starts[token], span_starts[span]), np.minimum(ends[token], span_ends[span])
    reached = np.concatenate([[0], np.maximum.accumulate(b)])[:-1] if len(b) else b
    a = np.maximum(a, reached)  # tokens within one character have the same offsets
    return [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y]


@functools.cache
def _library(path: str) -> Tokenizer:
    """One a Python worker, kept over its tasks: what a task's own one took is not given back when it ends."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs side by side
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library


def format_turns(path: str, learn: tuple[str, ...], at_once: int = 64, chars_at_once: int = 1_000_000):
    """For mapInArrow over turns sorted by conversation and turn; whole conversations are encoded some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        held: list[tuple] = []
        begun, conv, turns, size, spans = False, None, [], 0, []

        def encode() -> pa.RecordBatch:
            found = library.encode_batch([h[2] for h in held], add_special_tokens=False)
            columns: list[list] = [[], [], [], []]
            for h, e in zip(held, found, strict=True):
                marks = np.array(h[3], np.int64).reshape(-1, 2)
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                mask = token_mask(offsets[:, 0], offsets[:, 1], marks[:, 0], marks[:, 1])
                runs = learnt(offsets[:, 0], offsets[:, 1], mask, marks[:, 0], marks[:, 1])
                if sum(b - a for a, b in runs) != int((marks[:, 1] - marks[:, 0]).sum()):
                    raise ValueError("the vocabulary's tokens leave out characters of a learnt text")
                for column, values in zip(columns, (e.ids, offsets[:, 0], offsets[:, 1], mask), strict=True):
                    column.append(np.asarray(values))
            cols = [list(c) for c in zip(*(h[:3] for h in held), strict=True)]
            cols.append([[{"start": a, "end": b} for a, b in h[3]] for h in held])
            arrays = [pa.array(c, f.type) for c, f in zip([*cols, *columns], _FORMATTED, strict=True)]
            held.clear()
            return pa.record_batch(arrays, schema=_FORMATTED)

        waiting = 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
            for conv_id, role, text in rows:
                if begun and conv_id != conv:
                    held.append((conv, len(turns), "".join(turns), spans))
                    waiting += size
                    turns, size, spans = [], 0, []
                    if len(held) >= at_once or waiting >= chars_at_once:
                        yield encode()
                        waiting = 0
                begun, conv = True, conv_id
                turn, head = render(role, text)
                if role in learn and text:
                    spans.append((size + head, size + len(turn) - len(CLOSE)))
                turns.append(turn)
                size += len(turn)
        if begun:
            held.append((conv, len(turns), "".join(turns), spans))
            yield encode()

    return run


def format_chats(turns: DataFrame, path: str | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans, input_ids, token_starts, token_ends, loss_mask."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text_or_empty("role").alias("role"), text_or_empty().alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(format_turns(path or vocabulary_path("byte_bpe_50k.json"), learn), _FORMATTED_SQL)


_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long, loss_tokens long"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            r = batch.slice(k, 1)
            text, spans = r.column("formatted")[0].as_py(), r.column("loss_spans")[0].as_py()
            marks = np.array([(x["start"], x["end"]) for x in spans], np.int64).reshape(-1, 2)
            starts, ends, mask = (
                np.asarray(r.column(c).flatten().to_numpy(zero_copy_only=False), np.int64) for c in ("token_starts", "token_ends", "loss_mask")
            )
            turns, said = hashlib.sha256(), hashlib.sha256()
            parsed = parse(text)
            for role, words in parsed:
                turns.update(f"{role}\n{words}\n".encode())
            own = unescape("".join(text[a:b] for a, b in learnt(starts, ends, mask, marks[:, 0], marks[:, 1])))
            said.update(own.encode())
            conv_id = r.column("conv_id")[0].as_py()
            out.append((conv_id, len(parsed), turns.hexdigest(), len(own), said.hexdigest(), len(text), len(mask), int(mask.sum())))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_DIGEST_ARROW)


_DIGEST_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _DIGEST.split(", ")])


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from what ``format_chats`` has written: its turns, and its text under the loss mask."""
    small = formatted.select("conv_id", "formatted", "loss_spans", "token_starts", "token_ends", "loss_mask")
    return small.mapInArrow(_digests, _DIGEST)


def written_chats(turns: DataFrame) -> DataFrame:
    """Formats, writes to the shared folder and reads back."""
    return Scratch(turns.sparkSession, "chat").put(format_chats(turns), "formatted")
