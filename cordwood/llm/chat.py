"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, by a template that marks each turn::

    <|im_start|>role<|im_sep|>text<|im_end|>

and encoded once, with the offsets of its tokens. The marks are special tokens of their own,
so no token reaches over the edge of a text. The spans of the turns whose role is trained on
are sorted, and so are the token spans; a binary search over both gives the tokens under the
loss mask.

Control strings inside texts and roles are escaped reversibly: a backslash is put into every
``<|``, after the backslashes that stand there already, and taken out again when read. So
``<|`` never occurs in the rendered text but as a mark.

Turns go by ``turn``, a null turn first; ties by role and text. A null text or role is empty.
Rows without ``conv_id`` form one conversation. An empty table gives no conversations. Rows
are shuffled by ``conv_id`` and rendered one conversation at a time from the sorted stream.
A single conversation is one sequence and is held by one task; nothing else is.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Roles whose texts are trained on.
TRAINED = ("assistant",)

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEPARATOR) + r"(.*?)" + re.escape(END), re.DOTALL)

FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask binary"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


@dataclass(frozen=True)
class Rendered:
    """A formatted conversation and the spans of its trained texts, in order."""

    text: str
    spans: list[tuple[int, int]]


def render(turns: list[tuple[str | None, str | None]]) -> Rendered:
    """The whole conversation of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role or '')}{SEPARATOR}", escape(text or "")
        if (role or "") in TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return Rendered("".join(parts), spans)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span: both lists are sorted, so each span is a range of tokens."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans:
        low, high = np.array(spans, dtype=np.int64).T
        first = np.searchsorted(starts, low, side="left")
        last = np.searchsorted(ends, high, side="right")
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            mask[a:b] = True
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped texts under the mask: one for each unbroken run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    runs = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in runs]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    # Offsets keep the blank at the front of a token.
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    marks = [AddedToken(mark, special=True, normalized=False) for mark in (START, SEPARATOR, END)]
    tokenizer.add_special_tokens(marks)
    return tokenizer


def encode(rendered: Rendered, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends of the tokens, and the loss mask."""
    encoding = _tokenizer(path).encode(rendered.text, add_special_tokens=False)
    starts, ends = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2).T
    return np.array(encoding.ids, dtype=np.int32), starts, ends, mask_of(starts, ends, rendered.spans)


def format_conversations(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: the formatted text, its ids, the place of each token in it
    (in code points) and the loss mask (one byte for each token)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for conv_id, turns in groupby(rows(batches), key=lambda row: row[0]):
            rendered = render([(role, text) for _, role, text in turns])
            ids, starts, ends, mask = encode(rendered, tokenizer)
            n_turns = rendered.text.count(START)
            made.append((conv_id, n_turns, rendered.text, ids, starts, ends, mask.astype(np.uint8).tobytes()))
            size += len(rendered.text)
            if size > 1 << 21:
                yield batch_of(made)
                made, size = [], 0
        yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), *3 * [pa.list_(pa.int32())], pa.binary()]
        names = ["conv_id", "n_turns", "formatted", "ids", "starts", "ends", "mask"]
        columns = list(zip(*made, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    narrow = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation, from its text, offsets and mask alone: ``turns_sha256``
    over role, line end, text, line end of each turn; ``loss_chars`` and ``loss_sha256`` of
    the text under the mask; and ``formatted_chars``."""
    found = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
    found += [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for i, text in enumerate(batch.column("formatted").to_pylist()):
                starts, ends = (batch.column(n)[i].values.to_numpy() for n in ("starts", "ends"))
                mask = np.frombuffer(batch.column("mask")[i].as_py(), dtype=np.uint8)
                turns = read_turns(text)
                loss = "".join(masked_texts(text, starts, ends, mask))
                whole = "".join(f"{role}\n{own}\n" for role, own in turns)
                told.append((len(turns), _sha256(whole), len(loss), _sha256(loss), len(text)))
            columns = list(zip(*told, strict=True)) or [[]] * len(found)
            arrays = [pa.array(list(c), t) for c, (_, t) in zip(columns, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names=["conv_id", *(n for n, _ in found)])

    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(run, schema)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
