"""Byte-level BPE by merge replay over the words of many texts at once.

Texts are split into words by the tokenizer's pattern, and every new word is taken once. The
bytes of all new words stand one after the other as tokens. An inverted index lists, for
each rank, the positions where a pair of neighbours merges at that rank. Ranks are taken
from the lowest on; all positions of a rank are merged together, and only the pairs of the
touched neighbours are looked up anew and entered in the index.

A merge may bring a pair of lower rank than its own into being. A word where that happens is
taken out and encoded by itself, pair by pair, with a heap; so ids are those of merging the
lowest, leftmost pair of each word again and again.

Each worker keeps a bounded table of encoded words and of the chunks between blanks. All
texts are encoded whole. A null or empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.llm.shared import as_bytes

#: Words and chunks longer than this many bytes are encoded each time and not kept.
LONGEST_KEPT = 48
#: Beyond so many entries a worker's tables keep only those of the texts at hand.
MOST_KEPT = 300_000
#: Bytes of text whose new words are replayed together.
BLOCK = 6 << 20
#: Rows that a task takes out of an Arrow batch at a time.
ROWS = 1_000

#: White space other than blanks and line ends.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _has_wide_space(text: str) -> bool:
    """Whether a blank may stand beside white space: such a text isn't divided at its blanks."""
    return "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text) is not None


class MergeReplay:
    """The merges of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self._size = size
        self._byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # Every split of a token into two tokens is a pair that merges to it.
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self._pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(1) << 62)
        self._pair_ranks = np.append(np.array(merged, dtype=np.int64)[order], -1)

    @classmethod
    def from_file(cls, path: str) -> MergeReplay:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which two tokens merge; -1 if they don't."""
        key = left.astype(np.int64) * self._size + right
        at = np.searchsorted(self._pair_keys, key)
        return np.where(self._pair_keys[at] == key, self._pair_ranks[at], -1)

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word, by a heap of its pairs."""
        tokens: list[int | None] = [int(self._byte_ids[b]) for b in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def enter(at: int) -> None:
            right = after[at]
            if at >= 0 and right < len(word):
                rank = self.ranks.get(self.token_bytes[tokens[at]] + self.token_bytes[tokens[right]])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, tokens[at], tokens[right]))

        for at in range(len(word) - 1):
            enter(at)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            if tokens[at] != left or after[at] >= len(word) or tokens[after[at]] != right:
                continue
            gone = after[at]
            tokens[at], tokens[gone] = rank, None
            after[at] = after[gone]
            if after[at] < len(word):
                before[after[at]] = at
            enter(at)
            if before[at] >= 0:
                enter(before[at])
        return [token for token in tokens if token is not None]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of all words, as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(word) for word in words]
        rest = [i for i, rank in enumerate(whole) if rank is None]
        found = [b"" if rank is None else np.array([rank], "<u4").tobytes() for rank in whole]
        if not rest:
            return found
        sizes = np.array([len(words[i]) for i in rest], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        tokens = self._byte_ids[np.frombuffer(b"".join(words[i] for i in rest), dtype=np.uint8)]
        word_of = np.repeat(np.arange(len(rest), dtype=np.int32), sizes)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = n  # n: no neighbour
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - sizes] = -1
        alone = np.zeros(len(rest), dtype=bool)  # words taken out
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            """List positions under the rank of their pair."""
            there = ranks >= 0
            at, ranks = at[there], ranks[there]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.append(0, cuts)].tolist() if len(at) else [], np.split(at, cuts), strict=False):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        first = np.flatnonzero(after < n)
        enter(first, self._rank_of(tokens[first], tokens[after[first]]))
        while heap:
            rank = heapq.heappop(heap)
            at = np.concatenate(index.pop(rank))
            # Entries may be out of date or doubled: the pair must still merge at this rank.
            at = at[(tokens[at] >= 0) & (after[at] < n) & ~alone[word_of[at]]]
            at = at[self._rank_of(tokens[at], tokens[after[at]]) == rank]
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
                # Of overlapping pairs the first, third and so on merge.
                chained = np.append(False, after[at[:-1]] == at[1:])
                if chained.any():
                    run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            has_right = beyond < n
            # The pair to the right as it is before its own merge at this rank.
            right = np.full(len(at), -1)
            right[has_right] = self._rank_of(np.full(int(has_right.sum()), rank), tokens[beyond[has_right]])
            tokens[at], tokens[gone] = rank, -1
            after[at] = beyond
            before[beyond[has_right]] = at[has_right]
            prior = before[at]
            has_left = prior >= 0
            left = np.full(len(at), -1)
            left[has_left] = self._rank_of(tokens[prior[has_left]], np.full(int(has_left.sum()), rank))
            lower = ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
            if lower.any():
                alone[word_of[at[lower]]] = True
            now = at[after[at] < n]
            touched = np.append(now, prior[has_left])
            enter(touched, self._rank_of(tokens[touched], tokens[after[touched]]))
        stays = tokens >= 0
        raw = tokens[stays].astype("<u4").tobytes()
        bounds = 4 * np.cumsum(np.bincount(word_of[stays], minlength=len(rest)))
        start = 0
        for i, end, taken_out in zip(rest, bounds.tolist(), alone.tolist(), strict=True):
            found[i] = np.array(self.encode_word(words[i]), "<u4").tobytes() if taken_out else raw[start:end]
            start = end
        return found


class BytePairs:
    """Encoding and decoding of whole texts."""

    def __init__(self, path: str, pattern: str):
        self._replay = MergeReplay.from_file(path)
        self._pattern = regex.compile(pattern)
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        encoded: list[bytes] = []
        block, size = [], 0
        for text in texts:
            block.append(text.decode("utf-8", "replace") if text else "")
            size += len(block[-1])
            if size >= BLOCK:
                encoded += self._encode_block(block)
                block, size = [], 0
        return encoded + self._encode_block(block)

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        """The chunks of a text are what stands between its single blanks, each with the
        blank before it: no match of the pattern reaches over their ends."""
        chunks, words = self._chunks, self._words
        whole = [i for i, text in enumerate(texts) if _has_wide_space(text)]
        odd = dict.fromkeys(whole)
        met: set[str] = set()
        starts: set[str] = set()
        for i, text in enumerate(texts):
            if i not in odd:
                first, *rest = text.split(" ")
                starts.add(first)
                met.update(rest)
        unknown = [chunk for chunk in met if chunk not in chunks]
        if len(chunks) + len(unknown) > MOST_KEPT:
            stay = {chunk: chunks[chunk] for chunk in met if chunk in chunks}
            chunks.clear()
            words.clear()
            chunks.update(stay)
        find = self._pattern.findall
        divided = {chunk: find(f" {chunk}") for chunk in unknown}
        begun = {first: find(first) for first in starts}
        odd = {i: find(texts[i]) for i in whole}
        new = {w for found in (divided, begun, odd) for own in found.values() for w in own if w not in words}
        new_words = list(new)
        ids = self._replay.replay([word.encode() for word in new_words])
        words.update(zip(new_words, ids, strict=True))
        for chunk, own in divided.items():
            chunks[chunk] = words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own])
        encoded = []
        for i, text in enumerate(texts):
            if i in odd:
                encoded.append(b"".join([words[w] for w in odd[i]]))
            else:
                first, *rest = text.split(" ")
                encoded.append(b"".join([words[w] for w in begun[first]]) + b"".join(map(chunks.__getitem__, rest)))
        for word in new_words:
            if len(word) > LONGEST_KEPT:
                del words[word]
        for chunk in unknown:
            if len(chunk) > LONGEST_KEPT:
                del chunks[chunk]
        return encoded


class Decoder:
    """Texts from ids. It needs the tokens alone, not the merges."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        self._tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self._decimals = [str(i) for i in range(len(self._tokens))]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids."""
        return b"".join(map(self._tokens.__getitem__, memoryview(ids).cast("I")))

    def decimals(self, ids: bytes) -> str:
        """Ids as decimals joined by commas."""
        return ",".join(map(self._decimals.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The worker's encoder for a rank file."""
    return BytePairs(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """The worker's decoder for a rank file."""
    return Decoder(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_documents(docs: DataFrame, carry: list[str], path: str, pattern: str) -> DataFrame:
    """One row per document: ``row`` (a struct of the ``carry`` columns), ``n_tokens`` and
    ``ids`` as little-endian unsigned 32-bit integers."""
    narrow = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text")
    )
    schema = T.StructType([narrow.schema["row"]]).add("n_tokens", T.LongType()).add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids = byte_pairs(path, pattern).encode(as_bytes(batch.column("text")))
            sizes = pa.array([len(own) // 4 for own in ids], pa.int64())
            columns = [batch.column("row"), sizes, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "ids"])

    return narrow.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Adds to encoded documents the bytes of their text (``decoded``) and their ids as
    decimals joined by commas (``ids_text``)."""
    schema = T.StructType(list(encoded.schema)).add("decoded", T.BinaryType()).add("ids_text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            pairs = decoder(path)
            ids = as_bytes(batch.column("ids"))
            decoded = pa.array([pairs.decode(own) for own in ids], pa.binary())
            texts = pa.array([pairs.decimals(own) for own in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded, texts], names=[*batch.schema.names, "decoded", "ids_text"])

    return encoded.mapInArrow(run, schema)
