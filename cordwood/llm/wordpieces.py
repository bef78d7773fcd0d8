"""Token ids of whole texts by a tokenizers file that drops white space.

A tokenizer whose pre-tokenizer never matches across white space gives a text the ids of
its white-space separated chunks, one after the other. Chunks repeat, so each worker keeps
a bounded table of the chunks it has met and asks the library only for new ones: many in
one call, with a control character between them whose id marks the ends.

Strings of special tokens in a text are special, as in a library call, unless they are asked
to be ordinary: a text that holds one in any case goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np

from cordwood.llm.shared import held

#: Chunks longer than this many bytes are encoded each time and not kept.
LONGEST_KEPT = 48
#: Beyond so many chunks a worker's table keeps only those of the texts at hand.
MOST_KEPT = 600_000
#: Bytes of text that are looked up together.
_BLOCK = 4 << 20
#: Stands between chunks in a call; a chunk that holds it is encoded alone.
_MARK = "\x01"
_PER_CALL = 100


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte of a word in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    letters[32] = " "  # stands between words here
    return letters


BYTE_LETTERS = _byte_letters()


def _is_lower_word(part: bytes) -> bool:
    """Whether a part, A-Z in lower case, is one word of letters that normalising leaves as it is."""
    if part.isascii():
        return part.isalpha()
    text = part.decode("utf-8", "replace")
    return text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text)


def _ends_in_letter(part: bytes) -> bool:
    """Whether a part ends in a letter that normalising leaves a letter.

    Others may become a letter and a mark, which is a pre-token together with a stop.
    """
    last = (part[-1:] if part[-1] < 128 else part[-4:]).decode("utf-8", "replace")[-1]
    return last.isalpha() and last.lower() == last and unicodedata.is_normalized("NFC", last)


#: What a tokenizer does before its merges, as far as the ways around the library need it.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _check(tokenizer: str) -> None:
    """Raises for a tokenizer whose chunks, words or stops are other than is assumed here."""
    parts = json.loads(tokenizer)
    normalizer, split = parts["normalizer"] or {}, (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    fits = normalizer.get("normalizers") == _NORMALIZERS and len(split) == 2
    fits = fits and split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("invert") is True
    fits = fits and split[1].get("type") == "ByteLevel" and not split[1].get("add_prefix_space")
    if not fits or parts["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError("the tokenizer normalises or splits texts in another way than this encoder knows")


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``ordinary`` takes strings of special tokens that stand in a text as ordinary text. Null
    and empty texts have no ids.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        _check(self._tokenizer.to_str())
        # The tokens of a text that holds none of these strings are the same either way.
        self._tokenizer.encode_special_tokens = ordinary
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._special = [] if ordinary else [token.content.encode().lower() for token in added]
        # The same merges for words that need no normalising and are one pre-token.
        self._plain = Tokenizer(self._tokenizer.model)
        self._plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocabulary = self._tokenizer.get_vocab_size()
        self._ends_word = np.zeros(self.vocabulary, dtype=bool)
        for token, i in self._tokenizer.get_vocab(False).items():
            self._ends_word[i] = token.endswith("</w>")
        self._chunks: dict[bytes, bytes] = {}
        self._parts: dict[bytes, bytes] = {}
        (self._mark,) = self._tokenizer.encode(_MARK, add_special_tokens=False).ids

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [one.ids for one in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[bytes]) -> None:
        """Lower-case words of letters: the last id of each is one that ends a word."""
        calls = range(0, len(words), _PER_CALL)
        joint = [b" ".join(words[at : at + _PER_CALL]).decode("latin-1").translate(BYTE_LETTERS) for at in calls]
        for at, one in zip(calls, self._plain.encode_batch_fast(joint, add_special_tokens=False), strict=True):
            ids = np.array(one.ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            ends = (4 * np.flatnonzero(self._ends_word[ids]) + 4).tolist()
            for word, end in zip(words[at : at + _PER_CALL], ends, strict=True):
                self._parts[word] = raw[start:end]
                start = end

    def _learn(self, parts: list[bytes]) -> None:
        self._learn_words([part for part in parts if _is_lower_word(part)])
        parts = [part for part in parts if part not in self._parts]
        texts = [part.decode("utf-8", "replace") for part in parts]
        joint = [i for i, text in enumerate(texts) if _MARK not in text]
        alone = [i for i, text in enumerate(texts) if _MARK in text]
        for i, ids in zip(alone, self._library([texts[i] for i in alone]), strict=True):
            self._parts[parts[i]] = array("I", ids).tobytes()
        calls = [joint[at : at + _PER_CALL] for at in range(0, len(joint), _PER_CALL)]
        found = self._library([f" {_MARK} ".join(texts[i] for i in call) for call in calls])
        for call, ids in zip(calls, found, strict=True):
            start = 0
            ids.append(self._mark)
            for i in call:
                end = ids.index(self._mark, start)
                self._parts[parts[i]] = array("I", ids[start:end]).tobytes()
                start = end + 1

    def _has_special(self, text: bytes | None) -> bool:
        lower = text.lower() if text and self._special else b""
        return any(string in lower for string in self._special)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text."""
        alone = {i: text for i, text in enumerate(texts) if self._has_special(text)}
        encoded = self._encode_ordinary([b"" if i in alone else text for i, text in enumerate(texts)])
        for i, text in alone.items():
            (ids,) = self._library([text.decode("utf-8", "replace")])
            encoded[i] = array("I", ids).tobytes()
        return encoded

    def _encode_ordinary(self, texts: list[bytes | None]) -> list[bytes]:
        encoded: list[bytes] = []
        block, size = [], 0
        for text in texts:
            block.append(text.lower() if text else b"")
            size += len(block[-1])
            if size >= _BLOCK:
                encoded += self._encode_block(block)
                block, size = [], 0
        return encoded + self._encode_block(block)

    def _encode_block(self, lower: list[bytes]) -> list[bytes]:
        chunks, parts = self._chunks, self._parts
        met: set[bytes] = set()
        for text in lower:
            met.update(text.split())
        unknown = [chunk for chunk in met if chunk not in chunks]
        if len(chunks) + len(unknown) > MOST_KEPT:
            # Chunks of this block stay: the frequent ones are among them.
            stay = {chunk: chunks[chunk] for chunk in met if chunk in chunks}
            chunks.clear()
            parts.clear()
            chunks.update(stay)
        # A stop or comma after a letter is a pre-token of its own, however it goes on.
        divided = []
        for chunk in unknown:
            word = chunk.rstrip(b".,") if chunk[-1] in b".," else chunk
            if word and len(word) < len(chunk) and _ends_in_letter(word):
                divided.append((chunk, word, chunk[len(word) :]))
            else:
                divided.append((chunk, chunk, b""))
        needed = {word for _, word, _ in divided} | {end for _, _, end in divided}
        parts[b""] = b""
        self._learn([part for part in needed if part not in parts])
        for chunk, word, end in divided:
            chunks[chunk] = parts[word] + parts[end] if end else parts[word]
        encoded = [b"".join(map(chunks.__getitem__, text.split())) for text in lower]
        for chunk in unknown:
            if len(chunk) > LONGEST_KEPT:
                del chunks[chunk]
                parts.pop(chunk, None)
        return encoded


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    return held(("encoder", path), lambda: ChunkEncoder(path))
