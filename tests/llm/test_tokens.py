"""Tokens: chunked encoding, merge replay, records and packing."""

from __future__ import annotations

import base64
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cordwood.llm import bpe, packing, records
from cordwood.llm.crc32c import POLYNOMIAL, crc32c, masked
from cordwood.llm.shared import Scratch
from cordwood.llm.wordpieces import ChunkEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tiktoken_ids():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


CHUNKS = ChunkEncoder(WORDS)
PAIRS = bpe.BytePairs(RANKS, public_tokenizers.PATTERN)
TEXTS = st.lists(st.text(alphabet=" \n\t ab.,'ÉéΣσ1#<|>_-漢🙂́\x01\x85", max_size=40), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_chunked_ids_are_the_library_s(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    found = CHUNKS.encode([text.encode() for text in texts])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == expected


def changed_by_case_or_form():
    """Letters and marks that lower case or composition changes, and their neighbours."""
    for code in range(128, 0x110000):
        char = chr(code)
        if unicodedata.category(char)[0] in "LM":
            if char.lower() != char or any(unicodedata.normalize(f, char) != char for f in ("NFC", "NFD")):
                yield char


def test_letters_before_stops(library):
    texts = [f"ab{char}{stop} x{char}{stop}{stop}" for char in changed_by_case_or_form() for stop in ".,"]
    # Hangul syllables are many and alike.
    texts = [text for text in texts if not "\uac00" <= text[2] <= "\ud7a3" or ord(text[2]) % 50 == 0]
    tokenizer = Tokenizer.from_file(WORDS)
    expected = [one.ids for one in tokenizer.encode_batch(texts, add_special_tokens=False)]
    found = ChunkEncoder(WORDS).encode([text.encode() for text in texts])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == expected
    assert library("GELD\u0130.") == np.frombuffer(CHUNKS.encode(["GELD\u0130.".encode()])[0], "<u4").tolist()


SPECIAL = ["x<|endoftext|>y", "<|ENDOFTEXT|> a", "<|startoftext|>", " a <|endoftext|>. b,", "<|endoftext|"]


def test_special_strings(library):
    found = CHUNKS.encode([text.encode() for text in SPECIAL])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [library(text) for text in SPECIAL]
    assert library(SPECIAL[0]) == [343, 49407, 344]
    ordinary = Tokenizer.from_file(WORDS)
    ordinary.encode_special_tokens = True
    found = ChunkEncoder(WORDS, ordinary=True).encode([text.encode() for text in SPECIAL])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [
        ordinary.encode(text, add_special_tokens=False).ids for text in SPECIAL
    ]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="another way"):
        ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunk_table_is_bounded(monkeypatch, library):
    monkeypatch.setattr("cordwood.llm.wordpieces.MOST_KEPT", 50)
    encoder = ChunkEncoder(WORDS)
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(500)}." for _ in range(40)) for _ in range(20)]
    for text in texts:
        (ids,) = encoder.encode([text.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == library(text)
        assert len(encoder._chunks) <= 90


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_merge_replay_is_tiktoken(texts):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)} if not RANK_CACHE else None
    if ranks is not None:
        RANK_CACHE.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    found = PAIRS.encode([text.encode() for text in texts])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [RANK_CACHE[0].encode_ordinary(t) for t in texts]
    assert [bpe.decoder(RANKS).decode(ids) for ids in found] == [text.encode() for text in texts]


RANK_CACHE: list = []


@pytest.mark.parametrize("word", ["a" * 3001, "ab" * 2000, "abcabcabd" * 300, " " * 999, "é" * 501, "xyzzy" * 777])
def test_long_words(word, tiktoken_ids):
    (ids,) = PAIRS.encode([word.encode()])
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_ids(word)
    assert PAIRS._replay.encode_word(word.encode()) == tiktoken_ids(word)


def test_merges_that_make_lower_ranks():
    # "abc" ranks below "ab": once "ab" is merged, the pair with "c" comes first.
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 1, b"ab": 5, b"cab": 2, b"aba": 3}
    replay = bpe.MergeReplay(ranks)
    table = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 25))) for _ in range(300)]
    found = replay.replay([word.encode() for word in words])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [table.encode_ordinary(word) for word in words]


def test_encode_and_decode_documents(spark, docs, no_docs, rows, tiktoken_ids):
    encoded = bpe.encode_documents(docs, ["doc_id", "row"], RANKS, public_tokenizers.PATTERN)
    found = bpe.decode_documents(encoded, RANKS).collect()
    expected = Counter((row[0], (row[1] or "").encode(), ",".join(map(str, tiktoken_ids(row[1] or "")))) for row in rows)
    assert Counter((r["row"]["doc_id"], bytes(r["decoded"]), r["ids_text"]) for r in found) == expected
    assert bpe.encode_documents(no_docs, ["doc_id"], RANKS, public_tokenizers.PATTERN).count() == 0


def _slow_crc(value: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in value:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1600), max_size=6))
def test_checksums(values):
    assert crc32c(values).tolist() == [_slow_crc(value) for value in values]


def test_known_checksum():
    assert crc32c([b"123456789"]).tolist() == [0xE3069283]
    assert masked(np.array([0xE3069283], np.uint32)).dtype == np.uint32


def test_records_round_trip(spark, docs, rows, library):
    folder = Scratch(spark, "test-records").folder("shards")
    manifest = records.write_records(docs, WORDS, folder, end_id=1, shards=5).collect()
    found = records.read_records(spark, folder).orderBy("shard", "record").collect()
    ids = [[*library(row[1]), 1] for row in rows]
    raw = [np.array(own, "<u4").tobytes() for own in ids]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == Counter(zip([row[0] for row in rows], raw, strict=True))
    assert [r["doc_id"] is None for r in found] == sorted((r["doc_id"] is None for r in found), reverse=True)
    assert [r["doc_id"] for r in found if r["doc_id"] is not None] == sorted(row[0] for row in rows if row[0] is not None)
    before = 0
    for r in found:
        assert r["before"] == before and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        before += r["n_tokens"]
    for shard in manifest:
        own = [(r["doc_id"], bytes(r["ids"])) for r in found if r["shard"] == shard["shard"]]
        drawn = [(d, i.tobytes()) for d, i in records.shuffled(shard["records_file"], shard["index_file"], seed=3)]
        assert sorted(own, key=repr) == sorted(drawn, key=repr)


def test_records_of_nothing(spark, no_docs):
    folder = Scratch(spark, "test-records").folder("shards")
    assert records.write_records(no_docs, WORDS, folder, end_id=1, shards=2).count() == 0
    assert records.read_records(spark, folder).count() == 0


def test_broken_records_are_refused(tmp_path):
    framed = b"".join(records.frame([b"hello", b"world"]))
    (tmp_path / "good").write_bytes(framed)
    assert [p for block in records._read_shard(f"file://{tmp_path}/good", 2) for p in block] == [b"hello", b"world"]
    (tmp_path / "bad").write_bytes(framed.replace(b"world", b"worle"))
    with pytest.raises(ValueError, match="checksum"):
        list(records._read_shard(f"file://{tmp_path}/bad", 2))
    with pytest.raises(ValueError, match="manifest"):
        list(records._read_shard(f"file://{tmp_path}/good", 3))


def test_wide_ids():
    ids = np.array([1, 70_000], "<u4")
    assert records.read_payload(records.payload_of(7, ids, wide=True))[1].tolist() == [1, 70_000]
    assert records.read_payload(records.payload_of(None, ids[:1], wide=False))[0] is None


def test_packing(spark, docs, rows, library):
    found = packing.pack_documents(docs, WORDS, capacity=64, keep_ids=True).collect()
    expected = Counter()
    for row in rows:
        ids = np.array([*library(row[1]), 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            expected[row[0], piece, at, ids[at : at + 64].tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in found) == expected
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // 64) * 1.05 + 1


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=20, max_size=20))
def test_plan_places_every_piece_once(counts):
    histogram = np.array([0, *counts])
    plan = packing.make_plan(histogram)
    places = set()
    for length, count in enumerate(histogram):
        for number in range(count):
            key = (length << 40) + number
            at = np.searchsorted(plan.keys, key, side="right") - 1
            sequence = int(plan.base[at] + key - plan.keys[at])
            for token in range(length):
                place = (sequence, int(plan.offset[at]) + token)
                assert place not in places and place[1] < 20 and sequence < plan.sequences
                places.add(place)
    assert len(places) == int((histogram * np.arange(21)).sum())


def test_fitted_counts_reduce_the_distance():
    histogram = np.array([0, *([5] * 32)])
    patterns = packing.full_patterns(histogram)
    assert all(sum(p) == 32 for p in patterns.tolist())
    counts = packing.fit_counts(patterns, histogram)
    used = np.bincount(patterns.ravel(), np.repeat(counts, 3), 33)
    used[0] = 0
    assert counts.min() >= 0
    assert ((used - histogram) ** 2).sum() < 0.02 * (histogram**2).sum()
