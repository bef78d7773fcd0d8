"""Columns of the queries' results against plain Python."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from cordwood.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def word_ids(texts):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return {doc_id: tokenizer.encode(text, add_special_tokens=False).ids for doc_id, text in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_have_sizes_checksums_and_gapless_slots(spark, tables, texts):
    found = QUERIES["op2_hilbert_shards"](spark, tables).collect()
    told = {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in found}
    raw = {doc_id: text.encode() for doc_id, text in texts.items()}
    assert told == {doc_id: (len(text) + 1, zlib.crc32(text), "rows", None) for doc_id, text in raw.items()}
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16))
    assert all(sorted(own) == [*range(len(own))] for own in slots.values())
    counts = [len(slots[shard]) for shard in range(16)]
    assert max(counts) - min(counts) <= 1


def test_replayed_ids_have_the_hashes_of_the_library(spark, tables, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text)
        digests = (",".join(map(str, ids)).encode(), text.encode())
        expected[doc_id] = (len(ids), *(hashlib.sha256(d).hexdigest() for d in digests))
    found = QUERIES["op4_merge_replay"](spark, tables).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == expected


def test_pieces_hold_the_ids_of_the_library(spark, tables, word_ids):
    expected = set()
    for doc_id, ids in word_ids.items():
        ids = [*ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            expected.add((doc_id, piece, start, len(own), crc(own)))
    found = QUERIES["op6_best_fit_packing"](spark, tables).collect()
    told = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert len(told) == len(set(told))
    assert set(told) == expected
    filled = defaultdict(list)
    for r in found:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_records_read_back_the_ids_of_the_library(spark, tables, word_ids):
    expected, start = {}, 0
    for doc_id, ids in sorted(word_ids.items()):
        ids = [*ids, 1]
        expected[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    found = QUERIES["op8_binary_records"](spark, tables).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == expected


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_base_places_and_labels(spark, tables, texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    expected = {}
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        starts, labels = [], set()
        for phrase, label in PHRASES.items():
            own = phrase.split()
            places = [at for at in range(len(words)) if words[at : at + len(own)] == own]
            starts += places
            labels |= {label} if places else set()
        ends = (min(starts), max(starts)) if starts else (None, None)
        expected[doc_id] = (len(words), len(starts), *ends, ",".join(sorted(labels)))
    found = QUERIES["op9_signature_rules"](spark, tables).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in found} == expected
    for r in found:
        base, labels = (set(filter(None, r[n].split(","))) for n in ("base_labels", "labels"))
        assert base <= labels
        assert ",".join(sorted(labels)) == r["labels"]
        assert 0 <= r["score"] <= 1


def test_formatted_conversations_read_back(spark, tables):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {-1: [(0, "user", said), (1, "assistant", said)]}
    for r in spark.read.parquet(f"{tables}/conversations.parquet").collect():
        turn = -1 if r["turn"] is None else r["turn"]
        turns.setdefault(r["conv_id"], []).append((turn, r["role"] or "", r["text"] or ""))
    expected = {}
    for conv_id, own in turns.items():
        if len({turn for turn, _, _ in own}) < len(own):
            continue  # rows of the same turn may come in any order
        own.sort(key=lambda row: row[0])
        told = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        expected[conv_id] = (len(own), *(hashlib.sha256(x.encode()).hexdigest() for x in (told, loss)), len(loss))
    found = QUERIES["op10_offset_masks"](spark, tables).collect()
    names = ("n_turns", "turns_sha256", "loss_sha256", "loss_chars")
    told = {r["conv_id"]: tuple(r[n] for n in names) for r in found}
    assert set(told) == set(turns)
    assert expected[-1] == told[-1]
    assert {conv_id: told[conv_id] for conv_id in expected} == expected
