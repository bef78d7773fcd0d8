"""Whole-document operators against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations, product
from pathlib import Path
from re import _parser

import numpy as np
import pytest

from cordwood.llm import exact_dedup, hilbert, language, licenses, line_rules, near_dedup
from cordwood.llm.license_rules import load
from cordwood.llm.shingles import shingle_set
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


# Exact dedup.


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_exact_groups(make, rows, block):
    if block == 1:
        rows = [row for row in rows if len(row[1] or "") < 3000]
    found = exact_dedup.exact_groups(make(rows, extra=True), ["doc_id", "rid"], block=block).collect()
    groups = defaultdict(list)
    for row in rows:
        groups[lower_ascii(row[1] or "")].append(row[0])
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            expected[i, keep, len(ids), sha] += 1
    assert Counter((r["row"]["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == expected
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["row"]["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_names_at_every_level(make):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(400)]
    found = exact_dedup.exact_groups(make([(i, t, "en", "a", 1) for i, t in enumerate(texts)]), ["doc_id"], block=1)
    size = Counter(texts)
    assert {r["row"]["doc_id"]: r["group_size"] for r in found.collect()} == {i: size[t] for i, t in enumerate(texts)}


def test_exact_without_broadcast(make, rows, monkeypatch):
    whole = Counter(map(tuple, exact_dedup.exact_groups(make(rows), ["doc_id"]).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, exact_dedup.exact_groups(make(rows), ["doc_id"]).collect())) == whole


def test_exact_of_nothing(no_docs):
    assert exact_dedup.exact_groups(no_docs, ["doc_id"]).count() == 0


# Quality rules.


def base_figures(text: str) -> tuple:
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    covered = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def brute_common(rows, limits) -> set:
    texts = defaultdict(set)
    for row in rows:
        texts[row[3] or ""].add(row[1] or "")
    common = set()
    for host, own in texts.items():
        seen = Counter(line for text in own for line in {normal(part) for part in text.split("\n") if WORD.search(part)})
        enough = limits.enough_documents or len(rows)
        common |= {
            (host, k) for k, n in seen.items() if n > enough or n > limits.least_documents and n > limits.share * len(own)
        }
    return common


def normal(line: str) -> str:
    joined = re.sub(r"[\x20\x09-\x0d]{2,}", " ", line.strip(" \t\n\x0b\x0c\r").lower())
    return re.sub("[0-9]+", "0", joined)


LIMITS = [
    line_rules.Limits(),
    line_rules.Limits(broadcast_hashes=0),
    line_rules.Limits(listed_hashes=0),
    line_rules.Limits(most_removed=0.05),
    line_rules.Limits(least_documents=20, enough_documents=None),
]


@pytest.mark.parametrize("limits", LIMITS)
def test_line_rules(make, rows, limits):
    found = line_rules.judge(make(rows, extra=True), ["doc_id", "row"], limits=limits).collect()
    common = brute_common(rows, limits)
    expected = Counter()
    for row in rows:
        text, host = row[1] or "", row[3] or ""
        parts = text.split("\n")
        taken = [part for part in parts if (host, normal(part)) in common]
        gone = sum(len(WORD.findall(part)) for part in taken)
        figures = base_figures(text)
        kept = not figures[-1] and gone <= limits.most_removed * figures[0]
        rest = "\n".join(part for part in parts if part not in taken) if taken else text
        expected[(row[0], *figures, kept, len(taken), gone, rest)] += 1
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    names += ("n_common_lines", "n_removed_words", "kept_text")
    assert Counter((r["row"]["doc_id"], *(r[n] for n in names)) for r in found) == expected
    assert sum(r["n_common_lines"] for r in found) == 40


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_line_limits_hold_at_every_host_size(make, broadcast):
    """A large host with lines well under a tenth of its texts, and a small one."""
    rng = random.Random(10)
    lines = {"Follow us": ("large", 21), "Read on 7": ("large", 20), "Next page": ("small", 6), "Go back": ("small", 5)}
    rows = []
    for host, size in (("large", 600), ("small", 40)):
        for i in range(size):
            own = [line for line, (at, n) in lines.items() if at == host and i < n]
            body = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
            rows.append((len(rows), "\n".join([*own, body]), "en", host, 1))
    # A copy of a text adds no text.
    rows += [(len(rows) + i, rows[0][1], "en", "large", 1) for i in range(50)]
    limits = line_rules.Limits(least_documents=5, enough_documents=20, broadcast_hashes=broadcast)
    found = line_rules.judge(make(rows, extra=True), ["doc_id"], limits=limits).collect()
    expected = Counter()
    for row in rows:
        parts = row[1].split("\n")
        rest = [part for part in parts if part not in ("Follow us", "Next page")]
        expected[row[0], len(parts) - len(rest), "\n".join(rest), True] += 1
    got = Counter((r["row"]["doc_id"], r["n_common_lines"], r["kept_text"], r["kept"]) for r in found)
    assert got == expected


def test_copies_do_not_make_a_line_common(make):
    text = "first line of a document\n" + " ".join(f"w{i}" for i in range(60))
    found = line_rules.judge(make([(i, text, "en", "a", 1) for i in range(50)]), ["doc_id"]).collect()
    assert all(r["kept"] and not r["n_common_lines"] for r in found)


def test_repeated_words_at_the_edges(make):
    rng = random.Random(5)
    texts = ["", "a", "a b", "a b c", "a b c a b c", "a a a a", *(" ".join(rng.choices("abc", k=rng.randint(0, 15))) for _ in range(300))]
    found = line_rules.judge(make([(i, t, "en", "a", 1) for i, t in enumerate(texts)]), ["doc_id"]).collect()
    assert {r["row"]["doc_id"]: r["n_repeat_words"] for r in found} == {i: base_figures(t)[4] for i, t in enumerate(texts)}


def test_line_rules_are_native(make, rows):
    plan = line_rules.judge(make(rows), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_rules_of_nothing(no_docs):
    assert line_rules.judge(no_docs, ["doc_id"]).count() == 0


# Near-duplicates.


def brute_components(rows, width: int, percent: int) -> list[tuple]:
    sets = [shingle_set((row[1] or "").encode(), width) for row in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            parent[find(j)] = find(i)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return [(row[0], len(own), least.get(find(i)) if own else row[0]) for i, (row, own) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(make, rows, width):
    found = near_dedup.near_duplicates(make(rows, extra=True), ["doc_id", "node"], near_dedup.Settings(width=width)).collect()
    assert Counter((r["row"]["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == Counter(brute_components(rows, width, 80))
    stays = Counter(r["component_id"] for r in found if r["stays"] and r["n_shingles"] and r["component_id"] is not None)
    assert set(stays.values()) == {1}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_chains_and_mixed_buckets(make, monkeypatch):
    """Families around the threshold: chains whose ends aren't similar, and buckets with
    several components, compared in blocks of three nodes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rng = random.Random(6)
    rows = []
    for family in range(12):
        words = [f"w{family}x{i}" for i in range(100)]
        for _ in range(12):
            # Each step changes a little, some steps too much.
            for _ in range(rng.choice([1, 2, 3, 4, 6])):
                words[rng.randrange(100)] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(words), "en", "a", 1))
    rng.shuffle(rows)
    found = near_dedup.near_duplicates(make(rows), ["doc_id"], near_dedup.Settings(width=3)).collect()
    expected = {i: c for i, _, c in brute_components(rows, 3, 80)}
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert 12 < len(set(expected.values())) < len(rows)


def test_posterior_bounds():
    settings = near_dedup.Settings()
    bounds = near_dedup.least_matches(settings)
    assert bounds[-1][0] == settings.count
    rng = np.random.default_rng(1)
    # Pairs at the threshold: none of very many is lost.
    left = np.zeros((20_000, settings.count), np.uint32)
    right = (rng.random(left.shape) > 0.8).astype(np.uint32)
    assert len(near_dedup.surviving(left, right, settings)[0]) == len(left)
    far = (rng.random(left.shape) > 0.5).astype(np.uint32)
    assert len(near_dedup.surviving(left, far, settings)[0]) < 200


def test_near_of_nothing(no_docs, make):
    assert near_dedup.near_duplicates(no_docs, ["doc_id"]).count() == 0
    (row,) = near_dedup.near_duplicates(make([(3, None, None, None, None)]), ["doc_id"]).collect()
    assert (row["component_id"], row["kept"], row["stays"], row["n_shingles"]) == (3, True, True, 0)


# Language.


def test_language(spark, make, rows):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi", "ren"], "bb": ["schu", "ber", "lich", "ge"], "cc": ["ção", "ez", "lla", "os"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))

    told = [(i, text(lang, rng.randint(5, 200)), lang, "a", 1) for i, lang in enumerate(rng.choices(list(syllables), k=240))]
    model = language.fit(make(told[:180] + rows[5:7]))
    assert [lang for lang, _ in model] == sorted(syllables)
    found = {r["row"]["doc_id"]: r for r in language.identify(make(told[180:]), ["doc_id", "lang"], model).collect()}
    right = [r["lang_pred"] == r["row"]["lang"] for r in found.values()]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    odd = language.identify(make(rows, extra=True), ["doc_id", "row"], model).collect()
    unknown = [r for r in odd if r["lang_pred"] == "und"]
    letters = [row for row in rows if not row[1] or not any(c.isalpha() for c in row[1])]
    assert len(odd) == len(rows) and len(unknown) == len(letters)
    assert all(r["score"] == 0 and not r["accepted"] for r in unknown)


def test_a_scarce_language_does_not_cut_the_others(make):
    rng = random.Random(11)
    syllables = {"aa": ["ka", "to", "mi", "ren"], "bb": ["schu", "ber", "lich", "ge"], "cc": ["ção", "ez", "lla", "os"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))

    # Many short texts, few long ones, and one short document.
    told = [text("aa", 4) for _ in range(3000)], [text("bb", 9000) for _ in range(2)], [text("cc", 40)]
    rows = [(i, t, lang, "a", 1) for lang, own in zip(syllables, told, strict=True) for i, t in enumerate(own)]
    rows += [(9, told[1][0], "bb", "a", 1)] * 200
    settings = language.Settings()
    model = dict(language.fit(make(rows)))
    assert len(model["aa"]) == len(model["bb"]) == settings.dictionary
    assert model["cc"] == told[2][0].lower().encode()
    for lang in syllables:
        found = [language.classify(text(lang, 60).encode(), tuple(sorted(model.items())), settings) for _ in range(50)]
        assert sum(name == lang for name, _, _ in found) >= 48


def test_language_reads_the_whole_text():
    model = (("aa", b"kato miren toka " * 200), ("bb", b"schuber lichge berge " * 200))
    settings = language.Settings()
    assert language.classify(b"kato " * 10 + b"schuber lichge " * 5000, model, settings)[0] == "bb"
    assert language.classify(b"...123...", model, settings) == ("und", 0.0, False)
    same = language.classify("漢字".encode(), model, settings)
    assert same[1] <= 0.5 and not same[2]


def test_language_of_nothing(no_docs, make, rows):
    assert language.fit(no_docs) == ()
    assert language.identify(no_docs, ["doc_id"], ()).count() == 0
    assert {r["lang_pred"] for r in language.identify(make(rows), ["doc_id"], ()).collect()} == {"und"}


# Licenses.


def naive_scan(joined: bytes) -> list[tuple]:
    """Every rule on the text, and containment tested pair by pair."""
    rules = load()
    found = sorted(
        (-rule.priority, m.start() - m.end(), m.start(), n)
        for n, rule in enumerate(rules)
        for m in (rule.pattern.finditer(joined) if rule.keyword.encode() in joined else ())
    )
    taken = []
    for _, minus, start, n in found:
        if not any(a <= start and start - minus <= b for a, b, _ in taken):
            taken.append((start, start - minus, n))
    return [(rules[n].label, rules[n].score, joined[:a].count(b" ") - 1, joined[a:b].count(b" ") + 1) for a, b, n in sorted(taken)]


PHRASES = [
    "Licensed under the Apache License, Version 2.0", "Permission is hereby granted, free of charge, to any person obtaining",
    "CC BY-NC-SA 4.0", "cc by", "GNU General Public License version 3", "all rights reserved", "(c) Copyright 2001 ACME. All rights reserved",
    "SPDX-License-Identifier: GPL-3.0-or-later", "see the LICENSE file", "mit", "the MIT license", "general", "public", "domain",
]


def test_licenses(make, rows):
    rng = random.Random(9)
    told = [(1000 + i, " ".join(rng.choices(PHRASES, k=rng.randint(0, 9))), "en", "a", 1) for i in range(150)]
    found = licenses.scan_documents(make([*rows, *told], extra=True), ["doc_id", "label"]).collect()
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    expected = Counter()
    for row in [*rows, *told]:
        words = word.findall(lower_ascii(row[1] or ""))
        places = sorted(
            (i, label)
            for phrase, label in licenses.BASE
            for own in [phrase.decode().split()]
            for i in range(len(words))
            if words[i : i + len(own)] == own
        )
        joined = f" {' '.join(words)} ".encode()
        expected[row[0], len(words), tuple(places), tuple(naive_scan(joined))] += 1
    got = Counter((r["row"]["doc_id"], r["n_words"], tuple(map(tuple, r["base"])), tuple(map(tuple, r["detections"]))) for r in found)
    assert got == expected


def test_scans_take_time_in_proportion():
    """Places of detections are counted in one pass over a text, however many they are."""
    notice = b"all rights reserved cc by licensed under the apache license version 2.0 "
    rules = licenses.scanner()
    took = []
    for times in (4_000, 16_000):
        joined = b" " + notice * times
        started = time.perf_counter()
        assert len(licenses.base_places(joined)) == 2 * times
        assert len(rules.scan(joined)) >= times
        took.append(time.perf_counter() - started)
    assert took[1] < 10 * took[0]


def test_rules_have_their_keywords():
    rules = load()
    assert len(rules) >= 200
    assert len({(r.label, r.kind, r.pattern.pattern) for r in rules}) == len(rules)


def accepted(node) -> list[str]:
    """Texts made from every alternative of a parsed pattern."""
    texts = [""]
    for kind, value in node:
        match str(kind):
            case "LITERAL":
                own = [chr(value)]
            case "IN":
                own = [chr(a) if str(k) == "LITERAL" else "7" for k, a in value]
            case "BRANCH":
                own = [text for branch in value[1] for text in accepted(branch)]
            case "SUBPATTERN":
                own = accepted(value[3])
            case "MAX_REPEAT":
                least, most, inner = value
                often = sorted({least, max(least, 1), min(most, max(least, 1) + 1)})
                own = ["".join(run) for n in often for run in product(accepted(inner), repeat=n)]
            case "ASSERT":
                own = [""]
        texts = [text + more for text in texts for more in own]
    return texts


def test_no_rule_is_lost_to_its_keyword():
    """The scan of texts of every alternative equals one that tries all patterns."""
    rules, scan = load(), licenses.scanner().scan
    for rule in rules:
        parsed = _parser.parse(rule.pattern.pattern.replace(rb"\S+", b"zz").decode("latin-1"))
        for text in {f" {text} ".encode("latin-1") for text in accepted(parsed)}:
            assert rule.pattern.search(text)
            assert rule.keyword.encode() in text, (rule.label, text)
            assert scan(text) == ungated_scan(text)


def ungated_scan(joined: bytes) -> list[tuple]:
    rules = load_once()
    found = sorted(
        (-rule.priority, m.start() - m.end(), m.start(), n) for n, rule in enumerate(rules) for m in rule.pattern.finditer(joined)
    )
    taken = []
    for _, minus, start, n in found:
        if not any(a <= start and start - minus <= b for a, b, _ in taken):
            taken.append((start, start - minus, n))
    return [(rules[n].label, rules[n].score, joined[:a].count(b" ") - 1, joined[a:b].count(b" ") + 1) for a, b, n in sorted(taken)]


load_once = lru_cache(load)


def test_bsd_clause_of_an_author():
    clause = b" the name of the author may not be used to endorse or promote products derived from this software"
    assert [d[0] for d in licenses.scanner().scan(clause + b" without specific prior written permission ")] == ["bsd-3-clause"]


def test_stronger_readings_win():
    scan = licenses.scanner().scan
    assert [d[0] for d in scan(b" licensed under the apache license version 2 0 ")] == ["apache-2.0"]
    assert [d[0] for d in scan(b" cc by nc sa 4 0 ")] == ["cc-by-nc-sa-4.0"]
    assert [d[0] for d in scan(b" gnu general public license version 3 or later ")] == ["gpl-3.0"]
    assert scan(b"  ") == []


def test_licenses_of_nothing(no_docs):
    assert licenses.scan_documents(no_docs, ["doc_id"]).count() == 0


# Shards.


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_neighbours(n, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    index = hilbert.hilbert_index(points, bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1)
    assert set(steps.tolist()) == {1}


def dimensions():
    return [
        hilbert.Dimension("lang", F.col("lang")),
        hilbert.Dimension("source", F.col("source")),
        hilbert.NumberDimension("chars", F.col("n_chars")),
    ]


def test_shards(make, rows, spark):
    found = hilbert.shard(make(rows, extra=True), ["doc_id", "rid"], dimensions(), shards=4).collect()
    assert Counter(r["row"]["doc_id"] for r in found) == Counter(row[0] for row in rows)
    slots = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["shard"], r["slot"])):
        slots[r["shard"]].append(r["slot"])
    sizes = [len(own) for own in slots.values()]
    assert sorted(slots) == [0, 1, 2, 3] and max(sizes) - min(sizes) <= 1
    assert all(own == list(range(len(own))) for own in slots.values())
    curve = [r["curve"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)


def test_fewer_rows_than_shards(make, no_docs):
    found = hilbert.shard(make([(i, "x", "en", "a", 1) for i in range(3)]), ["doc_id"], dimensions(), shards=16).collect()
    assert sorted((r["shard"], r["slot"]) for r in found) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert.shard(no_docs, ["doc_id"], dimensions(), shards=16).count() == 0


def test_shard_files_are_pruned_by_the_manifest(make, rows, spark, tmp_path):
    sharded = hilbert.shard(make(rows), ["doc_id", "text", "lang", "n_chars"], dimensions(), shards=4)
    manifest = hilbert.write_shards(sharded, f"file://{tmp_path}/shards")
    assert manifest.agg(F.sum("n_rows")).first()[0] == len(rows)
    data = spark.read.parquet(f"file://{tmp_path}/shards/data")
    assert Counter(r["doc_id"] for r in data.collect()) == Counter(row[0] for row in rows)
    for r in manifest.collect():
        own = data.where(F.col("shard") == r["shard"]).agg(F.min("n_chars"), F.max("n_chars")).first()
        assert (r["least_chars"], r["greatest_chars"]) == tuple(own)


def test_shard_files_keep_columns_named_like_places(make, spark, tmp_path):
    docs = make([(i, f"text {i}", "en", "a", i) for i in range(40)])
    docs = docs.withColumn("Slot", F.lit("own")).withColumn("shard", F.col("doc_id") * 2)
    sharded = hilbert.shard(docs, ["doc_id", "Slot", "shard"], dimensions(), shards=4)
    hilbert.write_shards(sharded, f"file://{tmp_path}/shards")
    data = spark.read.parquet(f"file://{tmp_path}/shards/data").withColumn("file", F.input_file_name()).collect()
    assert {(r["Slot"], r["shard"] - 2 * r["doc_id"]) for r in data} == {("own", 0)}
    assert sorted((r["_shard"], r["_slot"]) for r in data) == [(s, i) for s in range(4) for i in range(10)]
    # Each file holds a run of slots without a gap.
    for file in {r["file"] for r in data}:
        slots = sorted(r["_slot"] for r in data if r["file"] == file)
        assert slots == [*range(slots[0], slots[-1] + 1)]


def test_texts_with_a_common_beginning_stay_apart(make):
    docs = make([(i, "x", "en", f"https://h{i % 9}.example/", 1) for i in range(90)])
    found = hilbert.shard(docs, ["doc_id"], [hilbert.Dimension("source", F.col("source"))], shards=3).collect()
    by_curve = {}
    for r in found:
        by_curve.setdefault(r["curve"], set()).add(r["row"]["doc_id"] % 9)
    assert sorted(map(len, by_curve.values())) == [1] * 9


def test_text_bins_end_at_quantiles_of_rows(spark):
    rng = random.Random(3)
    common = "\u00e9" * 20
    values = [None] * 30 + [common + str(rng.randint(0, 60)) for _ in range(300)] + [common] * 200 + ["", "\U0001f600"]
    ordered = sorted(values, key=lambda v: b"" if v is None else b"\1" + v.encode())
    edges = set()
    for k in range(1, 9):
        # The value of the first row with which k eighths of all rows are reached.
        edges.add(ordered[-(-k * len(ordered) // 8) - 1])
    keys = spark.createDataFrame([(v,) for v in rng.sample(values, len(values))], "value string").repartition(3)
    found = hilbert.text_cuts(keys, "value", bits=3)
    assert found == sorted(b"" if v is None else b"\1" + v.encode() for v in edges)
    assert hilbert.text_cuts(keys.limit(0), "value", bits=3) == []


def test_thinned_keeps_one_whole_row_of_each_component(make, rows, monkeypatch):
    found = near_dedup.near_duplicates(make(rows, extra=True), ["doc_id", "text"], near_dedup.Settings()).collect()
    told = Counter((r["row"]["doc_id"], r["row"]["text"]) for r in found if r["stays"])
    for limit in (near_dedup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", limit)
        docs = make(rows, extra=True)
        thinned = near_dedup.thinned(docs)
        assert thinned.columns == docs.columns
        kept = thinned.collect()
        assert Counter(r["doc_id"] for r in kept) == Counter(d for d, _ in told.elements())
        texts = {(r["doc_id"], r["text"]) for r in kept}
        assert texts <= {(row[0], row[1]) for row in rows}
    assert near_dedup.thinned(make([])).count() == 0


def test_cleared_leaves_no_table(spark, make, rows):
    from cordwood.llm.shared import Scratch, cleared, shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = {p.name for p in Path(folder).iterdir()}
    with cleared(spark, "stage"):
        assert near_dedup.thinned(make(rows)).count()
        inside = Scratch(spark, "x")
        inside.write(make(rows), "y")
        assert inside.path.startswith(shared_folder(spark))
    assert {p.name for p in Path(folder).iterdir()} == before
