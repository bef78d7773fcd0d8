"""License scans by ordered signature rules.

A text becomes its words in lower case with one blank between them. One pass of an
Aho-Corasick automaton finds which keywords occur; only the rules of those are tried.
Detections are ordered by priority, then length, then place, and one that lies inside a
detection already taken is suppressed, so that a longer or stronger reading replaces the
shorter ones within it.

Three base phrases are counted apart from the rules and always keep their labels.

A null or empty text has no words and no labels. Repeated rows are scanned alike.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.llm.license_rules import Rule, load
from cordwood.llm.shared import as_bytes

#: Base phrases and their labels.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z in lower case; bytes that stand in no word become blanks.
_TO_WORDS = bytes(low if (low := b + 32 if 65 <= b <= 90 else b) in _WORD_BYTES else 32 for b in range(256))

#: (label, score, first word, words)
Detection = tuple[str, float, int, int]


class Scanner:
    """The rules and their keywords."""

    def __init__(self, rules: list[Rule]):
        self._rules = rules
        by_keyword: dict[str, list[int]] = {}
        for number, rule in enumerate(rules):
            # The automaton works on characters: one for each byte.
            by_keyword.setdefault(rule.keyword.encode().decode("latin-1"), []).append(number)
        self._keywords = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self._keywords.add_word(keyword, (keyword, numbers))
        self._keywords.make_automaton()

    def scan(self, joined: bytes) -> list[Detection]:
        """What stays of all detections in joined words, in order of place."""
        met = {keyword: numbers for _, (keyword, numbers) in self._keywords.iter(joined.decode("latin-1"))}
        found = [
            (-rule.priority, match.start() - match.end(), match.start(), number)
            for number in sorted(n for numbers in met.values() for n in numbers)
            for rule in [self._rules[number]]
            for match in rule.pattern.finditer(joined)
        ]
        found.sort()
        # Taken intervals that lie in no other taken one: starts and ends both ascend.
        starts: list[int] = []
        ends: list[int] = []
        taken = []
        for _, minus_length, start, number in found:
            end = start - minus_length
            at = bisect_right(starts, start)
            if at and ends[at - 1] >= end:
                continue
            taken.append((start, end, number))
            # A stronger detection may lie inside this one: it stays, its interval is covered.
            low = at - 1 if at and starts[at - 1] == start else at
            high = at
            while high < len(ends) and ends[high] <= end:
                high += 1
            starts[low:high], ends[low:high] = [start], [end]
        taken.sort()
        spans = np.array([span[:2] for span in taken], dtype=np.int64).reshape(-1, 2)
        before, until = blanks_before(joined, spans[:, 0]), blanks_before(joined, spans[:, 1])
        return [
            (self._rules[n].label, self._rules[n].score, int(first) - 1, int(last - first) + 1)
            for (_, _, n), first, last in zip(taken, before, until, strict=True)
        ]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(load())


def blanks_before(joined: bytes, places: np.ndarray) -> np.ndarray:
    """How many blanks stand before each place: one pass over the text for all of them."""
    if not len(places):
        return np.zeros(0, dtype=np.int64)
    return np.searchsorted(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32), places)


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """First word and label of every place of a base phrase."""
    places = []
    for phrase, label in BASE:
        wanted, at = b" " + phrase + b" ", -1
        while (at := joined.find(wanted, at + 1)) >= 0:
            places.append((at, label))
    words = blanks_before(joined, np.array([at for at, _ in places], dtype=np.int64))
    return sorted((int(word), label) for word, (_, label) in zip(words, places, strict=True))


def scan_documents(docs: DataFrame, carry: list[str]) -> DataFrame:
    """One row per document: ``row`` (a struct of the ``carry`` columns), ``n_words``,
    ``base`` (word and label of each place of a base phrase), and ``detections``."""
    narrow = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text")
    )
    found = "n_words long, base array<struct<word:long,label:string>>, "
    found += "detections array<struct<label:string,score:double,word:long,words:long>>"
    schema = T.StructType([narrow.schema["row"], *T.StructType.fromDDL(found)])
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    detection = [("label", pa.string()), ("score", pa.float64()), ("word", pa.int64()), ("words", pa.int64())]
    names = [name for name, _ in detection]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = scanner()
        for batch in batches:
            sizes, base, detections = [], [], []
            for text in as_bytes(batch.column("text")):
                words = (text or b"").translate(_TO_WORDS).split()
                joined = b" " + b" ".join(words) + b" "
                sizes.append(len(words))
                base.append([{"word": word, "label": label} for word, label in base_places(joined)])
                detections.append([dict(zip(names, one, strict=True)) for one in rules.scan(joined)])
            arrays = [
                batch.column("row"),
                pa.array(sizes, pa.int64()),
                pa.array(base, base_type),
                pa.array(detections, pa.list_(pa.struct(detection))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "base", "detections"])

    return narrow.mapInArrow(run, schema)
