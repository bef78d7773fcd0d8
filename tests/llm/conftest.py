from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from cordwood.llm.shared import with_package

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    return with_package(spark)


def prose(rng: random.Random, words: int) -> str:
    syllables = ["ta", "re", "on", "in", "mo", "sel", "dor", "é", "ka", "ü"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeats, odd characters."""
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    boiler = "Share this page with friends 12"
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base.upper().replace("É", "é").replace("Ü", "ü"), "en", "b", 0),
        (4, near, "en", "a", None),
        (5, None, "en", "a", None),
        (6, "", None, None, 0),
        (7, " \n\t ", "de", "a", 4),
        (None, prose(rng, 80), None, "b", 1),
        (None, None, None, None, None),
        (8, "one two", "fr", "c", 7),
        (9, "One  two", "fr", "c", 8),
        (10, "x" * 70_000, "en", "a", 70_000),
        (11, prose(rng, 12_000), "de", "b", 1),
        (12, "same same same same " * 50, "en", "c", 1),
        (13, "日本語のテキスト 🙂 <|endoftext|> don't\r\n á", "ja", "c", 1),
        (14, "line\nline\n\nother #1 | <b>\nline", "en", "c", 1),
    ]
    for i in range(40):
        rows.append((100 + i, "\n".join([prose(rng, 30), boiler, prose(rng, 40)]), "en", "host", 1))
    return rows


def frame(spark, rows, extra: bool = False):
    """A documents table, with columns whose names operators use inside if ``extra``."""
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    if extra:
        for name in ("row", "rid", "node", "host", "beginning", "words", "tie", "key1", "ids", "label", "name"):
            df = df.selectExpr("*", f"'{name}' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows, extra=False: frame(spark, rows, extra)


@pytest.fixture(scope="session")
def rows():
    return hard_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows, extra=True).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCUMENTS))
