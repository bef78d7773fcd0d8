"""Language by compression: the dictionary that makes a text smallest names its language.

For each language a raw-content dictionary is filled with excerpts of labelled texts. A text
is put in lower case and cut into chunks, every chunk is compressed with each language's dictionary, and the
sizes are added up. The smallest total wins; a narrow lead over the second is a rejection.

The model is fitted on a bounded sample: of each language the ``documents`` texts with the
least hashes, ``excerpt`` bytes of each. A language whose excerpts don't fill a dictionary is
read once more, with longer excerpts, or whole texts of more documents, until it is full or
has no more text. No language is cut to the size of another, and totals aren't corrected for
length: on held-out texts a foreign dictionary gained next to nothing by its length. The size
of the model is bounded by the number of languages. Prediction reads the text alone and covers all of it.

A null text and a text without a letter are ``und`` with score 0 and are rejected. With no
labelled text at all, everything is ``und``. Equal totals go to the language first in
order, with a score of one half at most.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.llm.shared import as_bytes, held, slices

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and what counts as a narrow lead.

    ``lead`` is the least share by which the second total must exceed the first.
    """

    documents: int = 150
    excerpt: int = 256
    dictionary: int = 1 << 15
    chunk: int = 1024
    level: int = 6
    lead: float = 0.005


Model = tuple[tuple[str, bytes], ...]


def _lower(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def _excerpt(text: bytes, key: int, size: int) -> bytes:
    """A piece of a text, at a place that depends on its hash."""
    return text if len(text) <= size else text[(at := key % (len(text) - size + 1)) : at + size]


def _sample(told: DataFrame, most: int, size: dict[str, int], excerpt: int, enough: int = 0) -> list[Row]:
    """Of each language the distinct texts with the least hashes, as excerpts: ``most`` of them
    at most, and in each task no more than fill ``enough`` bytes if that isn't 0. ``size`` is the
    length of excerpts by language, ``excerpt`` that of others. Rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The least hashes of each language in this task; copies of a text count once.
        held: dict[str, tuple[list[tuple[int, bytes, int]], set[int]]] = {}
        filled: dict[str, int] = {}
        for batch in batches:
            keys, langs = batch.column("key").to_pylist(), batch.column("lang").to_pylist()
            for key, lang, text in zip(keys, langs, as_bytes(batch.column("text")), strict=True):
                heap, known = held.setdefault(lang, ([], set()))
                full = len(heap) >= most or (enough and filled.get(lang, 0) >= enough)
                if key in known or (full and -key <= heap[0][0]):
                    continue
                piece = _lower(_excerpt(text, key, size.get(lang, excerpt)))
                heapq.heappush(heap, (-key, piece, len(text)))
                known.add(key)
                filled[lang] = filled.get(lang, 0) + len(piece) + 1
                while len(heap) > most or (enough and filled[lang] - len(heap[0][1]) - 1 >= enough):
                    gone = heapq.heappop(heap)
                    known.discard(-gone[0])
                    filled[lang] -= len(gone[1]) + 1
        rows = [(lang, -key, piece, length) for lang, (heap, _) in held.items() for key, piece, length in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = (pa.string(), pa.int64(), pa.binary(), pa.int64())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "key", "piece", "length"])

    found = told.mapInArrow(run, "lang string, key long, piece binary, length long").distinct()
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "piece")))
    return ranked.where(F.col("n") <= most).orderBy("lang", "key", "piece").collect()


def _longest(lengths: list[int], wanted: int) -> int:
    """The least limit of excerpts with which texts of these lengths fill ``wanted`` bytes;
    ``wanted`` itself if they can't."""
    low, high = 1, wanted
    while low < high:
        middle = (low + high) // 2
        if sum(min(n, middle) + 1 for n in lengths) > wanted:
            high = middle
        else:
            low = middle + 1
    return low


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """The dictionaries of all languages in ``labelled`` (``text``, ``lang``)."""
    keep, wanted = settings.documents, settings.dictionary
    text = F.col("text").cast("string")
    told = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    told = told.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("key"), text.alias("text"))
    told = told.where("text <> ''")
    pieces: dict[str, list[bytes]] = {}
    lengths: dict[str, list[int]] = {}
    for row in _sample(told, keep, {}, settings.excerpt):
        pieces.setdefault(row["lang"], []).append(bytes(row["piece"]))
        lengths.setdefault(row["lang"], []).append(row["length"])
    # Languages that aren't full and have more text than was taken.
    short = {
        lang: own
        for lang, own in lengths.items()
        if sum(len(piece) + 1 for piece in pieces[lang]) <= wanted and (len(own) >= keep or max(own) > settings.excerpt)
    }
    if short:
        size = {lang: _longest(own, wanted) for lang, own in short.items()}
        # An excerpt takes two bytes at least, with its end of line.
        again = _sample(told.where(F.col("lang").isin(*short)), wanted // 2 + 1, size, settings.excerpt, wanted)
        pieces |= {lang: [] for lang in short}
        for row in again:
            pieces[row["lang"]].append(bytes(row["piece"]))
    joined = {lang: b"\n".join(own)[:wanted] for lang, own in pieces.items()}
    return tuple((lang, own) for lang, own in sorted(joined.items()) if len(own) >= 8)


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=level)
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, **plain)


def _compressors(model: Model, level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """The worker's compressors for a model."""
    return held(("compressors", model, level), lambda: [(lang, _compressor(content, level)) for lang, content in model])


def classify(text: bytes | None, model: Model, settings: Settings) -> tuple[str, float, bool]:
    """Language, score and whether the lead is wide enough."""
    lower = text.decode("utf-8", "replace").lower() if text and model else ""
    if not LETTER.search(lower):
        return UNKNOWN, 0.0, False
    text = lower.encode()
    chunks = [text[at : at + settings.chunk] for at in range(0, len(text), settings.chunk)]
    totals = sorted(
        (sum(len(compressor.compress(chunk)) for chunk in chunks), lang)
        for lang, compressor in _compressors(model, settings.level)
    )
    best = totals[0][0]
    # As likely as their code lengths say, one bit for each byte.
    score = 1 / sum(2.0 ** -min(total - best, 1000) for total, _ in totals)
    accepted = len(totals) == 1 or totals[1][0] - best > settings.lead * totals[1][0]
    return totals[0][1], score, accepted


def identify(docs: DataFrame, carry: list[str], model: Model, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row per document: ``row`` (a struct of the ``carry`` columns), ``lang_pred``,
    ``score`` and ``accepted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [classify(text, sent.value, settings) for text in as_bytes(batch.column("text"))]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            types = (pa.string(), pa.float64(), pa.bool_())
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            names = ["row", "lang_pred", "score", "accepted"]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=names)

    narrow = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text")
    )
    schema = T.StructType([narrow.schema["row"]])
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("accepted", T.BooleanType())
    return narrow.mapInArrow(run, schema)
