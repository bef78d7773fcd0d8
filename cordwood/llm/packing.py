"""Best-fit packing by patterns: non-negative least squares over the length histogram.

Lengths are at most the capacity of a sequence, so the histogram has at most that many
bars, however large the corpus. All patterns of one to three lengths that fill a sequence
exactly are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, and rounded. What the rounded patterns leave over is packed best-fit, the
longest first, again on counts. The plan lists patterns with repeat counts, never rows.

Each piece then finds its place by its length and its number among the pieces of that
length. Tasks count their own pieces by length as they tokenize; a small table of counts
by task and length turns those into numbers over all. No length is gathered in one task.

Nulls and empty texts are documents of no ids but the end id. A null ``doc_id`` is packed
as any other and stays null. Repeated rows are documents of their own. An empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordwood.llm.shared import Scratch, as_bytes, slices
from cordwood.llm.wordpieces import encoder

PIECES = (
    "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, "
    "task int, number long"
)
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_into_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool
) -> DataFrame:
    """Every document's ids and an end id, cut where longer than a sequence.

    ``number`` counts the pieces of the same length before it in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            ids_of = encoder(tokenizer).encode(as_bytes(batch.column(1)))
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    kept = own if keep_ids else None
                    rows.append((doc_id, piece, at // 4, length, kept, zlib.crc32(own), task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "number"]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES)


def full_patterns(histogram: np.ndarray, most: int = 3) -> np.ndarray:
    """All multisets of one to ``most`` (at most three) present lengths that fill a sequence.

    Rows of three lengths; 0 stands for no length.
    """
    capacity = len(histogram) - 1
    present = np.flatnonzero(histogram[1:]) + 1
    there = histogram > 0
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    if most >= 2:
        low = present[present * 2 <= capacity]
        low = low[there[capacity - low]]
        found.append(np.stack([capacity - low, low, 0 * low], axis=1))
    if most >= 3:
        for small in present[present * 3 <= capacity]:
            middle = present[(present >= small) & (present <= (capacity - small) // 2)]
            middle = middle[there[capacity - small - middle]]
            found.append(np.stack([capacity - small - middle, middle, 0 * middle + small], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=int)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of their lengths to the histogram.

    Multiplicative steps keep x non-negative and never raise the distance.
    """
    if not len(patterns):
        return np.zeros(0)
    bars = len(histogram)
    target = histogram.astype(float)
    target[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(patterns[:, k], x, bars) for k in range(3))
        total[0] = 0
        return total

    def back(y: np.ndarray) -> np.ndarray:
        return y[patterns[:, 0]] + y[patterns[:, 1]] + y[patterns[:, 2]]

    x = np.full(len(patterns), max(target.sum() / len(patterns) / 3, 1e-9))
    aim = back(target)
    for _ in range(steps):
        x *= aim / np.maximum(back(used(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Runs of equal sequences: for each length, which sequences hold which numbers of it.

    ``keys`` are length * 2**40 + first number, in order; piece number n of a run lies in
    sequence ``base + (n - first)`` at ``offset``.
    """

    keys: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def _best_fit(left: np.ndarray) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: sequences as (lengths, how many)."""
    capacity = len(left) - 1
    open_by_room: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        count = int(left[length])
        room = length
        while count:
            while room <= capacity and not open_by_room[room]:
                room += 1
            # No open sequence has room: start new ones.
            held, many = open_by_room[room].pop() if room <= capacity else ([], count)
            free = room if held else capacity
            each = free // length
            whole = min(many, count // each)
            if whole:
                open_by_room[free - each * length].append((held + [length] * each, whole))
                count -= whole * each
                many -= whole
            if many and held and not count:
                open_by_room[room].append((held, many))
            elif many and 0 < count < each:
                open_by_room[free - count * length].append((held + [length] * count, 1))
                if held and many > 1:
                    open_by_room[room].append((held, many - 1))
                count = 0
    return [one for room in open_by_room for one in room]


def make_plan(histogram: np.ndarray) -> Plan:
    """Sequences for all pieces that the histogram counts."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    patterns = full_patterns(left)
    counts = fit_counts(patterns, left)
    sequences: list[tuple[list[int], int]] = []
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 0.5:
            break
        lengths = [int(n) for n in patterns[i] if n]
        most = min(int(left[n]) // lengths.count(n) for n in lengths)
        times = min(int(counts[i] + 0.5), most)
        if times:
            sequences.append((lengths, times))
            for n in lengths:
                left[n] -= times
    sequences += _best_fit(left)
    runs, total = [], 0
    taken = np.zeros(len(histogram), dtype=np.int64)
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            runs.append(((n << 40) + int(taken[n]), total, offset))
            taken[n] += times
            offset += n
        total += times
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 3)
    return Plan(columns[:, 0], columns[:, 1], columns[:, 2], total)


def pack(pieces: DataFrame, capacity: int, small_rows: int = 500_000) -> tuple[DataFrame, Plan]:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length``, ``task`` and ``number``.

    The pieces must be a written table: they are read twice. The counts by task and length
    are broadcast up to ``small_rows`` rows and joined by shuffle beyond.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("task")) - F.col("_n")
    counts = counts.select("task", "length", "_n", before.alias("_before")).persist()
    try:
        # At most as many rows as a sequence has tokens.
        bars = counts.groupBy("length").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        histogram = np.zeros(capacity + 1, dtype=np.int64)
        for bar in bars:
            histogram[bar["length"]] = bar["n"]
        plan = make_plan(histogram)
        # The plan is as large as the patterns, whatever the corpus.
        sent = spark.sparkContext.broadcast((plan.keys, plan.base, plan.offset))
        small = sum(bar["rows"] for bar in bars) <= small_rows
    finally:
        counts.unpersist()
    side = counts.drop("_n")
    joined = pieces.join(F.broadcast(side) if small else side, ["task", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset = sent.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length.astype(np.int64) << 40) + batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            found = [pa.array(base[at] + key - keys[at]), pa.array(offset[at])]
            kept = [n for n in batch.schema.names if n != "_rank"]
            columns = [batch.column(n) for n in kept] + found
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("task", "number")]
    ranked = joined.select(*kept, (F.col("number") + F.col("_before")).alias("_rank"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"])), plan


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with the sequence and the place of each.

    With ``keep_ids`` the ids come too (little-endian unsigned 32-bit integers).
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(cut_into_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    packed, _ = pack(pieces, capacity)
    packed = packed.withColumn("length", F.col("length").cast("long"))
    return packed if keep_ids else packed.drop("ids")
