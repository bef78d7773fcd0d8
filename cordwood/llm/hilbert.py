"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised into bins of about equal weight: numbers at approximate
quantiles, texts by their whole values at the quantiles of all rows. The bins are taken as
coordinates, and documents are sorted by their index on the Hilbert curve through them.
Runs of the sorted order are shards, so each shard covers a small box in every dimension,
and a filter on any of them can skip shards by their least and greatest values.

Shards are cut by rows: their counts differ by one at most. Ties on the curve, also where
one bin holds a third of all rows, are ordered by a hash of document and text and split like
any other rows. Ranks come from one range-partitioned sort and a count per partition.

Null values of a dimension come first. A null text has size 1. Rows that repeat are sharded
one by one. An empty table gives an empty result, fewer rows than shards leave shards empty.
In files, ``shard`` and ``slot`` get underscores in front until no carried column has the name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.llm.ordering import partition_of
from cordwood.llm.shared import Scratch, as_bytes


@dataclass(frozen=True)
class Dimension:
    """A named column of texts, in the order of their bytes; nulls come first."""

    name: str
    value: Column

    def key(self) -> Column:
        return self.value.cast("string")


@dataclass(frozen=True)
class NumberDimension(Dimension):
    """A named column of whole numbers; nulls come first."""

    def key(self) -> Column:
        return F.coalesce(self.value.cast("long"), F.lit(-(1 << 62)).cast("long"))


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below 2**bits (one row each).

    Coordinates are turned into the curve's transposed index by undoing the rotations of
    each level from the top, then Gray-decoded and interleaved.
    """
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            set_bit = (x[i] & q) != 0
            swapped = np.where(set_bit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_bit, low, swapped)
            if i:
                x[i] ^= swapped
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _sortable(value: bytes | None) -> bytes:
    """A text that comes after null."""
    return b"" if value is None else b"\1" + value


def text_cuts(keys: DataFrame, name: str, bits: int) -> list[bytes]:
    """Upper edges of the bins of a text column: the values with which the share of all rows
    reaches a further 2**-bits.

    Copies of a value are counted before they are sorted, so a value that holds a third of all
    rows is one row. There are at most 2**bits edges, so only they come to the driver.
    """
    spark, bins = keys.sparkSession, 1 << bits
    scratch = Scratch(spark, "cuts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = scratch.write(keys.groupBy(F.col(name).alias("key")).agg(F.count(F.lit(1)).alias("n")), "values")
    ordered = counts.repartitionByRange(parts, "key").sortWithinPartitions("key")
    ordered = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = partition_of(F.col("at")).alias("part")
    sums = ordered.groupBy(part).agg(F.sum("n").alias("in_part"))
    before = F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")
    sums = sums.select("part", before.alias("before"), F.sum("in_part").over(Window.partitionBy()).alias("total"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("at"))
    told = ordered.withColumn("part", part).withColumn("within", within).join(F.broadcast(sums), "part")
    told = told.withColumn("upto", F.col("before") + F.col("within"))
    edges = told.where(f"upto * {bins} div total > (upto - n) * {bins} div total")
    found = [row["key"] for row in edges.select(F.col("key").cast("binary").alias("key")).collect()]
    scratch.keep_only()
    return sorted(_sortable(None if value is None else bytes(value)) for value in found)


def _number_cuts(keys: DataFrame, names: Sequence[str], bits: int, accuracy: int) -> dict[str, np.ndarray]:
    """Upper edges of the bins of each number column: at most 2**bits values each."""
    if not names:
        return {}
    parts = (1 << bits) - 1
    shares = [float(i) / (parts + 1) for i in range(1, parts + 1)]
    row = keys.agg(*(F.percentile_approx(n, shares, accuracy).alias(n) for n in names)).first()
    return {n: np.unique(np.array(row[n] or [], dtype=np.int64)) for n in names}


def _bins(column: pa.Array, cuts: list[bytes] | np.ndarray) -> np.ndarray:
    """The bin of each value; equal texts of a batch are looked up once."""
    if isinstance(cuts, np.ndarray):
        return np.searchsorted(cuts, column.to_numpy(), side="left")
    coded = pc.dictionary_encode(column, null_encoding="encode")
    places = [bisect_left(cuts, _sortable(value)) for value in as_bytes(coded.dictionary)]
    return np.array(places, dtype=np.int64)[coded.indices.to_numpy()]


def order_on_curve(
    docs: DataFrame, carry: list[str], dimensions: Sequence[Dimension], bits: int = 6, accuracy: int = 2000
) -> DataFrame:
    """Adds ``curve`` (the index) to ``row`` (a struct of the ``carry`` columns) and the
    value of each dimension."""
    names = [f"key{i}" for i in range(len(dimensions))]
    keys = [d.key().alias(n) for d, n in zip(dimensions, names, strict=True)]
    told = docs.select(*keys)
    numbers = [n for d, n in zip(dimensions, names, strict=True) if isinstance(d, NumberDimension)]
    by_name = _number_cuts(told, numbers, bits, accuracy)
    cuts = [by_name[n] if n in by_name else text_cuts(told, n, bits) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [_bins(batch.column(n), c) for n, c in zip(names, cuts, strict=True)]
            index = hilbert_index(np.stack(points, axis=1), bits)
            kept = [n for n in batch.schema.names if n not in names]
            columns = [*(batch.column(n) for n in kept), pa.array(index, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "curve"])

    row = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    values = F.struct(*(d.value.alias(d.name) for d in dimensions)).alias("dimensions")
    tie = F.xxhash64(F.col("doc_id"), F.col("text")).alias("tie")
    narrow = docs.select(row, values, F.col("doc_id").cast("long").alias("doc_id"), tie, *keys)
    schema = T.StructType([f for f in narrow.schema if f.name not in names]).add("curve", T.LongType())
    return narrow.mapInArrow(run, schema)


def shard(docs: DataFrame, carry: list[str], dimensions: Sequence[Dimension], shards: int, bits: int = 6) -> DataFrame:
    """One row per document: ``row``, ``dimensions``, ``curve``, ``shard`` and ``slot``.

    The result is a written table. ``carry`` columns go through the sort: for files of whole
    documents carry all columns, for assignments the ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hilbert")
    # Written first: the curve is computed once, not again for the ranges of the sort.
    placed = scratch.write(order_on_curve(docs, carry, dimensions, bits), "placed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "doc_id", "tie"]
    ranked = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Partition number in the upper bits, place in the partition in the lower 33.
    ranked = scratch.write(ranked.withColumn("at", F.monotonically_increasing_id()), "ordered")
    scratch.drop(placed)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One row for each partition of the sort.
    counts = ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    counts = counts.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + place
    # Of ``total`` rows each shard gets total div shards, and the first ones one more.
    least, more = F.expr(f"total div {shards}"), F.col("total") % shards
    long_part = more * (least + 1)
    in_long = F.col("rank") < long_part
    number = F.when(in_long, F.expr(f"rank div (total div {shards} + 1)")).otherwise(
        more + F.expr(f"(rank - (total % {shards}) * (total div {shards} + 1)) div greatest(total div {shards}, 1)")
    )
    begin = F.col("shard") * least + F.least(F.col("shard"), more)
    return (
        ranked.withColumn("part", part)
        .join(F.broadcast(counts), "part")
        .withColumn("rank", rank)
        .withColumn("shard", number.cast("int"))
        .withColumn("slot", F.col("rank") - begin)
        .select("row", "dimensions", "curve", "shard", "slot")
    )


def _free(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores in front until no column has it."""
    while name in {other.lower() for other in taken}:
        name = f"_{name}"
    return name


def write_shards(sharded: DataFrame, folder: str) -> DataFrame:
    """Files of each shard by ranges of slots, and a manifest with the bounds of every
    dimension, by which readers skip shards.

    Tasks take ranges of (shard, slot), so a shard is written by several of them. ``folder``
    holds ``data`` and ``manifest``; returns the manifest.
    """
    spark = sharded.sparkSession
    names = sharded.schema["dimensions"].dataType.names
    taken = sharded.schema["row"].dataType.names
    shard, slot = _free("shard", taken), _free("slot", taken)
    data = sharded.select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = data.repartitionByRange(parts, shard, slot).sortWithinPartitions(shard, slot)
    ranges.write.partitionBy(shard).parquet(f"{folder}/data")
    bounds = [f(f"dimensions.{n}").alias(f"{k}_{n}") for n in names for k, f in (("least", F.min), ("greatest", F.max))]
    manifest = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *bounds)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")
