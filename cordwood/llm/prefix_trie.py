"""The trie of conversation prefixes, in node tables behind minimal perfect hashes.

Conversations that begin with the same turns share nodes. Each distinct sequence of the first
d turns is a node of depth d; the root is the empty sequence. For every node the number of
conversations that begin with it, its children, the childless nodes below it and the text
that sharing saves below it are wanted.

1. A turn is 122 bits of the SHA-256 of its role and text. A prefix digest is the sum of
   turn_i * B**i modulo 2**61 - 1, for two bases B. Sums can be taken in parts: turns are sorted
   by conversation and place over ranges, each partition adds up its own, and what a
   conversation has in earlier partitions is added afterwards. So no conversation, however
   long, lies in one task.
2. Equal digests of a depth are one node, counted with partial sums in each task. That all
   rows of a node have the same parent digest is checked, so equal digests are equal prefixes
   as far as the digests of single turns are.
3. A node weighs as many turns as lie on and below it, copies included. Nodes above ``limit``
   are upper nodes; there are at most total / limit of them at any depth. The subtrees
   below them are small and become shards, many in a task. A hot first turn is an upper node,
   and what is below it is many shards.
4. A shard gives its digests slots by a minimal perfect hash, scatters figures into flat arrays,
   finds the slot of each node's parent (digests are compared, so a digest of another shard has
   no slot here), and adds up the arrays through parent slots, deepest nodes first.
5. The tops of the shards hand their sums to the upper nodes, which are folded in the same way,
   in bands of depth of bounded size, deepest first.

The ids of conversations that end at a node are joined into texts of bounded size per task and
hashed one text after the other, so a node where a third of all conversations end is met in
few rows.

Turns are ordered by ``turn`` (null first), equal ones by a digest of role and text, so equal rows
are two turns. A null role or text counts as empty. Rows without a ``conv_id`` belong to no
conversation and are left out. An empty table has no nodes, not even a root. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordwood.llm.ordering import numbered
from cordwood.llm.shared import Scratch

MODULUS = (1 << 61) - 1
#: Subtrees up to this weight, or this part of all turns if that is more, are never divided.
LEAST_LIMIT, PART_LIMIT = 512, 15
#: Nodes that are folded together, about.
SHARD_NODES, BAND_NODES = 1 << 16, 1 << 20
#: So many upper nodes are broadcast; more are joined by shuffle.
BROADCAST_NODES = 500_000
#: Ids that are joined into one text.
IDS_PER_TEXT = 8192

KEY = ["depth", "d1", "d2"]
NODE = "depth long, d1 long, d2 long, p1 long, p2 long, conv_id long, n_convs long, n_bytes long"
FOLDED = "depth long, d1 long, d2 long, p1 long, p2 long, conv_id long, n_convs long, parent_conv_id long, is_top boolean, n_children long, n_leaves long, saved_bytes long"


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, by halves of 31 bits."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a1 * b0 + a0 * b1
    folded = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31))
    return _reduced(np.uint64(2) * a1 * b1 + folded + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(MODULUS)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(MODULUS), x - np.uint64(MODULUS), x)


def _bases() -> np.ndarray:
    return np.random.default_rng(41).integers(1 << 59, MODULUS, size=2, dtype=np.uint64)


def _power(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    found = np.ones(len(exponents), dtype=np.uint64)
    square, left = np.full(1, base, dtype=np.uint64), exponents.astype(np.uint64)
    while left.any():
        found = np.where(left & np.uint64(1), _times(found, square), found)
        square = _times(square, square)
        left = left >> np.uint64(1)
    return found


def _running(terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**61 - 1 from the start of each row's run to the row."""
    halves = []
    for half in (terms & np.uint64((1 << 30) - 1), terms >> np.uint64(30)):
        total = np.cumsum(half, dtype=np.uint64)
        halves.append(total - (total[starts] - half[starts]))
    return _reduced(_times(_reduced(halves[1]), np.full(1, 1 << 30, dtype=np.uint64)) + _reduced(halves[0]))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``tie``, two halves of the digest and the UTF-8 bytes of each turn's text."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = [F.conv(F.substring("tie", at, 15), 16, 10).cast("long").alias(n) for at, n in ((1, "t1"), (17, "t2"))]
    known = conversations.where(F.col("conv_id").isNotNull())
    told = known.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest.alias("tie"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return told.select("conv_id", "turn", "tie", *half, "n_bytes")


def in_order(
    scratch: Scratch, conversations: DataFrame, enrich: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The digests of all turns with ``idx`` (from 0) and ``n`` of their conversation, as a table."""
    digests = scratch.write(turn_digests(conversations), "turns")
    placed, written = numbered(scratch, digests, ["conv_id"], ["turn", "tie"], enrich)
    found = scratch.write(placed.drop("turn", "tie"), "places")
    scratch.drop(digests, written)
    return found


def _prefix_digests(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """Per turn: ``conv_id, depth, n_turns, n_bytes``, the digest of the prefix that it ends
    (``d1, d2``) and of the prefix before it (``p1, p2``)."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.select("conv_id", "depth", "n_turns", "n_bytes", "t1", "t2")
    ordered = turns.repartitionByRange(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = "part int, conv_id long, depth long, n_turns long, n_bytes long, x1 long, x2 long, s1 long, s2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0, 0]
        bases = _bases()
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            depth = batch.column("depth").to_numpy()
            new = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            starts = np.repeat(new, np.diff(np.r_[new, len(conv)]))
            goes_on = (starts == 0) & (conv[0] == last)
            terms, sums = [], []
            for k in (0, 1):
                term = _times(batch.column(f"t{k + 1}").to_numpy().astype(np.uint64), _power(bases[k], depth))
                total = _running(term, starts)
                total = np.where(goes_on, _reduced(total + np.uint64(carried[k])), total)
                terms.append(term)
                sums.append(total)
            last, carried = conv[-1], [s[-1] for s in sums]
            names = ["part", "conv_id", "depth", "n_turns", "n_bytes"]
            figures = [pa.array(a.astype(np.int64)) for a in (*terms, *sums)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *figures], names=[*names, "x1", "x2", "s1", "s2"])

    summed = scratch.write(ordered.mapInArrow(run, schema), "sums")
    # Conversations that go on in another partition: at most one for each partition.
    spans = summed.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    runs = summed.join(F.broadcast(spans.select("conv_id")), "conv_id", "left_semi").groupBy("part", "conv_id")
    runs = runs.agg(F.max_by(F.struct("s1", "s2"), "depth").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wide = [F.sum(F.col(f"s.s{k}").cast("decimal(38,0)")).over(earlier) % MODULUS for k in (1, 2)]
    offsets = runs.select("part", "conv_id", *(F.coalesce(w.cast("long"), F.lit(0)).alias(f"o{k}") for k, w in enumerate(wide, 1)))
    offsets = scratch.write(offsets, "offsets")
    told = summed.join(F.broadcast(offsets), ["part", "conv_id"], "left")
    ends = [((F.col(f"s{k}") + F.coalesce(f"o{k}", F.lit(0))) % MODULUS).alias(f"d{k}") for k in (1, 2)]
    told = told.select("conv_id", "depth", "n_turns", "n_bytes", "x1", "x2", *ends)
    before = [F.pmod(F.col(f"d{k}") - F.col(f"x{k}"), F.lit(MODULUS)).alias(f"p{k}") for k in (1, 2)]
    found = scratch.write(told.select("conv_id", "depth", "n_turns", "n_bytes", "d1", "d2", *before), "prefixes")
    scratch.drop(summed, offsets)
    return found


class SlotTable:
    """A minimal perfect hash of distinct digests.

    At each level a digest that is alone in its bit has found its slot; the others go on to
    the next level, with a hash of another seed. Slots count the single bits, level by level.
    """

    def __init__(self, keys: np.ndarray):
        """``keys``: one row of unsigned 64-bit integers for each digest, all different."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.slots = np.empty(len(keys), dtype=np.int64)
        rest, given = np.arange(len(keys)), 0
        while len(rest):
            size = len(rest) + len(rest) // 2 + 1
            bit = self._bits(keys[rest], size)
            single = np.bincount(bit, minlength=size) == 1
            rank = given + np.cumsum(single) - 1
            self.levels.append((single, rank))
            found = single[bit]
            self.slots[rest[found]] = rank[bit[found]]
            given += int(found.sum())
            rest = rest[~found]
            if len(self.levels) > 200:
                raise ValueError("equal digests have no slots of their own")
        self.keys = np.empty_like(keys)
        self.keys[self.slots] = keys

    def _bits(self, keys: np.ndarray, size: int) -> np.ndarray:
        mixed = np.full(len(keys), len(self.levels) + 1, dtype=np.uint64)
        for column in keys.T:
            mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        return (mixed % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for one that isn't in the table."""
        slots = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        levels, self.levels = self.levels, []
        for single, rank in levels:
            bit = self._bits(keys[rest], len(single))
            found = single[bit]
            slots[rest[found]] = rank[bit[found]]
            rest = rest[~found]
            self.levels.append((single, rank))
        if len(self.keys):
            slots[(self.keys[slots] != keys).any(axis=1)] = -1
        return slots


def _fold_shard(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Sums over the subtrees of the nodes of a shard."""
    own = np.stack([columns[n].astype(np.uint64) for n in ("depth", "d1", "d2")], axis=1)
    above = np.stack([(columns["depth"] - 1).astype(np.uint64), *(columns[n].astype(np.uint64) for n in ("p1", "p2"))], axis=1)
    table = SlotTable(own)
    slots, found = table.slots, table.find(above)

    def scattered(values: np.ndarray) -> np.ndarray:
        flat = np.empty(len(values), dtype=np.int64)
        flat[slots] = values
        return flat

    parent, depth, conv = scattered(found), scattered(columns["depth"]), scattered(columns["conv_id"])
    children = scattered(columns["kids"])
    inside = parent >= 0
    children += np.bincount(parent[inside], minlength=len(parent))
    leaves = scattered(columns["leaves"]) + (children == 0)
    saved = scattered(columns["saved"]) + scattered((columns["n_convs"] - 1) * columns["n_bytes"])
    deepest_first = np.argsort(-depth, kind="stable")
    deepest_first = deepest_first[inside[deepest_first]]
    cuts = np.flatnonzero(np.diff(depth[deepest_first])) + 1
    for level in np.split(deepest_first, cuts):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    names = ["depth", "d1", "d2", "p1", "p2", "conv_id", "n_convs"]
    is_top = found < 0
    parent_conv = pa.array(conv[np.where(is_top, 0, found)], mask=is_top)
    arrays = [*(pa.array(columns[n]) for n in names), parent_conv, pa.array(is_top)]
    arrays += [pa.array(flat[slots]) for flat in (children, leaves, saved)]
    return pa.RecordBatch.from_arrays(
        arrays, names=[*names, "parent_conv_id", "is_top", "n_children", "n_leaves", "saved_bytes"]
    )


_COLUMNS = ("depth", "d1", "d2", "p1", "p2", "conv_id", "n_convs", "n_bytes", "kids", "leaves", "saved")


def _fold(nodes: DataFrame) -> DataFrame:
    """Folds shards that come one after the other, each whole, in partitions sorted by ``shard``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {n: batch.column(n).to_numpy() for n in (*_COLUMNS, "shard")}
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
            shard = held["shard"]
            if len(shard) >= SHARD_NODES and shard[0] != shard[-1]:
                whole = int(np.searchsorted(shard, shard[-1]))
                yield _fold_shard({n: held[n][:whole] for n in _COLUMNS})
                held = {n: held[n][whole:] for n in held}
        if held is not None and len(held["shard"]):
            yield _fold_shard({n: held[n] for n in _COLUMNS})

    return nodes.select(*_COLUMNS, "shard").mapInArrow(run, FOLDED)


def _handed_up(folded: DataFrame) -> DataFrame:
    """What the tops of shards give to their parents."""
    return folded.where("is_top").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
        F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_bytes").alias("saved")
    )


def _ends(scratch: Scratch, prefixes: DataFrame, turnless: DataFrame) -> DataFrame:
    """Per node where conversations end, ``ends_sha256`` of their ids."""
    root = [F.lit(0).cast("long").alias(n) for n in KEY]
    ends = prefixes.where("depth = n_turns").select(*KEY, "conv_id").unionByName(turnless.select(*root, "conv_id"))
    ends = scratch.write(ends, "ends")
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    schema = "depth long, d1 long, d2 long, conv_id long, ids string"

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in KEY], axis=1)
            ids = list(map(str, batch.column("conv_id").to_pylist()))
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) > 1 else np.zeros(0, int)
            starts = np.union1d(np.r_[0, changes], np.arange(0, len(ids), IDS_PER_TEXT)).astype(int)
            texts = [",".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            rows = batch.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "ids"])

    joined = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(join_ids, schema)

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            keys, found = list(zip(*(batch.column(n).to_pylist() for n in KEY), strict=True)), []
            for new, ids in zip(keys, batch.column("ids").to_pylist(), strict=True):
                if new == key:
                    state.update(b",")
                elif key is not None:
                    found.append((*key, state.hexdigest()))
                if new != key:
                    key, state = new, hashlib.sha256()
                state.update(ids.encode())
            yield table_of(found)
        if key is not None:
            yield table_of([(*key, state.hexdigest())])

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, "ends_sha256"])

    texts = joined.repartition(*KEY).sortWithinPartitions(*order)
    return texts.mapInArrow(hash_ids, "depth long, d1 long, d2 long, ends_sha256 string")


def prefix_trie(scratch: Scratch, turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_bytes`` and ``ends_sha256``.

    ``turns`` has ``conv_id``, ``depth`` (from 1), ``n_turns`` and the columns of
    ``turn_digests``; ``turnless`` has the ``conv_id`` of conversations without a turn. The
    node's last turn is turn ``depth`` of conversation ``conv_id``.
    """
    prefixes = _prefix_digests(scratch, turns)
    same = (F.min("p1") == F.max("p1")) & (F.min("p2") == F.max("p2"))
    nodes = prefixes.groupBy(*KEY).agg(
        F.when(same, F.min("p1")).otherwise(F.raise_error(F.lit("two prefixes have one digest"))).alias("p1"),
        F.min("p2").alias("p2"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"),
    )
    nodes = scratch.write(nodes, "nodes")
    limit = max(LEAST_LIMIT, prefixes.count() >> PART_LIMIT)
    known = prefixes.where("depth = 1").select("conv_id").unionByName(turnless.select("conv_id"))
    least, n_convs = known.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    number = F.lit(None).cast("long")

    def column(value: int) -> Column:
        return F.lit(value).cast("long")

    roots = turns.sparkSession.range(1 if n_convs else 0).select(
        column(0).alias("depth"), column(0).alias("d1"), column(0).alias("d2"), column(-1).alias("p1"), column(-1).alias("p2"),
        (number if least is None else column(least)).alias("conv_id"), column(n_convs).alias("n_convs"), column(0).alias("n_bytes"),
    )
    upper = nodes.where(F.col("weight") > limit).drop("weight").unionByName(roots)
    upper = scratch.write(upper, "upper")
    few = upper.count() <= BROADCAST_NODES
    side = F.broadcast(upper) if few else upper

    # All members of a lower node agree in the top of its shard, so one member tells it.
    tops = prefixes.join(side.select(*KEY), KEY, "left_anti").groupBy("conv_id").agg(
        F.min_by(F.xxhash64(*KEY), F.col("depth")).alias("shard")
    )
    nothing = [F.lit(0).cast("long").alias(n) for n in ("kids", "leaves", "saved")]
    lower = nodes.where(F.col("weight") <= limit).join(tops, "conv_id").select(*_COLUMNS[:8], *nothing, "shard")
    folded = scratch.write(_fold(lower.repartition("shard").sortWithinPartitions("shard")), "folded")

    handed = _handed_up(folded)
    depths = upper.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    deeper = F.sum("n").over(Window.orderBy(F.desc("depth"))) - F.col("n")
    bands = scratch.write(depths.select("depth", F.floor(deeper / BAND_NODES).alias("band")), "bands")
    last = bands.agg(F.max("band")).first()[0]
    done = [folded]
    for band in range(-1 if last is None else 0, 0 if last is None else last + 1):
        rows = upper.join(F.broadcast(bands.where(F.col("band") == band)), "depth")
        given = handed.groupBy(*KEY).agg(*(F.sum(n).alias(n) for n in ("kids", "leaves", "saved")))
        rows = rows.join(given, KEY, "left").fillna(0, ["kids", "leaves", "saved"])
        # At most BAND_NODES and the upper nodes of one depth.
        banded = _fold(rows.withColumn("shard", F.lit(0).cast("long")).repartition(1))
        done.append(scratch.write(banded, "band"))
        handed = handed.unionByName(_handed_up(done[-1]))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)

    parents = side.select(F.col("depth").alias("_depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("_parent"))
    on_top = every.where("is_top").withColumn("_depth", F.col("depth") - 1).join(parents, ["_depth", "p1", "p2"], "left")
    on_top = on_top.withColumn("parent_conv_id", F.col("_parent")).select(*every.columns)
    every = every.where("NOT is_top").unionByName(on_top)
    every = every.join(_ends(scratch, prefixes, turnless), KEY, "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes",
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of conversations as they are: ``conv_id, turn, role, text``."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = in_order(scratch, conversations).withColumn("depth", F.col("idx") + 1).withColumnRenamed("n", "n_turns")
    return prefix_trie(scratch, turns, turns.select("conv_id").limit(0))
