"""Jaccard join of n-gram sets by vertical partitioning.

All n-grams have one global order: those that very many documents share come last, the rest by
their hash. The order is cut into fragments, and so is each document's set. Two sets overlap by
the sum of what their segments have in common, counted fragment by fragment, so a long document
is never compared as a whole in one row.

1. Documents with the same set are one node, whichever their number.
2. Two sets with a Jaccard similarity of t share one of the first ``n - ceil(t n) + 1`` n-grams
   of either (n its size). Only those are posted to lists, one for each n-gram; lists of the
   same nodes are one list. Nodes of a list are paired with leaders: first the node that is in most
   lists, then one for those whose sizes rule out a link to the leaders before. That makes one
   pair a node, not all pairs of the list.
3. A pair goes on if the n-grams that both have in each of some hundred ranges of hashes could suffice.
   Its overlap is counted per fragment and summed: first the leader that a node shares most
   lists with, then what is still apart. Links make components.
4. Lists that still hold several components are compared completely, in blocks, by sizes and
   ranges. Each task hands on a spanning forest of the pairs that could be links. It makes
   families, and every link that is still missing lies within a family.
5. Families that hold several components are compared completely, in blocks: the overlaps of
   two blocks are summed over the fragments, as products of incidence matrices, and each task
   hands on a spanning forest of the links it has found.

No pair that could be a link is left out, no list is capped, and the rows passed on grow with
nodes and list entries, not with their pairs. What grows with pairs is the comparing inside
tasks in steps 4 and 5, for n-grams or families shared by many nodes that are not linked.
N-grams are compared by 64-bit hashes.

Documents without words have an empty set and are linked with nothing; their component is their
own ``doc_id``. A null text counts as empty. Fewer words than the width make one n-gram. A null
``doc_id`` is the least of a component only if there is no other. Rows that repeat a ``doc_id`` are
nodes by their own texts. An empty table gives an empty result. Carried columns stay in the
struct ``row``, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.llm.components import connect, rooted
from cordwood.llm.shared import Scratch, as_bytes
from cordwood.llm.shingles import shingle_hashes

#: So many keys of documents are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: At most 2**COMMON n-grams are common: those with more than this part of all entries.
COMMON = 18
#: Entries of the posting lists that a task sorts together, and hashes that it counts together.
POSTED, COUNTED = 1 << 18, 1 << 21
#: Nodes and bytes that are compared as one block, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Pairs that share a copy of their first node's segments.
PAIRS_PER_COPY = 2048
#: Ranges of hashes in which n-grams are counted: so many for sets of up to PER_RANGES, and
#: twice as many for each doubling beyond, up to MOST_RANGES.
RANGES, PER_RANGES, MOST_RANGES = 256, 1024, 1 << 16


@dataclass(frozen=True)
class Settings:
    """Width of an n-gram in words, threshold in percent, fragments of the rare n-grams."""

    width: int = 5
    percent: int = 80
    fragments: int = 4

    def required(self, n: np.ndarray) -> np.ndarray:
        """The least overlap of a set of n with any that it is linked to."""
        return (self.percent * n + 99) // 100

    def is_link(self, common: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (one + two - common)


def _counted(hashes: list[np.ndarray]) -> tuple[bytes, bytes]:
    """The n-grams that are frequent among those of a portion, and how often each occurs."""
    values, n = np.unique(np.concatenate(hashes), return_counts=True)
    often = n > max(1, int(n.sum()) >> COMMON)
    return values[often].tobytes(), n[often].astype(np.int64).tobytes()


def _sign(docs: DataFrame, carry: list[str], width: int) -> DataFrame:
    """Per document: ``row``, ``doc_id``, two hashes of the text, ``n_shingles`` and two hashes of
    the set. Rows with ``shingles`` and ``counts`` hold instead what is frequent in a portion."""
    text = F.col("text").cast("string")
    narrow = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("key1"),
        F.xxhash64(F.lit(1), text).alias("key2"),
        text.alias("text"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in narrow.schema if f.name != "text"])
    for name in ("n_shingles", "set1", "set2"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("shingles", T.BinaryType()).add("counts", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kinds = [], 0, None

        def portion() -> pa.RecordBatch:
            blobs = [pa.array([blob], pa.binary()) for blob in _counted(held)]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, kind) for kind in kinds), *blobs], names=schema.names)

        for batch in batches:
            found = []
            for value in as_bytes(batch.column("text")):
                hashes = shingle_hashes(value, width)
                whole = xxhash.xxh3_128_digest(hashes.tobytes())
                found.append((len(hashes), *np.frombuffer(whole, dtype="<i8").tolist()))
                held.append(hashes)
                size += len(hashes)
            kept = [batch.column(n) for n in batch.schema.names if n != "text"]
            figures = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            columns = [*kept, *figures]
            kinds = [column.type for column in columns]
            nothing = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, nothing, nothing], names=schema.names)
            if size >= COUNTED:
                yield portion()
                held, size = [], 0
        if size:
            yield portion()

    return narrow.mapInArrow(run, schema)


class _Texts:
    """Finds the texts of nodes again, each in one of its documents."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        text = F.col("text").cast("string")
        self.scratch = scratch
        self.docs = docs.select(
            F.col("doc_id").cast("long").alias("_doc"),
            F.xxhash64(text).alias("key1"),
            F.xxhash64(F.lit(1), text).alias("key2"),
            text.alias("text"),
        )

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) for ``nodes`` (node, one); rows that repeat a document give several."""
        keys = nodes.select("node", "one.doc_id", "one.key1", "one.key2")
        side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        found = self.docs.join(side, ["key1", "key2"])
        return found.where(F.col("_doc").eqNullSafe(F.col("doc_id"))).select("node", "text")


def _common(portions: DataFrame, entries: int) -> np.ndarray:
    """Sorted hashes of the n-grams that more than 2**-COMMON of all entries are.

    Such an n-gram is as frequent in at least one of the portions that tasks count, which is
    where it is noticed. The order of n-grams changes no result, only the length of lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = (b"".join(batch.column(n).to_pylist()) for n in ("shingles", "counts"))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b, dtype=np.int64)) for b in blobs], names=["shingle", "n"])

    counted = portions.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # More entries than this for each of them: there can't be more than 2**COMMON.
    rows = counted.where(F.col("n") > max(16, entries >> COMMON)).select("shingle").collect()
    return np.sort(np.array([row[0] for row in rows], dtype=np.int64).view(np.uint64))


def _is_common(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(hashes), dtype=bool)
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes


def _in_order(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """N-grams in the global order, and how many of them are not common."""
    last = _is_common(hashes, common)
    return np.concatenate([hashes[~last], hashes[last]]), int((~last).sum())


def _lists(docs: DataFrame, common: np.ndarray, parts: int, settings: Settings) -> DataFrame:
    """Posting lists: ``shingle``, ``is_common``, ``members`` (first halves of set hashes) and a
    hash of them. Lists of a common n-gram come in parts, the others whole and only if they
    have two members or more."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = {}, 0, 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                hashes = shingle_hashes(text, settings.width)
                if not len(hashes):
                    continue
                node = int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes())[:8], "little", signed=True)
                if node not in held:
                    ordered, rare = _in_order(hashes, common)
                    taken = len(hashes) - int(settings.required(np.int64(len(hashes)))) + 1
                    held[node] = ordered[:taken], min(rare, taken)
                    size += taken
                if size >= POSTED // 4:
                    yield rows(held, number)
                    held, size, number = {}, 0, number + 1
        if held:
            yield rows(held, number)

    def rows(held: dict[int, tuple[np.ndarray, int]], number: int) -> pa.RecordBatch:
        shingles = np.concatenate([h for h, _ in held.values()])
        nodes = np.repeat(np.array(list(held), dtype=np.int64), [len(h) for h, _ in held.values()])
        is_common = np.concatenate([np.arange(len(h)) >= rare for h, rare in held.values()])
        # Rare n-grams are dealt by ranges of hashes; common ones stay in parts of their lists.
        part = ((shingles >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        part = np.where(is_common, -1 - (int(nodes[0]) + number) % parts, part)
        order = np.lexsort((nodes, shingles, part))
        part, shingles, nodes = part[order], shingles[order], nodes[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = [*starts[1:], len(part)]
        blobs = [pa.array([a[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for a in (shingles, nodes)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), *blobs], names=["part", "shingles", "nodes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("part", "shingles", "nodes"))
            for part, shingles, nodes in zip(*columns, strict=True):
                if part != at and held:
                    yield lists(held, at)
                    held = []
                at = part
                held.append((np.frombuffer(shingles, dtype=np.uint64), np.frombuffer(nodes, dtype=np.int64)))
        if held:
            yield lists(held, at)

    def lists(held: list[tuple[np.ndarray, np.ndarray]], part: int) -> pa.RecordBatch:
        shingles, nodes = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((nodes, shingles))
        shingles, nodes = shingles[order], nodes[order]
        fresh = np.r_[True, (shingles[1:] != shingles[:-1]) | (nodes[1:] != nodes[:-1])]
        shingles, nodes = shingles[fresh], nodes[fresh]
        starts = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
        ends = np.r_[starts[1:], len(shingles)]
        kept = np.flatnonzero((ends - starts > 1) | (part < 0))
        members = [nodes[i:j].tobytes() for i, j in zip(starts[kept], ends[kept], strict=True)]
        known = [xxhash.xxh3_64_intdigest(m) for m in members]
        arrays = [
            pa.array(shingles[starts[kept]].view(np.int64)),
            pa.array(np.full(len(kept), part < 0)),
            pa.array(members, pa.binary()),
            pa.array(np.array(known, dtype=np.uint64).view(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["shingle", "is_common", "members", "known"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    dealt = texts.mapInArrow(post, "part long, shingles binary, nodes binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(gather, "shingle long, is_common boolean, members binary, known long")


def _entries(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, node, n, weight): the members of every different list, and how many lists it
    stands for. Lists that share a hash by chance are one longer list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [np.frombuffer(m, dtype=np.int64) for m in batch.column("members").to_pylist()]
            at = np.repeat(np.arange(len(members)), [len(m) for m in members])
            held = [batch.column(n).take(pa.array(at)) for n in ("group", "weight")]
            flat = np.concatenate([*members, np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([*held, pa.array(flat)], names=["group", "weight", "set1"])

    whole = lists.where("NOT is_common").groupBy(F.col("known").alias("group"), "members").agg(F.count(F.lit(1)).alias("weight"))
    parts = lists.where("is_common").select(F.xxhash64("shingle").alias("group"), "members", F.lit(1).cast("long").alias("weight"))
    flat = whole.unionByName(parts).mapInArrow(run, "group long, weight long, set1 long")
    flat = flat.groupBy("group", "set1").agg(F.max("weight").alias("weight"))
    return flat.join(nodes.select("set1", "node", F.col("n_shingles").alias("n")), "set1").drop("set1")


def _led(entries: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``leader`` and ``leader_n`` to the entries of the lists.

    Nodes come in the order of the lists they are in, counted with their weights: the text that
    others were copied from is in more lists than its copies. A node leads those after it whose
    sizes allow a link and that have no earlier leader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The leaders of a list differ in size by the threshold, so they are few.
        group, led = None, []
        for batch in batches:
            leaders, sizes = [], []
            for at, node, n in zip(*(batch.column(c).to_pylist() for c in ("group", "node", "n")), strict=True):
                if at != group:
                    group, led = at, []
                for leader, size in led:
                    if 100 * min(size, n) >= settings.percent * max(size, n):
                        break
                else:
                    leader, size = node, n
                    led.append((node, n))
                leaders.append(leader)
                sizes.append(size)
            columns = [*(batch.column(c) for c in ("group", "node", "n", "weight")), pa.array(leaders, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "node", "n", "weight", "leader", "leader_n"])

    # Ranges: the entries of a long list lie in several partitions, each with leaders of its own.
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degrees = entries.groupBy("node").agg(F.sum("weight").alias("degree"))
    ranked = entries.join(degrees, "node").select("group", "node", "n", "weight", (-F.col("degree")).alias("rank"))
    order = ["group", "rank", "node"]
    placed = ranked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(run, "group long, node long, n long, weight long, leader long, leader_n long")


def _stars(led: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b, n1, n2, weight) of leaders and those they lead, and of leaders that follow
    one another in a list."""
    led_by = led.where("leader <> node").select(
        F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader_n").alias("n1"), F.col("n").alias("n2"), "weight"
    )
    leaders = led.where("leader = node")
    following = Window.partitionBy("group").orderBy("n", "node")
    last = F.lag(F.struct("node", "n")).over(following)
    among = leaders.withColumn("last", last).where("last IS NOT NULL").select(
        F.col("last.node").alias("a"), F.col("node").alias("b"), F.col("last.n").alias("n1"), F.col("n").alias("n2"), "weight"
    )
    among = among.where(100 * F.least("n1", "n2") >= settings.percent * F.greatest("n1", "n2"))
    both = led_by.unionByName(among)
    return both.groupBy("a", "b", "n1", "n2").agg(F.sum("weight").alias("weight"))


def _ranges(texts: DataFrame, settings: Settings) -> DataFrame:
    """Per node: how many n-grams lie in each of its ranges of hashes, in one byte each. A node
    that has more than that in any range has full bytes throughout."""

    def described(hashes: np.ndarray) -> bytes:
        bits = RANGES.bit_length() - 1
        while (PER_RANGES << bits) < len(hashes) * RANGES and (1 << bits) < MOST_RANGES:
            bits += 1
        counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        return (counts if counts.max() < 255 else np.full(1 << bits, 255)).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [described(shingle_hashes(text, settings.width)) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "ranges"])

    return texts.mapInArrow(run, "node long, ranges binary").dropDuplicates(["node"])


def _most_common(one: list[bytes], two: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The largest overlap that the ranges of ``one[i]`` and ``two[j]`` allow, for all pairs.

    Where two nodes have different numbers of ranges, neighbours are joined until they agree.
    """
    sides, widths, places = [], [], []
    for side in (one, two):
        width = np.array([len(ranges) for ranges in side], dtype=np.int64)
        place = np.zeros(len(side), dtype=np.int64)
        tables = {}
        for size in np.unique(width).tolist():
            own = np.flatnonzero(width == size)
            place[own] = np.arange(len(own))
            tables[size] = np.frombuffer(b"".join([side[k] for k in own]), dtype=np.uint8).reshape(-1, size)
        sides.append(tables)
        widths.append(width)
        places.append(place)
    most = np.zeros(len(i), dtype=np.int64)
    for size, left in sides[0].items():
        for size2, right in sides[1].items():
            chosen = np.flatnonzero((widths[0][i] == size) & (widths[1][j] == size2))
            least = min(size, size2)
            step = max(1, (1 << 22) // least)
            for at in range(0, len(chosen), step):
                some = chosen[at : at + step]
                a, b = left[places[0][i[some]]], right[places[1][j[some]]]
                full = (a == 255).all(axis=1) | (b == 255).all(axis=1)
                if size != size2:
                    a, b = (m.reshape(len(some), least, -1).sum(axis=2, dtype=np.uint32) for m in (a, b))
                most[some] = np.where(full, np.int64(1) << 40, np.minimum(a, b).sum(axis=1, dtype=np.int64))
    return most


def _possible_pairs(pairs: DataFrame, ranges: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose ranges allow a link."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("one", "two"))
            n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
            own = np.arange(len(one))
            fits = settings.is_link(np.minimum(_most_common(one, two, own, own), np.minimum(n1, n2)), n1, n2)
            yield batch.select(names).filter(pa.array(fits, pa.bool_()))

    one = ranges.select(F.col("node").alias("a"), F.col("ranges").alias("one"))
    two = ranges.select(F.col("node").alias("b"), F.col("ranges").alias("two"))
    return pairs.join(one, "a").join(two, "b").select(*names, "one", "two").mapInArrow(run, pairs.schema)


def _sets(texts: DataFrame, common: np.ndarray, settings: Settings) -> DataFrame:
    """Per node: its n-grams in the global order, and how many of them are not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_in_order(shingle_hashes(text, settings.width), common) for text in as_bytes(batch.column("text"))]
            arrays = [pa.array([items.tobytes() for items, _ in found], pa.binary()), pa.array([rare for _, rare in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *arrays], names=["node", "items", "rare"])

    return texts.mapInArrow(run, "node long, items binary, rare long").dropDuplicates(["node"])


def _fragments(items: np.ndarray, rare: int, fragments: int) -> Iterator[tuple[int, np.ndarray]]:
    """The segments of a set: rare n-grams cut by their hashes, then common ones likewise."""
    pivots = (np.arange(1, fragments, dtype=np.uint64) << np.uint64(32)) // np.uint64(fragments) << np.uint64(32)
    for number, side in enumerate((items[:rare], items[rare:])):
        for at, segment in enumerate(np.split(side, np.searchsorted(side, pivots))):
            if len(segment):
                yield number * fragments + at, segment


def _overlaps(find: _Texts, pairs: DataFrame, nodes: DataFrame, common: np.ndarray, settings: Settings) -> DataFrame:
    """``common`` of the pairs (a, b, n1, n2) that share an n-gram: partial overlaps of each
    fragment, summed.

    The segments of a leader and of those it is paired with meet in a task per fragment. A
    leader of very many pairs comes in several copies, each for some of them.
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_COPY).alias("copies"))
    dealt = pairs.join(copies, "a")
    second = dealt.select(
        F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy"), "b", "n1", "n2"
    )
    nothing = F.lit(None).cast("long")
    first = copies.select(
        F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
        nothing.alias("b"), nothing.alias("n1"), nothing.alias("n2"),
    )
    roles = find.scratch.write(second.unionByName(first), "roles")
    side = F.broadcast(roles) if roles.count() <= BROADCAST_ROWS else roles
    texts = find.of(nodes.join(roles.select("node").distinct(), "node", "left_semi")).join(side, "node")
    held = ["a", "copy", "b", "n1", "n2"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fragments, segments = [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                items, rare = _in_order(shingle_hashes(text, settings.width), common)
                for at, segment in _fragments(items, rare, settings.fragments):
                    rows.append(i)
                    fragments.append(at)
                    segments.append(segment.tobytes())
            kept = [batch.column(n).take(pa.array(rows, pa.int64())) for n in held]
            found = [pa.array(fragments, pa.int32()), pa.array(segments, pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*held, "fragment", "segment"])

    schema = "a long, copy long, b long, n1 long, n2 long, fragment int, segment binary"
    key = ["a", "copy", "fragment"]
    dealt = texts.select(*held, "text").mapInArrow(cut, schema).repartition(*key)
    # A null comes first: the leader before the others.
    dealt = dealt.sortWithinPartitions(*key, "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = last = (None, None)
        segment = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found = []
            columns = (batch.column(n).to_pylist() for n in (*key, "b", "n1", "n2", "segment"))
            for a, copy, fragment, b, n1, n2, items in zip(*columns, strict=True):
                at = (a, copy, fragment)
                if b is None:
                    leader, segment = at, np.frombuffer(items, dtype=np.uint64)
                elif at == leader and (at, b) != last:
                    partial = len(np.intersect1d(segment, np.frombuffer(items, dtype=np.uint64), assume_unique=True))
                    found.append((a, b, n1, n2, partial))
                last = (at, b)
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n1", "n2", "partial"])

    partial = dealt.mapInArrow(count, "a long, b long, n1 long, n2 long, partial long")
    return partial.groupBy("a", "b", "n1", "n2").agg(F.sum("partial").alias("common"))


class _Forest:
    """Which of a task's nodes are connected."""

    def __init__(self) -> None:
        self._above: dict[int, int] = {}

    def find(self, node: int) -> int:
        path = []
        while node in self._above:
            path.append(node)
            node = self._above[node]
        for passed in path:
            self._above[passed] = node
        return node

    def join(self, one: int, two: int) -> bool:
        """Whether the two were apart."""
        one, two = self.find(one), self.find(two)
        if one != two:
            self._above[max(one, two)] = min(one, two)
        return one != two


def _compared(
    scratch: Scratch, members: DataFrame, group: str, size: Column, run, described: DataFrame, carried: list[str]
) -> DataFrame:
    """(a, b) that ``run`` hands on from the groups of ``members`` (group, node, root and what
    ``size`` needs) that hold several components.

    ``described`` has the ``carried`` columns of the nodes; they are joined last, and moved once
    to the group or block. A group of up to one block is compared in a row. In others, nodes of a
    component that fills a block lie in blocks of their own, so that pairs of blocks of one and
    the same component need no comparing. Block pairs are made from the narrow table of blocks;
    their nodes are joined by group and block, so no key holds more than the pairs of one block.
    """
    weight = F.greatest(F.lit(1) / BLOCK, size / BLOCK_BYTES)
    members = members.withColumn("_w", weight)
    totals = members.groupBy(group).agg(F.sum("_w").alias("_total"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    totals = totals.where("_low <> _high").select(group, "_total")
    mixed = scratch.write(members.join(totals, group).select(group, "node", "root", "_w", "_total"), "mixed")
    described = described.select("node", *carried)
    nodes = F.collect_list(F.struct("node", "root", *carried)).alias("nodes")

    def pairs_of(left: pa.StructScalar, right: pa.StructScalar | None) -> pa.RecordBatch:
        pairs = list(run(left.values, (left if right is None else right).values, right is None))
        columns = list(zip(*pairs, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    def compare_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("nodes"):
                yield pairs_of(block, None)

    def compare_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(batch.column("left"), batch.column("right"), batch.column("same").to_pylist(), strict=True):
                yield pairs_of(left, None if same else right)

    small = mixed.where("_total <= 1").join(described, "node").groupBy(group).agg(nodes)
    found = small.select("nodes").mapInArrow(compare_one, "a long, b long")
    large = mixed.where("_total > 1")
    if not large.isEmpty():
        kinds = large.groupBy(group, "root").agg(F.sum("_w").alias("w")).withColumn("own", F.col("w") >= 0.5)
        rest = kinds.where("NOT own").groupBy(group).agg(F.ceil(F.sum("w")).alias("shared"))
        dealt = large.join(kinds, [group, "root"]).join(rest, group, "left")
        own = F.concat_ws("/", F.col("root"), F.pmod(F.xxhash64("node"), F.ceil("w")))
        block = F.when(F.col("own"), own).otherwise(F.pmod(F.xxhash64("root"), F.col("shared")).cast("string"))
        blocks = dealt.select(group, "node", "root", block.alias("block")).join(described, "node").groupBy(group, "block")
        blocks = scratch.write(blocks.agg(nodes, F.min("root").alias("low"), F.max("root").alias("high")), "blocks")
        names = blocks.select(group, "block", "low", "high")
        others = names.select(group, F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = names.join(others, group).where("block <= other AND (low <> high OR low2 <> high2 OR low <> low2)")
        left = blocks.select(group, "block", F.col("nodes").alias("left"))
        right = blocks.select(group, F.col("block").alias("other"), F.col("nodes").alias("right"))
        both = pairs.select(group, "block", "other").join(left, [group, "block"]).join(right, [group, "other"])
        both = both.select("left", "right", (F.col("block") == F.col("other")).alias("same"))
        found = found.unionByName(both.mapInArrow(compare_two, "a long, b long"))
    return scratch.write(found.distinct(), "forest")


def _numbers(side: pa.StructArray, name: str) -> np.ndarray:
    return side.field(name).to_numpy(zero_copy_only=False)


def _possible(settings: Settings):
    """Compares blocks by sizes and ranges: which nodes could be linked."""

    def run(left: pa.StructArray, right: pa.StructArray, same: bool) -> Iterator[tuple[int, int]]:
        forest = _Forest()
        (node, root, n), (node2, root2, n2) = ([_numbers(side, c) for c in ("node", "root", "n")] for side in (left, right))
        ranges, ranges2 = (side.field("ranges").to_pylist() for side in (left, right))
        sizes = 100 * np.minimum(n[:, None], n2) >= settings.percent * np.maximum(n[:, None], n2)
        apart = sizes & (root[:, None] != root2)
        one, two = np.nonzero(np.triu(apart, 1) if same else apart)
        most = np.minimum(_most_common(ranges, ranges2, one, two), np.minimum(n[one], n2[two]))
        fits = settings.is_link(most, n[one], n2[two])
        for a, b in zip(node[one[fits]].tolist(), node2[two[fits]].tolist(), strict=True):
            if forest.join(a, b):
                yield min(a, b), max(a, b)

    return run


def _linked(settings: Settings):
    """Compares blocks completely: overlaps summed over the fragments."""

    def run(left: pa.StructArray, right: pa.StructArray, same: bool) -> Iterator[tuple[int, int]]:
        sides = []
        for side in (left, right):
            held: dict[int, list[tuple[int, np.ndarray]]] = {}
            rares = _numbers(side, "rare")
            for i, items in enumerate(side.field("items").to_pylist()):
                for at, segment in _fragments(np.frombuffer(items, dtype=np.uint64), int(rares[i]), settings.fragments):
                    held.setdefault(at, []).append((i, segment))
            sides.append(held)
        common = np.zeros((len(left), len(right)), dtype=np.int64)
        for fragment in sides[0].keys() & sides[1].keys():
            rows = [np.concatenate([np.full(len(s), i) for i, s in held[fragment]]) for held in sides]
            values = [np.concatenate([s for _, s in held[fragment]]) for held in sides]
            shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
            for at in range(0, len(shared), 4096):
                some = shared[at : at + 4096]
                matrices = []
                for row, value, size in zip(rows, values, common.shape, strict=True):
                    place = np.minimum(np.searchsorted(some, value), len(some) - 1)
                    hit = some[place] == value
                    matrix = np.zeros((size, len(some)), dtype=np.float32)
                    matrix[row[hit], place[hit]] = 1
                    matrices.append(matrix)
                common += (matrices[0] @ matrices[1].T).astype(np.int64)
        n, n2 = _numbers(left, "n"), _numbers(right, "n")
        root, root2 = _numbers(left, "root"), _numbers(right, "root")
        node, node2 = _numbers(left, "node"), _numbers(right, "node")
        hits = settings.is_link(common, n[:, None], n2[None, :]) & (root[:, None] != root2[None, :])
        # Components are connected already; links join them further.
        forest = _Forest()
        for i, j in np.argwhere(hits).tolist():
            if (not same or j > i) and forest.join(int(root[i]), int(root2[j])):
                yield min(int(node[i]), int(node2[j])), max(int(node[i]), int(node2[j]))

    return run


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _components(
    docs: DataFrame, portions: DataFrame, nodes: DataFrame, settings: Settings, scratch: Scratch
) -> DataFrame | None:
    """(node, root) of the nodes that are linked to a smaller one."""
    find = _Texts(docs, scratch)
    entries = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    common = _common(portions, entries)
    parts = max(1, entries * (101 - settings.percent) // 100 // POSTED)
    lists = scratch.write(_lists(docs, common, parts, settings), "lists")
    members = scratch.write(_entries(lists, nodes), "entries")
    scratch.drop(lists)
    led = scratch.write(_led(members, settings), "led")
    # Nodes of lists, and of no others, can be linked.
    used = nodes.join(members.select("node").distinct(), "node", "left_semi")
    ranges = scratch.write(_ranges(find.of(used), settings), "ranges")
    stars = scratch.write(_possible_pairs(_stars(led, settings), ranges, settings), "stars")
    scratch.drop(led)

    def linked(pairs: DataFrame, roots: DataFrame | None) -> DataFrame | None:
        counted = _overlaps(find, pairs.select("a", "b", "n1", "n2"), nodes, common, settings)
        links = counted.where(100 * F.col("common") >= settings.percent * (F.col("n1") + F.col("n2") - F.col("common")))
        return connect(scratch, scratch.write(links.select("a", "b"), "links"), roots)

    best = Window.partitionBy("b").orderBy(F.desc("weight"), "a")
    ranked = scratch.write(stars.withColumn("_n", F.row_number().over(best)), "ranked")
    roots = linked(ranked.where("_n = 1"), None)
    apart = rooted(rooted(ranked.where("_n > 1"), roots, "a", "_one"), roots, "b", "_two").where("_one <> _two")
    apart = scratch.write(apart.select(*stars.columns), "apart")
    if not apart.isEmpty():
        roots = linked(apart, roots)
    scratch.drop(stars, ranked, apart)

    # A list of two nodes has been compared completely.
    long = members.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 2").select("group")
    members = rooted(members.join(long, "group", "left_semi").select("group", "node", "n"), roots, "node", "root")
    sizes = nodes.select("node", F.col("n_shingles").alias("n"))
    described = ranges.join(sizes, "node")
    size = F.greatest(F.lit(RANGES), "n") + 24
    forest = _compared(scratch, members, "group", size, _possible(settings), described, ["n", "ranges"])
    if forest.isEmpty():
        return roots
    families = connect(scratch, forest)
    members = rooted(rooted(_nodes_of(forest), families, "node", "family"), roots, "node", "root")
    members = scratch.write(members.join(sizes, "node"), "family-members")
    kinds = members.groupBy("family").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
    mixed = members.join(kinds.where("_low <> _high").select("family"), "family", "left_semi").select("node")
    sets = scratch.write(_sets(find.of(nodes.join(mixed, "node", "left_semi")), common, settings), "sets")
    found = _compared(
        scratch, members, "family", 8 * F.col("n"), _linked(settings), sets.join(sizes, "node"), ["n", "items", "rare"]
    )
    return connect(scratch, found, roots)


def jaccard_components(docs: DataFrame, carry: list[str], settings: Settings | None = None) -> DataFrame:
    """One row per document: ``row`` (a struct of the ``carry`` columns), ``doc_id``,
    ``n_shingles`` and ``component_id``, the least ``doc_id`` reachable by links."""
    settings = settings or Settings()
    scratch = Scratch(docs.sparkSession, "ngram")
    every = scratch.write(_sign(docs, carry, settings.width), "signed")
    signed = every.where("shingles IS NULL").drop("shingles", "counts")
    portions = every.where("shingles IS NOT NULL").select("shingles", "counts")
    nodes = signed.where("n_shingles > 0").groupBy("set1", "set2").agg(
        F.min("doc_id").alias("least_doc"),
        F.max(F.struct("doc_id", "key1", "key2")).alias("one"),
        F.first("n_shingles").alias("n_shingles"),
    )
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = _components(docs, portions, nodes, settings, scratch)
    told = rooted(nodes.select("set1", "set2", "node", "least_doc"), roots, "node", "root")
    least = told.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    labels = scratch.write(told.join(least, "root").select("set1", "set2", "component_id"), "labels")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = signed.join(labels, ["set1", "set2"], "left")
    return found.select("row", "doc_id", "n_shingles", component.alias("component_id"))
