"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set are one node. Signatures of nodes are cut into bands;
nodes that agree in a band share a bucket. Pairs of a bucket are compared signature batch
by signature batch: after each batch, a pair is dropped when the posterior probability that
its similarity reaches the threshold, under a uniform prior, is below the chosen miss
probability. Survivors are confirmed on the full shingle sets of both texts.

Only components are asked for, so pairs whose nodes are connected already need no test:

1. each node of a bucket is compared with the bucket's first node; survivors are confirmed,
   the most similar partner of each node first, and connected;
2. buckets that still hold several components are compared completely: their nodes are dealt
   into blocks, and each pair of blocks is compared by signatures inside a task. Of the
   survivors between components a task hands on a spanning forest, the most similar pairs
   first: they are confirmed, and they gather the nodes into families, so that every survivor
   lies within one family;
3. families that still hold several components are compared completely, signatures first
   and then full shingle sets, again by blocks inside tasks. Each task hands on a spanning
   forest of the links that it has confirmed.

So no pair of a bucket is left out and no bucket is capped, while the rows that are passed
on grow with the nodes and not with their pairs. Nothing of this is collected.

Documents without words are linked with nothing; their component is their own ``doc_id``.
A null text counts as empty. A null ``doc_id`` is never the least of a component unless
there is no other. Rows that repeat a ``doc_id`` are nodes by their own texts. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.llm.components import connect, rooted
from cordwood.llm.shared import Scratch, as_bytes, release_memory
from cordwood.llm.shingles import shingle_hashes, shingle_set, signature

#: So many keys of texts to fetch are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Nodes and bytes that are compared as one block, about.
BLOCK, BLOCK_BYTES = 256, 8 << 20


@dataclass(frozen=True)
class Settings:
    """Shingle width in words, threshold in percent, bands of rows, and the probability at
    which a linked pair may be dropped by its signatures."""

    width: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 5
    miss: float = 1e-6
    batch: int = 24

    @property
    def count(self) -> int:
        return self.bands * self.rows


@lru_cache(maxsize=8)
def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """After so many values, the least number of equal ones with which a pair goes on.

    With m of n values equal and a uniform prior, the posterior is Beta(m + 1, n - m + 1);
    the chance that it exceeds t is the chance of at most m successes in n + 1 trials of t.
    """
    t, bounds = settings.percent / 100, []
    for n in [*range(settings.batch, settings.count, settings.batch), settings.count]:
        tail, m = (1 - t) ** (n + 1), 0
        while tail < settings.miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        bounds.append((n, m))
    return bounds


def surviving(left: np.ndarray, right: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signature rows survive all batches, and their equal values."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), dtype=np.int32)
    done = 0
    for n, least in least_matches(settings):
        equal[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1, dtype=np.int32)
        alive = alive[equal[alive] >= least]
        done = n
    return alive, equal[alive]


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, count)


def _identity(docs: DataFrame) -> list[Column]:
    """``doc_id`` and two hashes of the text: the same for rows that repeat both."""
    text = F.col("text").cast("string")
    keys = [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2")]
    return [F.col("doc_id").cast("long").alias("doc_id"), *keys]


def sign(docs: DataFrame, carry: list[str], settings: Settings) -> DataFrame:
    """Per document: ``row``, ``doc_id``, two hashes of the text, and of its shingles the
    number, two hashes of the whole set and the signature (null without shingles)."""
    text = F.col("text").cast("string")
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    narrow = docs.select(*row, *_identity(docs), text.alias("text"))
    schema = T.StructType([f for f in narrow.schema if f.name != "text"])
    for name in ("n_shingles", "set1", "set2"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("signature", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, first, second, signatures = [], [], [], []
            for value in as_bytes(batch.column("text")):
                hashes = shingle_hashes(value, settings.width)
                numbers.append(len(hashes))
                whole = xxhash.xxh3_128_digest(hashes.tobytes())
                first.append(int.from_bytes(whole[:8], "little", signed=True))
                second.append(int.from_bytes(whole[8:], "little", signed=True))
                signatures.append(signature(hashes, settings.count).tobytes() if len(hashes) else None)
            kept = [n for n in batch.schema.names if n != "text"]
            found = [
                pa.array(numbers, pa.int64()),
                pa.array(first, pa.int64()),
                pa.array(second, pa.int64()),
                pa.array(signatures, pa.binary()),
            ]
            names = [*kept, "n_shingles", "set1", "set2", "signature"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *found], names=names)
        release_memory()

    return narrow.mapInArrow(run, schema)


def _with_signatures(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sign_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sign_b"))
    return pairs.join(one, "a").join(two, "b")


def _survivors(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that the posterior bound lets through, with their equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_matrix(batch.column(n), settings.count) for n in ("sign_a", "sign_b"))
            alive, equal = surviving(left, right, settings)
            taken = [batch.column(n).take(pa.array(alive)) for n in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(equal, pa.int32())], names=["a", "b", "equal"])

    return _with_signatures(pairs, nodes).mapInArrow(run, "a long, b long, equal int")


class _Linker:
    """Confirms candidates on full texts and keeps the components so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, settings: Settings, scratch: Scratch):
        self.docs, self.nodes, self.settings, self.scratch = docs, nodes, settings, scratch
        self.roots: DataFrame | None = None

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose nodes are not connected yet."""
        both = rooted(rooted(pairs, self.roots, "a", "_one"), self.roots, "b", "_two")
        return both.where("_one <> _two").drop("_one", "_two")

    def texts(self, used: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ``used``, from one document of each."""
        keys = self.nodes.join(used, "node", "left_semi").select("node", "one.doc_id", "one.key1", "one.key2")
        keys = self.scratch.write(keys, "keys")
        side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        text = F.col("text").cast("string")
        found = self.docs.select(
            F.col("doc_id").cast("long").alias("_doc"),
            F.xxhash64(text).alias("key1"),
            F.xxhash64(F.lit(1), text).alias("key2"),
            text.alias("text"),
        ).join(side, ["key1", "key2"])
        found = found.where(F.col("_doc").eqNullSafe(F.col("doc_id"))).select("node", "text")
        return self.scratch.write(found.dropDuplicates(["node"]), "texts")

    def confirm(self, pairs: DataFrame, texts: DataFrame) -> None:
        """Tests the pairs on full shingle sets and connects those that pass."""
        width, percent = self.settings.width, self.settings.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, set] = {}

            def shingles(node: int, text: bytes) -> set:
                if node not in held:
                    if len(held) >= 16:
                        held.pop(next(iter(held)))
                    held[node] = shingle_set(text, width)
                return held[node]

            for batch in batches:
                linked = []
                columns = [batch.column("a").to_pylist(), batch.column("b").to_pylist()]
                columns += [as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))]
                for a, b, text_a, text_b in zip(*columns, strict=True):
                    one, two = shingles(a, text_a), shingles(b, text_b)
                    common = len(one & two)
                    linked.append(100 * common >= percent * (len(one) + len(two) - common))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).filter(pa.array(linked, pa.bool_())) for n in ("a", "b")], names=["a", "b"]
                )

        one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        linked = pairs.select("a", "b").join(two, "b").join(one, "a").mapInArrow(run, "a long, b long")
        self.roots = connect(self.scratch, self.scratch.write(linked, "links"), self.roots)

    def take(self, survivors: DataFrame) -> None:
        """Confirms survivors: the most similar partner of each node, then all still apart."""
        if survivors.isEmpty():
            return
        texts = self.texts(_nodes_of(survivors))
        best = Window.partitionBy("b").orderBy(F.desc("equal"), "a")
        ranked = self.scratch.write(survivors.withColumn("_n", F.row_number().over(best)), "ranked")
        self.confirm(ranked.where("_n = 1"), texts)
        rest = self.scratch.write(self.apart(ranked.where("_n > 1").drop("_n")), "rest")
        if not rest.isEmpty():
            self.confirm(rest, texts)
        self.scratch.drop(texts, ranked, rest)


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


class _Forest:
    """Which nodes of two blocks are connected; kept as long as the blocks are compared."""

    def __init__(self) -> None:
        self._parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        while (above := self._parent.get(node, node)) != node:
            self._parent[node] = node = self._parent.get(above, above)
        return node

    def join(self, one: int, two: int) -> bool:
        """Whether the two were apart."""
        one, two = self.find(one), self.find(two)
        self._parent[max(one, two)] = min(one, two)
        return one != two


@dataclass
class _Side:
    """The nodes of a block."""

    node: np.ndarray
    root: np.ndarray
    signature: np.ndarray
    text: list[bytes | None] | None

    @classmethod
    def of(cls, block: pa.Scalar, count: int) -> _Side:
        fields = block.values
        names = [field.name for field in fields.type]
        node, root = (fields.field(n).to_numpy() for n in ("node", "root"))
        text = as_bytes(fields.field("text")) if "text" in names else None
        return cls(node, root, _matrix(fields.field("signature"), count), text)


def _cross_survivors(left: _Side, right: _Side, same: bool, settings: Settings) -> Iterator[tuple[int, int, int]]:
    """Places and equal values of the pairs between components that survive, best first."""
    found = []
    for i in range(len(left.node)):
        on = np.flatnonzero(right.root != left.root[i])
        if same:
            on = on[on > i]
        if len(on):
            one = np.broadcast_to(left.signature[i], (len(on), settings.count))
            alive, equal = surviving(one, right.signature[on], settings)
            if len(alive):
                found.append(np.stack([np.full(len(alive), i), on[alive], equal]))
    if found:
        pairs = np.concatenate(found, axis=1)
        yield from pairs[:, np.argsort(-pairs[2], kind="stable")].T.tolist()


def _blocks(members: DataFrame, group: str, carried: list[str], size: Column) -> DataFrame:
    """The pairs of blocks of every group that holds several components.

    ``members`` have ``node`` and ``root``. A group is dealt into blocks of about BLOCK nodes
    and BLOCK_BYTES bytes.
    """
    kinds = members.groupBy(group).agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")
    )
    kinds = kinds.where("low <> high").select(group, F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("parts"))
    dealt = members.join(kinds, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.groupBy(group, "block").agg(
        F.collect_list(F.struct("node", "root", *carried)).alias("nodes"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
    )


def _block_pairs(blocks: DataFrame, group: str) -> DataFrame:
    """``left``, ``right`` and whether they are the same block; blocks of one and the same
    component are left out."""
    one = blocks.select(group, "block", F.col("nodes").alias("left"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    two = blocks.select(group, F.col("block").alias("other"), F.col("nodes").alias("right"), "low", "high")
    pairs = one.join(two, group).where("block <= other AND NOT (low1 = high1 AND low = high AND low1 = low)")
    return pairs.select("left", "right", (F.col("block") == F.col("other")).alias("same"))


def _compare(pairs: DataFrame, settings: Settings, confirm: bool) -> DataFrame:
    """A spanning forest of the survivors of each pair of blocks, or of the links among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("left"), batch.column("right"), batch.column("same").to_pylist()
            for left, right, same in zip(*columns, strict=True):
                sides = [_Side.of(left, settings.count)]
                sides.append(sides[0] if same else _Side.of(right, settings.count))
                yield batch_of(list(joined(*sides, same)))

    def joined(left: _Side, right: _Side, same: bool) -> Iterator[tuple[int, int]]:
        forest = _Forest()
        hashes: dict[tuple[bool, int], np.ndarray] = {}

        def hashed(is_left: bool, i: int) -> np.ndarray:
            key = (is_left or same, i)
            if key not in hashes:
                hashes[key] = shingle_hashes((left if is_left else right).text[i], settings.width)
            return hashes[key]

        def is_link(i: int, j: int) -> bool:
            one, two = hashed(True, i), hashed(False, j)
            if 100 * min(len(one), len(two)) < settings.percent * max(len(one), len(two)):
                return False
            common = len(one) + len(two) - len(np.union1d(one, two))
            if 100 * common < settings.percent * (len(one) + len(two) - common):
                return False
            sets = shingle_set(left.text[i], settings.width), shingle_set(right.text[j], settings.width)
            common = len(sets[0] & sets[1])
            return 100 * common >= settings.percent * (len(sets[0]) + len(sets[1]) - common)

        # Components are connected already; survivors of one family join them further.
        for i, j, _ in _cross_survivors(left, right, same, settings):
            one, two = int(left.root[i]), int(right.root[j])
            if not confirm:
                if forest.join(int(left.node[i]), int(right.node[j])):
                    yield int(left.node[i]), int(right.node[j])
            elif forest.find(one) != forest.find(two) and is_link(i, j):
                forest.join(one, two)
                yield int(left.node[i]), int(right.node[j])

    def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*rows, strict=True) if rows else ((), ())
        arrays = [pa.array([min(p) for p in zip(a, b, strict=True)], pa.int64()), pa.array([max(p) for p in zip(a, b, strict=True)], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _complete(linker: _Linker, banded: DataFrame) -> None:
    """Compares completely what shares a bucket and isn't connected yet."""
    scratch, settings, nodes = linker.scratch, linker.settings, linker.nodes
    signatures = nodes.select("node", "signature")
    members = scratch.write(rooted(banded, linker.roots, "node", "root"), "members")
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = scratch.write(mixed.where("low <> high").select("bucket"), "mixed")
    members = members.join(mixed, "bucket", "left_semi").join(signatures, "node")
    blocks = scratch.write(_blocks(members, "bucket", ["signature"], F.lit(4 * settings.count)), "blocks")
    forest = scratch.write(_compare(_block_pairs(blocks, "bucket"), settings, confirm=False), "forest")
    if forest.isEmpty():
        return
    texts = linker.texts(_nodes_of(forest))
    linker.confirm(forest, texts)
    families = connect(scratch, forest)
    members = rooted(_nodes_of(forest), families, "node", "family")
    members = scratch.write(rooted(members, linker.roots, "node", "root"), "family-members")
    mixed = members.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    members = members.join(mixed.where("low <> high").select("family"), "family", "left_semi")
    members = members.join(signatures, "node").join(texts, "node")
    size = F.octet_length("text") + 4 * settings.count
    blocks = scratch.write(_blocks(members, "family", ["signature", "text"], size), "family-blocks")
    links = scratch.write(_compare(_block_pairs(blocks, "family"), settings, confirm=True), "links")
    linker.roots = connect(scratch, links, linker.roots)


def _labelled(docs: DataFrame, carry: list[str], settings: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What ``sign`` gives of all documents but the signature, with ``rid``, and of each set
    the ``root`` and ``component_id``."""
    signed = scratch.write(sign(docs, carry, settings).withColumn("rid", F.monotonically_increasing_id()), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("set1", "set2").agg(
        F.min("doc_id").alias("least_doc"),
        F.max(F.struct("doc_id", "key1", "key2")).alias("one"),
        F.first("signature").alias("signature"),
    )
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    size = 4 * settings.rows
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(settings.bands - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("signature"), k * size + 1, F.lit(size))),
    )
    banded = nodes.select("node", F.explode(bands).alias("bucket"))
    firsts = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n"))
    firsts = scratch.write(firsts.where("n > 1").select("bucket", "a"), "firsts")
    shared = scratch.write(banded.join(firsts, "bucket").select("bucket", "node", "a"), "shared")
    stars = shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()
    linker = _Linker(docs, nodes, settings, scratch)
    stars = scratch.write(_survivors(stars, nodes, settings), "survivors")
    linker.take(stars)
    scratch.drop(firsts, stars)
    _complete(linker, shared.select("bucket", "node"))

    with_roots = rooted(nodes.select("set1", "set2", "node", "least_doc"), linker.roots, "node", "root")
    least = scratch.write(with_roots.groupBy("root").agg(F.min("least_doc").alias("component_id")), "least")
    labels = with_roots.join(least, "root").select("set1", "set2", "root", "component_id")
    labels = scratch.write(labels.withColumn("linked", F.lit(True)), "labels")
    scratch.keep_only(signed, labels)
    return signed.drop("signature"), labels


def _told(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with the component of their set; ``root`` is null for an empty set."""
    same = (signed["set1"] == labels["set1"]) & (signed["set2"] == labels["set2"]) & (signed["n_shingles"] > 0)
    told = signed.join(labels.select("set1", "set2", "root", "component_id", "linked"), same, "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    held = [signed[c] for c in signed.columns if c not in ("set1", "set2")]
    told = told.select(*held, "root", component.alias("component_id"))
    return told.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, carry: list[str], settings: Settings | None = None) -> DataFrame:
    """One row per document: ``row`` (a struct of the ``carry`` columns), ``doc_id``,
    ``n_shingles``, ``component_id``, ``kept``, and ``stays``, which is true for exactly one
    row of each component, also where rows repeat a ``doc_id``.

    What is carried is written and shuffled: to thin out whole documents use ``thinned``."""
    scratch = Scratch(docs.sparkSession, "near")
    told = _told(*_labelled(docs, carry, settings or Settings(), scratch))
    # Of rows that repeat the kept doc_id in a component one stays.
    chosen = told.where("kept AND root IS NOT NULL").groupBy("root").agg(F.min("rid").alias("_rid"))
    told = told.join(chosen, "root", "left")
    return told.select(
        "row",
        "doc_id",
        "n_shingles",
        "component_id",
        "kept",
        (F.col("root").isNull() | (F.col("rid") == F.col("_rid"))).alias("stays"),
    )


def thinned(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents, whole and in their columns, with one row of each component: the one
    with the least ``doc_id``.

    Only identities go through the search. The documents are read once more and lose the
    rejected ones by an anti join, which is a broadcast as long as those are few. Of rows that
    repeat a ``doc_id`` and its text one is taken; only such rows are shuffled for it.
    """
    scratch = Scratch(docs.sparkSession, "near")
    told = _told(*_labelled(docs, [], settings or Settings(), scratch)).where("root IS NOT NULL")
    identity = ["doc_id", "key1", "key2"]
    told = scratch.write(told.select("root", "kept", F.struct(*identity).alias("one")), "told")
    chosen = told.where("kept").groupBy("root").agg(F.min("one").alias("_chosen"))
    marked = told.join(chosen, "root").withColumn("is_chosen", F.col("one").eqNullSafe(F.col("_chosen")))
    facts = marked.groupBy("one").agg(F.bool_or("is_chosen").alias("stays"), F.count(F.lit(1)).alias("n"))
    facts = scratch.write(facts.where("NOT stays OR n > 1").select("one.*", "stays"), "facts")
    scratch.keep_only(facts)

    def side(rows: DataFrame) -> DataFrame:
        known = rows.select(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_doc"), "key1", "key2")
        known = known.toDF("_null", "_doc", "_key1", "_key2")
        return F.broadcast(known) if rows.count() <= BROADCAST_ROWS else known

    doc, key1, key2 = (c for c in _identity(docs))
    names = ["_null", "_doc", "_key1", "_key2"]
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        doc.isNull().alias("_null"),
        F.coalesce(doc, F.lit(0)).alias("_doc"),
        key1.alias("_key1"),
        key2.alias("_key2"),
    )
    repeated = facts.where("stays")
    kept = whole.join(side(facts), names, "left_anti").select("row.*")
    if repeated.isEmpty():
        return kept
    ones = whole.join(side(repeated), names, "left_semi").groupBy(*names).agg(F.first("row").alias("row"))
    return kept.unionByName(ones.select("row.*"))
