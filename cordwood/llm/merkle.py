"""Merkle manifest of a dataset: one digest for each group, one for all, and proofs.

Rows are leaves, in order within their group. While a group has several nodes, each run of
``arity`` consecutive ones (the last may be shorter, even a single one) becomes their digest.
What remains is the group's subroot; the subroots, in the order of their groups (null first),
give the root in the same way.

A level is one table of narrow nodes (group number, index, 32 bytes). Each node finds its
siblings by equijoins on computed indices: the index with its last bit flipped in a binary
tree, otherwise the slots of its run one after the other; what is missing there has no
sibling. Rows in slot 0, which then hold the whole run, emit the parents. Levels shrink by the
arity, so all of them together cost about as much as the first. Texts are read once, to make
the leaves.

A proof is the path from a leaf to the root: at each level the digests left and right of the
node. Paths go down the tree, from parents to their children, so they too are shuffled
``1 / (arity - 1)`` times a leaf and not once a level. ``fold`` computes the root from a leaf
and its path.

Nulls: a field that is null counts as ``-``; a null group is a group of its own, before all
others; rows with a null order column come first. Rows that agree in the order columns are
ordered by their leaf, and equal rows are leaves each. An empty table gives an empty result.
Columns of any name may be carried: they stay in the struct ``row``. No group lies in one
task: indices come from a sort over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.llm.ordering import numbered
from cordwood.llm.shared import Scratch

#: The steps of a proof, from the leaf to the root.
PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A field for a leaf: UTF-8 bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The 32 bytes that stand for a row."""
    return F.unhex(F.sha2(F.concat(*(field(f) for f in fields)), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def run_digest(nodes: Column) -> Column:
    """The digest of the nodes of a run, given one after the other."""
    return F.unhex(F.sha2(hex_text(nodes), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: run_digest(F.concat(step["left"], node, step["right"])))


def proof_text(path: Column) -> Column:
    """All digests of a path, level by level and left to right, as text."""
    steps = F.transform(path, lambda step: hex_text(F.concat(step["left"], step["right"])))
    return F.array_join(steps, "")


def _sibling(index: Column, shift: int, arity: int) -> Column:
    if arity == 2:
        return index.bitwiseXOR(F.lit(1))
    slot = index % arity
    return index - slot + (slot + shift) % arity


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``left`` and ``right``: the digests of the run before and after each node."""
    shifts = range(1, arity)
    found = nodes
    for shift in shifts:
        other = nodes.select(F.col("gid"), F.col("idx").alias("_at"), F.col("digest").alias(f"_digest{shift}"))
        found = found.withColumn("_at", _sibling(F.col("idx"), shift, arity)).join(other, ["gid", "_at"], "left")
    slot, none = F.col("idx") % arity, F.lit(b"")

    def side(is_left: bool) -> Column:
        # A shift past the end of the run comes out at its beginning.
        wraps = [(F.col(f"_digest{s}"), slot + s >= arity) for s in shifts]
        return F.concat(*(F.coalesce(F.when(w if is_left else ~w, d), none) for d, w in wraps))

    kept = found.withColumn("left", side(True)).withColumn("right", side(False))
    return kept.drop("_at", *(f"_digest{s}" for s in shifts))


class _Tree:
    """The levels of the trees of all groups, from leaves to the single nodes on top."""

    def __init__(self, scratch: Scratch, leaves: DataFrame, deepest: int, arity: int):
        """``leaves``: gid, idx, n, digest and what they carry; ``deepest`` is the largest n."""
        self.scratch, self.arity = scratch, arity
        self.levels = []
        level = leaves
        while deepest > 1:
            rows = scratch.write(_with_siblings(level.where("n > 1"), arity), "level")
            self.levels.append((level, rows))
            level = rows.where(F.col("idx") % arity == 0).select(
                "gid",
                F.expr(f"idx div {arity}").alias("idx"),
                F.ceil(F.col("n") / arity).alias("n"),
                run_digest(F.concat("digest", "right")).alias("digest"),
            )
            deepest = -(-deepest // arity)
        self.last = level

    def tops(self) -> DataFrame:
        """(gid, digest) of the node that remains of each group."""
        tables = [level for level, _ in self.levels] + [self.last]
        tops = [t.where("n = 1").select("gid", "digest") for t in tables]
        found = tops[0]
        for more in tops[1:]:
            found = found.unionByName(more)
        return found

    def paths(self, above: DataFrame, carried: Sequence[str], passed: Sequence[str]) -> DataFrame:
        """Leaves with ``idx``, ``digest``, ``path``, what they carry and what is passed down.

        ``above`` (gid, path and the passed columns) goes on from the top of each group.
        """
        held = ["digest", *carried]

        def on_top(level: DataFrame, columns: Sequence[str]) -> DataFrame:
            return level.where("n = 1").join(above, "gid").select("gid", "idx", "path", *passed, *columns)

        paths = on_top(self.last, [] if self.levels else held)
        step = F.array(F.struct("left", "right"))
        for number, (level, rows) in reversed(list(enumerate(self.levels))):
            columns = [] if number else held
            up = paths.select("gid", F.col("idx").alias("_up"), F.col("path").alias("_path"), *passed)
            inner = rows.withColumn("_up", F.expr(f"idx div {self.arity}")).join(up, ["gid", "_up"])
            inner = inner.select("gid", "idx", F.concat(step, "_path").alias("path"), *passed, *columns)
            paths = inner.unionByName(on_top(level, columns))
            if number:
                paths = self.scratch.write(paths, "paths")
        return paths


def manifest(
    docs: DataFrame,
    carry: list[str],
    leaf: Column,
    group: str,
    order: Sequence[str],
    arity: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of the ``carry`` columns), ``leaf``,
    ``subroot``, ``root`` (32 bytes each) and ``path``."""
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    scratch = Scratch(docs.sparkSession, "merkle")
    name = F.col(f"`{group}`").cast("string")
    keys = [f"_order{i}" for i in range(len(order))]
    narrow = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        # False sorts first: the null group.
        name.isNotNull().alias("named"),
        F.coalesce(name, F.lit("")).alias("name"),
        leaf.alias("digest"),
        *(F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)),
    )
    # Written first: texts are digested once, not again for the ranges of the sort.
    narrow = scratch.write(narrow, "rows")
    groups: list[DataFrame] = []

    def with_group_number(runs: DataFrame) -> DataFrame:
        sizes = scratch.write(runs.groupBy("named", "name").agg(F.max("n").alias("n")), "groups")
        ranked, _ = numbered(scratch, sizes.select(F.lit(0).alias("_all"), "named", "name"), ["_all"], ["named", "name"])
        groups.append(sizes)
        return runs.join(ranked.select("named", "name", F.col("idx").alias("gid")), ["named", "name"])

    placed, written = numbered(scratch, narrow, ["named", "name"], [*keys, "digest"], with_group_number)
    leaves = scratch.write(placed.select("row", "gid", "idx", "n", "digest"), "leaves")
    scratch.drop(narrow, written)
    deepest, n_groups = groups[0].agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()

    tree = _Tree(scratch, leaves, deepest, arity)
    subroots = scratch.write(tree.tops(), "subroots")
    upper = subroots.select(
        F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "digest"
    )
    upper = _Tree(scratch, upper, n_groups, arity)
    top = upper.tops().select("gid", F.col("digest").alias("root"), F.expr(f"cast(array() AS {PATH})").alias("path"))
    above = upper.paths(top, [], ["root"])
    above = above.select(F.col("idx").alias("gid"), "path", F.col("digest").alias("subroot"), "root")
    told = tree.paths(scratch.write(above, "above"), ["row"], ["subroot", "root"])
    return told.select("row", F.col("digest").alias("leaf"), "subroot", "root", "path")
