"""Connected components of links by hooking and pointer jumping, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.llm.shared import Scratch


def rooted(rows: DataFrame, roots: DataFrame | None, column: str, name: str) -> DataFrame:
    """Adds the component of the node in ``column``; a node without a root is its own."""
    if roots is None:
        return rows.withColumn(name, F.col(column))
    side = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(side, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def _between_roots(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The distinct pairs of different components that links connect, the larger as ``u``."""
    both = rooted(rooted(edges, roots, "a", "_one"), roots, "b", "_two").where("_one <> _two")
    return both.select(F.greatest("_one", "_two").alias("u"), F.least("_one", "_two").alias("v")).distinct()


def connect(scratch: Scratch, links: DataFrame, roots: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of all nodes that are not the smallest of their component.

    ``links`` (``a``, ``b``) are added to the components in ``roots``. Each round hangs
    every component that has a smaller neighbour under its smallest one, and follows the
    chains that this makes until each ends in a root, halving them at every step. A node
    with very many links is met in map-side minima only. Rows never outnumber the links.
    """
    edges = scratch.write(_between_roots(links, roots), "edges")
    while not edges.isEmpty():
        parents = scratch.write(edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), "parents")
        while True:
            jumped = rooted(parents, parents, "root", "next")
            jumped = scratch.write(jumped, "jumped")
            moved = not jumped.where("next <> root").isEmpty()
            scratch.drop(parents)
            parents = jumped.select("node", F.col("next").alias("root"))
            parents._scratch_path = jumped._scratch_path
            if not moved:
                break
        if roots is None:
            roots = parents
        else:
            moved_roots = rooted(roots, parents, "root", "next").select("node", F.col("next").alias("root"))
            roots = scratch.write(moved_roots.unionByName(parents), "roots")
        named = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
        edges = scratch.write(_between_roots(named, parents), "edges")
    return roots
