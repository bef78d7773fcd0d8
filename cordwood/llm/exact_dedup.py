"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. The distinct blocks are sorted
and numbered, so that equal blocks, and only those, have the same integer name. Adjacent
names are paired, the distinct pairs are sorted and named in turn, until every document has
one name. Names are compared by content at every level, never by a hash of it, so an
identity can't collide.

A document whose length and first characters no other document shares is named by them
alone and takes no further part. The others are found with a hash of those two, which may
only let too many through.

Everything is DataFrame operations. Copies collapse in map-side aggregation before names
are given; names are written as tables and joined back by shuffle joins whose large
partitions Spark can split, so a group that holds a third of all rows is spread.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as
empty, and empty texts are copies of each other. Of equal texts the row with the largest
``doc_id`` stays, a null ``doc_id`` only if there is no other; of rows that repeat it, one.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.llm.shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters of the first name of a document, and of a block.
HEAD, BLOCK = 64, 1024
#: So many hashes of shared beginnings are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _beginning(text: Column) -> Column:
    return F.xxhash64(F.octet_length(text), lower_ascii(F.substring(text, 1, HEAD)))


def _named(scratch: Scratch, rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Rows with ``name`` in place of the keys: the number of their keys in sorted order.

    Keys may not be null.
    """
    sorted_keys = rows.select(*keys).distinct().sort(*keys)
    names = scratch.write(sorted_keys.withColumn("name", F.monotonically_increasing_id()), f"names-{step}")
    named = scratch.write(rows.join(names, keys).drop(*keys), f"level-{step}")
    scratch.drop(names)
    return named


def exact_groups(docs: DataFrame, carry: list[str], block: int = BLOCK) -> DataFrame:
    """One row per document: ``row`` (a struct of the ``carry`` columns), ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256`` (of the text in lower case)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), text.alias("text")
    )

    begun = plain.select(_beginning(F.col("text")).alias("beginning"))
    shared = scratch.write(
        begun.groupBy("beginning").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("beginning"), "shared"
    )
    side = shared.withColumn("is_shared", F.lit(True))
    side = F.broadcast(side) if shared.count() <= BROADCAST_ROWS else side
    lower = plain.withColumn("beginning", _beginning(F.col("text"))).withColumn("text", lower_ascii(F.col("text")))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / block).cast("int"))
    blocks = F.transform(starts, lambda k: F.substring(F.col("text"), k * block + 1, F.lit(block)))
    rows = scratch.write(
        lower.join(side, "beginning", "left").select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            "row",
            F.sha2("text", 256).alias("text_sha256"),
            F.when(F.col("is_shared"), blocks).alias("blocks"),
        ),
        "rows",
    )
    scratch.drop(shared)

    alone = rows.where("blocks IS NULL").select(
        "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    copies = rows.where("blocks IS NOT NULL")
    most = copies.agg(F.max(F.size("blocks"))).first()[0] or 0

    done = []
    level = copies.select("rid", F.size("blocks").alias("left"), F.posexplode("blocks").alias("pos", "block"))
    level = _named(scratch, level, ["block"], "0")
    for step in range(max(most - 1, 0).bit_length() + 1):
        done.append(level.where("left = 1").select("rid", F.lit(step).alias("step"), "name"))
        if 1 << step >= most:
            break
        first = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first")
        second = F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = level.where("left > 1").groupBy("rid", "left", half)
        # -1 is no name: it stands for the missing half of a last, single block.
        pairs = pairs.agg(first, F.coalesce(second, F.lit(-1)).alias("second"))
        halved = pairs.withColumn("left", F.floor((F.col("left") + 1) / 2).cast("int"))
        level = _named(scratch, halved, ["first", "second"], str(step + 1))

    identities = reduce(DataFrame.unionByName, done)
    members = scratch.write(
        identities.join(rows.where("blocks IS NOT NULL").select("rid", "doc_id"), "rid"), "members"
    )
    # The largest doc_id, and of rows that repeat it one.
    groups = members.groupBy("step", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("stays")
    )
    groups = scratch.write(groups, "groups")
    told = members.join(groups, ["step", "name"]).select(
        "rid", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("stays.rid")).alias("kept")
    )
    told = scratch.write(told, "told")
    scratch.drop(members, groups)
    again = rows.where("blocks IS NOT NULL").select("rid", "row", "text_sha256").join(told, "rid")
    return alone.unionByName(again.select(*alone.columns))
