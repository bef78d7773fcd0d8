"""Page numbers for a whole result, and joining of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood.operators.firstwins import first_per_key
from cordwood.schemas import EXPLORER_PAGE
from cordwood.session import checkpointed


def page_numbers(df: DataFrame, page_size: int = EXPLORER_PAGE) -> DataFrame:
    """Add ``row_no`` and ``page_no`` (from 1) in page order, newest first.

    A window over the whole table would put every row into one task. Rows are sorted
    over ranges of time and id, so a second that holds a third of all rows is divided
    by id, and fixed by a checkpoint. A row's number is the rows of the partitions before
    its own, one count for each, plus its place in its partition. Rows without a time
    come last. Rows with the same time and id have any order among themselves.
    """
    order = [F.desc_nulls_last("timestamp"), F.desc_nulls_last("id")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number of the partition, and below it 33 bits for the place within.
    placed = checkpointed(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_part", part)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")
    # One row for each partition of the sort.
    counts = counts.select("_part", before.alias("_before"))
    numbered = placed.join(F.broadcast(counts), "_part").withColumn("row_no", F.col("_before") + place + 1)
    return numbered.select(*df.columns, "row_no", F.expr(f"(row_no - 1) div {page_size} + 1").alias("page_no"))


def append_unique(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Current rows, then the incoming rows whose id is new; the first copy in page order stays.

    Pages run newest first. Copies of an id at the same time are ordered by
    ``position`` where the incoming rows have it.
    """
    age = -F.unix_micros(F.col("timestamp").cast("timestamp"))
    order = ["_age"] + [c for c in ("position",) if c in incoming.columns]
    fresh = first_per_key(incoming.withColumn("_age", age), "id", order)
    return current.unionByName(fresh.join(current.select("id"), "id", "left_anti").select(*current.columns))
