"""Places of rows within ordered groups, without a group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordwood.llm.shared import Scratch

#: So many runs are broadcast; more are joined by shuffle.
BROADCAST_RUNS = 200_000


def partition_of(at: Column) -> Column:
    """The sort partition in what ``monotonically_increasing_id`` gave."""
    return F.shiftright(at, 33)


def numbered(
    scratch: Scratch,
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows with ``idx`` (place in their group from 0) and ``n`` (rows of the group), and
    the written table behind them, to be dropped when they have been read.

    Rows are sorted by group and order over ranges, so a group that holds a third of all rows
    lies in many partitions. Each partition's part of a group is a run; a run begins after the
    rows of the group's runs before it. There are no more runs than groups and partitions
    together. Rows equal in all of ``order`` keep any order among themselves. No group column
    may be null. ``enrich`` may add columns to the runs (``part``, group, ``first``,
    ``before``, ``n``), which all rows then carry.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = scratch.write(placed.withColumn("at", F.monotonically_increasing_id()), "ordered")
    runs = placed.groupBy(partition_of(F.col("at")).alias("part"), *group).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("in_run")
    )
    same = Window.partitionBy(*group)
    before = F.sum("in_run").over(same.orderBy("part")) - F.col("in_run")
    runs = runs.select("part", *group, "first", before.alias("before"), F.sum("in_run").over(same).alias("n"))
    runs = scratch.write(enrich(runs) if enrich else runs, "runs")
    small = runs.count() <= BROADCAST_RUNS
    told = placed.withColumn("part", partition_of(F.col("at")))
    told = told.join(F.broadcast(runs) if small else runs, ["part", *group])
    told = told.withColumn("idx", F.col("at") - F.col("first") + F.col("before"))
    return told.drop("at", "first", "before", "part"), placed
