"""First write wins: one row per key, earliest position first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` for every key.

    An aggregate rather than a window: copies of a key collapse to one row per
    task before the shuffle, so a key that holds a third of all rows sends a
    handful of rows to its reducer.
    """
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*[F.col(c) if c == key else F.col("_first")[c].alias(c) for c in df.columns])
