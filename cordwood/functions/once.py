"""Evaluate a costly expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters refer to instead of repeating.

    Catalyst pushes a filter through a projection by copying the projected
    expression into it; for a JSON parse that means parsing again, once per
    reference. It does not push through a generator, so the value is passed
    through a one-element ``explode``. The rows stay where they are.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
