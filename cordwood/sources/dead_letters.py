"""Dead letters landed as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cordwood.operators.deadletter import lookup_dead_letters
from cordwood.schemas import DEAD_LETTER


def read_dead_letters(
    spark: SparkSession,
    path: str,
    topic: str | None = None,
    payload_sha256: str | None = None,
) -> DataFrame:
    """All letters, or those of one record found by topic and payload hash."""
    letters = spark.read.schema(DEAD_LETTER).parquet(path)
    if topic is None or payload_sha256 is None:
        return letters
    return lookup_dead_letters(letters, topic, payload_sha256)
