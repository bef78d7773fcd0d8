"""Ingest requests: one row per request body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions.strict_json import kind, text_of, with_fields
from cordwood.schemas import REQUEST


def read_requests(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """JSON lines of ``{"request_id": …, "body": …}``."""
    if not streaming:
        return spark.read.schema(REQUEST).json(path)
    reader = spark.readStream.schema(REQUEST)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def explode_requests(requests: DataFrame) -> DataFrame:
    """One row per array element of ``events``: ``request_id, pos, id, event``."""
    opened = with_fields(requests, "_fields", "body")
    events = F.expr("try_variant_get(_fields.events, '$', 'array<variant>')")
    rows = opened.select("request_id", F.posexplode(events).alias("pos", "event"))
    key = "try_variant_get(event, '$.id', 'variant')"
    return rows.select(
        "request_id",
        "pos",
        F.expr(f"if({kind(key)} = 'STRING', {text_of(key)}, NULL)").alias("id"),
        "event",
    )
