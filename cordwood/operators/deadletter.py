"""Redacted envelopes of records that cannot be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.times import format_rfc3339
from cordwood.schemas import DEAD_LETTER_SCHEMA_VERSION


def dead_letter_id(topic: Column, partition: Column, offset: Column) -> Column:
    """Depends on the position alone, so a redelivered record keeps its id."""
    position = F.concat(
        topic, F.char(F.lit(0)), partition.cast("string"), F.char(F.lit(0)), offset.cast("string")
    )
    return F.concat(F.lit("dlq-"), F.sha2(position, 256))


def to_dead_letters(classified: DataFrame, failed_at: Column) -> DataFrame:
    """Envelopes of the failed records: hashes and sizes, never payload or key."""
    key, value = F.col("key"), F.col("value")
    return classified.where(F.col("failure").isNotNull()).select(
        F.lit(DEAD_LETTER_SCHEMA_VERSION).alias("schema_version"),
        dead_letter_id(F.col("topic"), F.col("partition"), F.col("offset")).alias("id"),
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.col("timestamp").alias("original_timestamp"),
        failed_at.alias("failed_at"),
        F.col("failure"),
        F.sha2(value.cast("binary"), 256).alias("payload_sha256"),
        F.coalesce(F.octet_length(value), F.lit(0)).alias("payload_bytes"),
        F.when(F.octet_length(key) > 0, F.sha2(key.cast("binary"), 256)).alias("key_sha256"),
    )


def lookup_dead_letters(letters: DataFrame, topic: str, payload_sha256: str) -> DataFrame:
    return letters.where(
        (F.col("original_topic") == topic) & (F.col("payload_sha256") == payload_sha256)
    )


def dead_letter_rows(letters: DataFrame) -> DataFrame:
    """``key, value, timestamp`` rows for a message sink; an empty key hash is left out."""
    body = F.to_json(
        F.struct(
            *["schema_version", "id", "original_topic", "original_partition", "original_offset"],
            F.expr(format_rfc3339("original_timestamp")).alias("original_timestamp"),
            F.expr(format_rfc3339("failed_at")).alias("failed_at"),
            *["failure", "payload_sha256", "payload_bytes", "key_sha256"],
        )
    )
    return letters.select(
        F.col("id").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.col("failed_at").alias("timestamp"),
    )
