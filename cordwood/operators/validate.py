"""The event contract, checked in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.levels import is_level, strict_level
from cordwood.functions.once import with_once
from cordwood.functions.text import is_blank
from cordwood.functions.times import format_rfc3339
from cordwood.operators.decode import decode_strict
from cordwood.schemas import (
    EVENT_FIELDS,
    MAX_EVENT_BYTES,
    MAX_ID_BYTES,
    MAX_MESSAGE_BYTES,
    MAX_SERVICE_BYTES,
    SCHEMA_VERSION,
)

MALFORMED = "malformed_event"
INVALID = "invalid_event"
MALFORMED_MESSAGE = "record is not one valid LogEvent JSON object"


def event_json(event: str) -> str:
    """Wire form of an event struct: fixed field order, UTC time, sorted source keys."""
    e = event
    return f"""to_json(struct({e}.schema_version, {e}.id, {e}.service, {e}.level, {e}.message,
 {format_rfc3339(f'{e}.`timestamp`')} AS `timestamp`, {e}.attributes,
 map_from_entries(array_sort(map_entries({e}.source))) AS source))"""


def encoded_bytes(event: str) -> str:
    """Size of the wire form, with ``<``, ``>`` and ``&`` counted as six-byte escapes."""
    text = event_json(event)
    escaped = f"length({text}) - length(translate({text}, '<>&', ''))"
    return f"(octet_length({text}) + 5 * ({escaped}))"


def violation(event: str, payload_bytes: str | None = None) -> str:
    """First broken rule of an event struct, NULL for a valid event.

    ``payload_bytes``, where known, is the size of the JSON the event came
    from. An encoding grows a byte to six at most, so small payloads need no
    second encoding for the size rule.
    """
    e = event
    oversized = f"{encoded_bytes(e)} > {MAX_EVENT_BYTES}"
    if payload_bytes is not None:
        oversized = f"{payload_bytes} * 6 + 1024 > {MAX_EVENT_BYTES} AND {oversized}"
    zero = "timestamp'0001-01-01 00:00:00+00:00'"
    rules = [
        (
            f"{e}.schema_version IS NULL OR {e}.schema_version <> {SCHEMA_VERSION}",
            f"schema_version must be {SCHEMA_VERSION}",
        ),
        (is_blank(f"{e}.id"), "id is required"),
        (f"octet_length({e}.id) > {MAX_ID_BYTES}", f"id exceeds {MAX_ID_BYTES} bytes"),
        (is_blank(f"{e}.service"), "service is required"),
        (
            f"octet_length({e}.service) > {MAX_SERVICE_BYTES}",
            f"service exceeds {MAX_SERVICE_BYTES} bytes",
        ),
        (is_blank(f"{e}.message"), "message is required"),
        (f"NOT {is_level(f'{e}.level')}", "level is unsupported"),
        (f"{e}.`timestamp` IS NULL OR {e}.`timestamp` = {zero}", "timestamp is required"),
        (
            f"octet_length({e}.message) > {MAX_MESSAGE_BYTES}",
            f"message exceeds {MAX_MESSAGE_BYTES} bytes",
        ),
        (f"{e}.attributes IS NULL", "attributes must be an object"),
        (f"{e}.source IS NULL", "source must be an object"),
        (oversized, f"event exceeds {MAX_EVENT_BYTES} bytes"),
    ]
    return "CASE " + " ".join(f"WHEN {broken} THEN '{text}'" for broken, text in rules) + " END"


def validate(events: DataFrame) -> DataFrame:
    """Add ``violation`` to a frame of event columns."""
    event = F.struct(*EVENT_FIELDS).alias("_event")
    checked = events.select("*", event).withColumn("violation", F.expr(violation("_event")))
    return checked.drop("_event")


def normalize(events: DataFrame) -> DataFrame:
    """Canonical level names; timestamps are instants already."""
    return events.withColumn("level", F.expr(strict_level("level")))


def classify(records: DataFrame) -> DataFrame:
    """Decode and check raw records; ``failure`` is NULL for a valid record."""
    decoded = decode_strict(records)
    broken = decoded.withColumn("_violation", F.expr(violation("event", "octet_length(value)")))
    outcome = f"""struct(event, CASE
 WHEN NOT decode_ok THEN struct('{MALFORMED}' AS code, '{MALFORMED_MESSAGE}' AS message)
 WHEN _violation IS NOT NULL THEN struct('{INVALID}' AS code, _violation AS message)
 END AS failure)"""
    routed = with_once(broken, "_outcome", F.expr(outcome))
    return routed.select(*records.columns, "_outcome.event", "_outcome.failure")


def route_counters() -> list[Column]:
    """Aggregates over classified records; a redelivered event counts as persisted."""
    failure = F.col("failure")
    return [
        F.count(F.lit(1)).alias("records"),
        F.count_if(failure.isNull()).alias("persisted"),
        F.count_if(failure.isNotNull()).alias("dead_lettered"),
        F.count_if(failure["code"] == MALFORMED).alias("malformed"),
        F.count_if(failure["code"] == INVALID).alias("invalid"),
    ]


def valid_events(classified: DataFrame) -> DataFrame:
    """Event columns and stream position of the valid records."""
    return normalize(
        classified.where(F.col("failure").isNull()).select(
            *[F.col("event")[name].alias(name) for name in EVENT_FIELDS],
            "topic",
            "partition",
            "offset",
        )
    )
