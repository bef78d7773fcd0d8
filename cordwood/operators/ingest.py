"""Ingest requests: guard, check and publish batches of events.

A request is judged as a whole within its row: its body is bounded, so the
events are an array there and neither a shuffle nor a join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.levels import strict_level
from cordwood.functions.once import with_once
from cordwood.functions.strict_json import NO_FIELDS, kind, replace_lone_surrogates, with_fields
from cordwood.operators.decode import decode_fields, event_fields, open_fields
from cordwood.operators.validate import event_json, violation
from cordwood.schemas import EVENT_FIELDS, MAX_BATCH_EVENTS, MAX_BODY_BYTES

ACCEPTED = "accepted"
INVALID_JSON = "invalid_json"
INVALID_REQUEST = "invalid_request"
TOO_LARGE = "request_too_large"


def judge_requests(
    requests: DataFrame,
    max_batch: int = MAX_BATCH_EVENTS,
    max_body_bytes: int = MAX_BODY_BYTES,
) -> DataFrame:
    """Add ``status``, ``message``, ``accepted``, ``rejected`` and ``valid`` events.

    A body that does not decode strictly fails as a whole; a decoded event
    that breaks the contract only fails itself. A batch of nothing but broken
    events is accepted with a count of zero.
    """
    fits = f"octet_length(body) <= {max_body_bytes}"
    opened = with_fields(requests, "_fields", f"if({fits}, {replace_lone_surrogates('body')}, NULL)", NO_FIELDS)
    events = f"""CASE WHEN size(array_except(map_keys(_fields), array('events'))) = 0 THEN coalesce(
 try_variant_get(_fields.events, '$', 'array<variant>'),
 if({kind('_fields.events')} = 'VOID', cast(array() AS array<variant>), NULL)) END"""
    decoded = opened.withColumn(
        "_events", F.expr(f"transform({events}, e -> {event_fields('e')})")
    ).withColumn(
        "_decoded",
        F.expr(f"transform(transform(_events, e -> {open_fields('e')}), o -> {decode_fields('o')})"),
    )
    outcome = decoded.withColumn(
        "_well_formed", F.expr("coalesce(forall(_decoded, e -> e.ok), false)")
    ).withColumn(
        "_admitted", F.expr(f"_well_formed AND size(_decoded) BETWEEN 1 AND {max_batch}")
    )
    judged = f"""transform(_decoded,
 e -> struct(e AS event, {violation('e', 'octet_length(body)')} AS why))"""
    outcome = outcome.withColumn("_judged", F.expr(f"if(_admitted, {judged}, NULL)"))
    result = f"""struct(CASE
  WHEN NOT {fits} THEN '{TOO_LARGE}'
  WHEN NOT _well_formed THEN '{INVALID_JSON}'
  WHEN NOT _admitted THEN '{INVALID_REQUEST}'
  ELSE '{ACCEPTED}' END AS status,
 CASE
  WHEN NOT {fits} THEN 'request body exceeds the configured limit'
  WHEN NOT _well_formed AND _fields IS NULL AND try_parse_json(body) IS NOT NULL
   THEN 'request body must contain one JSON value'
  WHEN NOT _well_formed THEN 'request body must be valid JSON'
  WHEN size(_decoded) = 0 THEN 'events must not be empty'
  WHEN NOT _admitted THEN 'batch exceeds max size' END AS message,
 transform(filter(_judged, j -> j.why IS NULL), j -> j.event) AS valid,
 coalesce(size(_judged), 0) AS events)"""
    done = with_once(outcome, "_result", F.expr(result))
    accepted = "coalesce(size(_result.valid), 0)"
    return done.select(
        *requests.columns,
        "_result.status",
        "_result.message",
        F.expr(f"cast({accepted} AS bigint)").alias("accepted"),
        F.expr(f"cast(_result.events - {accepted} AS bigint)").alias("rejected"),
        "_result.valid",
    )


def ingest_results(requests: DataFrame, **limits) -> DataFrame:
    """``request_id, status, message, accepted, rejected`` per request."""
    return judge_requests(requests, **limits).select(
        "request_id", "status", "message", "accepted", "rejected"
    )


def ingest_counters() -> list[Column]:
    """Aggregates over judged requests."""
    return [
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("ingested_events"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected_events"),
    ]


def accepted_events(judged: DataFrame) -> DataFrame:
    """Valid events of the admitted requests with canonical levels."""
    events = judged.select(F.explode("valid").alias("e"))
    named = events.select(*[F.col("e")[name].alias(name) for name in EVENT_FIELDS])
    return named.withColumn("level", F.expr(strict_level("level")))


def publish_events(events: DataFrame) -> DataFrame:
    """``key, value, timestamp`` rows for a message sink, keyed by event id."""
    framed = events.select("id", "timestamp", F.struct(*EVENT_FIELDS).alias("_event"))
    return framed.select(
        F.col("id").cast("binary").alias("key"),
        F.expr(event_json("_event")).cast("binary").alias("value"),
        "timestamp",
    )
