from __future__ import annotations

import json

import pytest

from cordwood.operators.ingest import (
    accepted_events,
    ingest_counters,
    ingest_results,
    judge_requests,
    publish_events,
)
from tests.samples import event


def judged(spark, *bodies, **limits):
    rows = [(str(n), b if isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "request_id string, body string")
    return judge_requests(frame, **limits), ingest_results(frame, **limits)


def results(spark, *bodies, **limits):
    _, rows = judged(spark, *bodies, **limits)
    ordered = sorted(rows.collect(), key=lambda r: int(r.request_id))
    return [(r.status, r.message, r.accepted, r.rejected) for r in ordered]


def test_guards_and_partial_acceptance(spark):
    good, bad = event(), event(id="m-301", level="shouting")
    assert results(
        spark,
        {"events": []},
        {"events": [good, good, good]},
        {"events": [good, bad]},
        {"events": [bad]},
        {"events": [None, good]},
        {"events": None},
        "null",
        {},
        max_batch=2,
    ) == [
        ("invalid_request", "events must not be empty", 0, 0),
        ("invalid_request", "batch exceeds max size", 0, 0),
        ("accepted", None, 1, 1),
        ("accepted", None, 0, 1),
        ("accepted", None, 1, 1),
        ("invalid_request", "events must not be empty", 0, 0),
        ("invalid_request", "events must not be empty", 0, 0),
        ("invalid_request", "events must not be empty", 0, 0),
    ]


@pytest.mark.parametrize(
    "body, message",
    [
        ("{", "request body must be valid JSON"),
        ('{"events":[],"more":1}', "request body must be valid JSON"),
        ('{"events":{}}', "request body must be valid JSON"),
        (json.dumps({"events": [event(), event(extra=1)]}), "request body must be valid JSON"),
        (json.dumps({"events": [event(level=1)]}), "request body must be valid JSON"),
        ('{"events":["x"]}', "request body must be valid JSON"),
        ('{"events":[]} {}', "request body must contain one JSON value"),
    ],
)
def test_a_body_that_does_not_decode_fails_as_a_whole(spark, body, message):
    assert results(spark, body) == [("invalid_json", message, 0, 0)]


def test_body_limit(spark):
    body = json.dumps({"events": [event(message="x" * 500)]})
    assert results(spark, body, max_body_bytes=400) == [
        ("request_too_large", "request body exceeds the configured limit", 0, 0)
    ]


def test_published_rows(spark):
    body = {
        "events": [
            event(
                id="b",
                level="WARNING",
                timestamp="2031-03-07T20:15:00.120-04:00",
                attributes={"z": 1, "a": {"k": [1, "x"]}},
                source={"host": "h", "agent": "a"},
            ),
            event(id="bad", message=""),
        ]
    }
    frame, _ = judged(spark, body)
    (row,) = publish_events(accepted_events(frame)).collect()
    assert bytes(row.key) == b"b"
    assert bytes(row.value).decode() == (
        '{"schema_version":1,"id":"b","service":"ledger","level":"warn","message":"posted entry 12",'
        '"timestamp":"2031-03-08T00:15:00.12Z","attributes":{"a":{"k":[1,"x"]},"z":1},'
        '"source":{"agent":"a","host":"h"}}'
    )
    assert frame.agg(*ingest_counters()).first().asDict() == {
        "ingested_events": 1,
        "rejected_events": 1,
    }
