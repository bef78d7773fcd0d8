from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cordwood.operators.decode import decode_strict
from cordwood.operators.deadletter import dead_letter_rows, to_dead_letters
from cordwood.operators.validate import classify, valid_events
from tests.samples import NOON, event, raw_frame

GOOD = json.dumps(event())
BIG = "x" * (256 * 1024)

MALFORMED = {
    "unknown field": event(api_key="hunter2"),
    "not json": "just words",
    "empty": "",
    "trailing value": GOOD + " {}",
    "closed early": GOOD + "],[" + GOOD,
    "closed early, empty": "{}],[{}",
    "two elements": GOOD + "," + GOOD,
    "array": [event()],
    "scalar": "1",
    "single quotes": GOOD.replace('"', "'"),
    "level a number": event(level=3),
    "id a boolean": event(id=True),
    "attributes an array": event(attributes=[1]),
    "attributes a string": event(attributes="x"),
    "source an array": event(source=["x"]),
    "source value a number": event(source={"file": 1}),
    "version a string": event(schema_version="1"),
    "version a fraction": GOOD.replace('"schema_version": 1', '"schema_version": 1.0'),
    "no such hour": event(timestamp="2031-03-07T25:00:00Z"),
    "no such day": event(timestamp="2026-02-30T00:00:00Z"),
    "date only": event(timestamp="2031-03-07"),
    "lower-case zone": event(timestamp="2031-03-07T20:15:00z"),
    "line break after the time": event(timestamp="2031-03-07T20:15:00Z\n"),
    "other case": GOOD.replace('"id"', '"ID"'),
}

INVALID = {
    "schema_version must be 1": [{}, "null", event(schema_version=2), event(schema_version=None)],
    "id is required": [event(id=...), event(id=None), event(id=" \t ")],
    "id exceeds 128 bytes": [event(id="i" * 129), event(id="é" * 65)],
    "service is required": [event(service=...), event(service="")],
    "service exceeds 128 bytes": [event(service="s" * 129)],
    "message is required": [event(message=""), event(message="\n")],
    "level is unsupported": [event(level="shouting"), event(level="")],
    "timestamp is required": [event(timestamp=...), event(timestamp="0001-01-01T00:00:00Z")],
    "message exceeds 32768 bytes": [event(message="m" * 32769)],
    "attributes must be an object": [event(attributes=None), event(attributes=...)],
    "source must be an object": [event(source=None), event(source=...)],
    "event exceeds 262144 bytes": [
        event(attributes={"payload": BIG}),
        event(attributes={"payload": "<" * 50_000}),
    ],
}


def failures(spark, payloads):
    rows = classify(raw_frame(spark, payloads)).select("offset", "failure").collect()
    return [r.failure for r in sorted(rows, key=lambda r: r.offset)]


def test_malformed_records(spark):
    found = failures(spark, MALFORMED.values())
    wrong = [n for n, f in zip(MALFORMED, found) if not f or f.code != "malformed_event"]
    assert wrong == []
    assert {f.message for f in found} == {"record is not one valid LogEvent JSON object"}


@pytest.mark.parametrize("message", INVALID)
def test_invalid_events_name_the_rule(spark, message):
    found = failures(spark, INVALID[message])
    assert [(f.code, f.message) for f in found] == [("invalid_event", message)] * len(found)


def test_first_broken_rule_is_named(spark):
    found = failures(
        spark,
        [
            event(schema_version=9, id="", level="x"),
            event(id="", service="", message=""),
            event(level="x", timestamp=..., message="m" * 40_000),
            event(timestamp=..., message="m" * 40_000),
        ],
    )
    assert [f.message for f in found] == [
        "schema_version must be 1",
        "id is required",
        "level is unsupported",
        "timestamp is required",
    ]


def test_valid_events(spark):
    payloads = [
        event(level=" WARNING ", timestamp="2031-03-07T16:15:00.25-04:00"),
        event(id="é" * 64, message="m" * 32768),
        event(source={"a": None, "b": "x"}),
        event(attributes={"list": [{"z": 1}]}, message=" padded "),
        GOOD.replace('"message": "posted entry 12"', '"message": "old", "message": "new"'),
        event(attributes={"payload": "y" * 200_000}),
        b'{"schema_version":1,"id":"bad utf8","service":"s","level":"info","message":"a\xffb",'
        b'"timestamp":"2031-03-07T20:15:00Z","attributes":{},"source":{}}',
        "  " + GOOD + "\n",
    ]
    assert failures(spark, payloads) == [None] * len(payloads)
    rows = {r.offset: r for r in valid_events(classify(raw_frame(spark, payloads))).collect()}
    assert rows[0].level == "warn" and rows[0].timestamp.isoformat() == "2031-03-07T20:15:00.250000"
    assert rows[2].source == {"a": "", "b": "x"}
    assert rows[3].message == " padded "
    assert rows[4].message == "new"
    assert rows[6].message == "a�b"


def letters(spark, payloads, **where):
    return to_dead_letters(classify(raw_frame(spark, payloads, **where)), F.lit(NOON))


def test_dead_letter_fingerprints(spark):
    payload = b'{"api_key":"hunter2"}'
    (row,) = letters(spark, [payload]).collect()
    assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert row.payload_bytes == len(payload)
    assert row.key_sha256 == hashlib.sha256(b"key").hexdigest()
    assert row.id == "dlq-" + hashlib.sha256(b"logs.raw\x000\x000").hexdigest()
    (wire,) = dead_letter_rows(letters(spark, [payload])).collect()
    assert bytes(wire.key).decode() == row.id
    assert b"hunter2" not in bytes(wire.value) and b"api_key" not in bytes(wire.value)
    sent = json.loads(bytes(wire.value))
    assert sent["failure"]["code"] == "malformed_event" and sent["failed_at"] == "2031-03-07T12:00:00Z"


def test_dead_letter_id_depends_on_the_position_only(spark):
    first = letters(spark, ["just words"]).first().id
    assert letters(spark, [event(level="shouting")]).first().id == first
    assert letters(spark, ["just words"], partition=1).first().id != first


def test_empty_key_has_no_hash(spark):
    frame = raw_frame(spark, ["x"]).withColumn("key", F.lit(b""))
    (row,) = dead_letter_rows(to_dead_letters(classify(frame), F.lit(NOON))).collect()
    assert "key_sha256" not in json.loads(bytes(row.value))


def test_half_a_surrogate_pair_is_replaced(spark):
    texts = [r"\\ud83d\udc00", r"\\\ud83dz", r"\\\\\udc00", r"\ud83d\ud83d\ude00\ude00"]
    rows = valid_events(classify(raw_frame(spark, [json.dumps(event(message="@")).replace("@", t) for t in texts]))).collect()
    assert [r.message for r in rows] == ["\\ud83d\ufffd", "\\\ufffdz", "\\\\\ufffd", "\ufffd\U0001f600\ufffd"]
    texts = [r"x\ud800y", r"\udc01", r"\ud83d\ude00", r"\\ud800", r"\ud800\ud83d\ude00", r"\uD83Dz"]
    payloads = [json.dumps(event(message="@")).replace("@", text) for text in texts]
    rows = decode_strict(raw_frame(spark, payloads)).orderBy("offset").select("event.message", "decode_ok").collect()
    assert all(r.decode_ok for r in rows)
    assert [r.message for r in rows] == ["x\ufffdy", "\ufffd", "\U0001f600", r"\ud800", "\ufffd\U0001f600", "\ufffdz"]


def test_settings_are_asked_for(spark):
    name = "spark.sql.variant.allowDuplicateKeys"
    spark.conf.set(name, "false")
    try:
        with pytest.raises(ValueError, match="configure"):
            decode_strict(raw_frame(spark, [event()]))
    finally:
        spark.conf.set(name, "true")
