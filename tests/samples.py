"""Small inputs shared by the tests."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession

from cordwood.schemas import EVENT, RAW

UTC = dt.timezone.utc
NOON = dt.datetime(2031, 3, 7, 12, 0, tzinfo=UTC)


def event(**changes) -> dict:
    base = {
        "schema_version": 1,
        "id": "m-300",
        "service": "ledger",
        "level": "info",
        "message": "posted entry 12",
        "timestamp": "2031-03-07T04:45:30Z",
        "attributes": {},
        "source": {},
    }
    base.update(changes)
    return {key: value for key, value in base.items() if value is not ...}


def raw_frame(spark: SparkSession, payloads, topic: str = "logs.raw", partition: int = 0) -> DataFrame:
    """Kafka-shaped rows; offsets count up from zero."""
    rows = []
    for offset, payload in enumerate(payloads):
        text = payload if isinstance(payload, (str, bytes)) else json.dumps(payload)
        value = text if isinstance(text, bytes) else text.encode()
        rows.append((b"key", bytearray(value), topic, partition, offset, NOON))
    return spark.createDataFrame(rows, RAW)


def event_frame(spark: SparkSession, events) -> DataFrame:
    """Decoded event columns from dictionaries, by way of JSON text."""
    lines = [(json.dumps(e),) for e in events]
    text = spark.createDataFrame(lines, "line string")
    return text.selectExpr(f"from_json(line, '{EVENT.simpleString()[7:-1].replace(':', ' ')}') AS e").select("e.*")
