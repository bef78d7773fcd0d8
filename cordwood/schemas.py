"""Fixed, versioned schemas. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
DEAD_LETTER_SCHEMA_VERSION = 1

# Fixed contract limits, in bytes.
MAX_EVENT_BYTES = 256 * 1024
MAX_MESSAGE_BYTES = 32 * 1024
MAX_ID_BYTES = 128
MAX_SERVICE_BYTES = 128
MAX_LINE_BYTES = 256 * 1024
MAX_BODY_BYTES = 2 * 1024 * 1024
MAX_FILTER_BYTES = 256

# Fixed counts.
MAX_BATCH_EVENTS = 500
DEFAULT_PAGE = 100
MAX_PAGE = 500
EXPLORER_PAGE = 50

# Fixed level names, mildest first.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")

EVENT = T.StructType(
    [
        T.StructField("schema_version", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("attributes", T.VariantType()),
        T.StructField("source", T.MapType(T.StringType(), T.StringType())),
    ]
)
EVENT_FIELDS = tuple(EVENT.fieldNames())

# The stored table; ``event_date`` is the partition column.
RECORD = T.StructType(
    [
        T.StructField("schema_version", T.ShortType()),
        T.StructField("id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.VariantType()),
        T.StructField("source", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)
# What the table keeps besides: the index terms of the message.
STORED = T.StructType([*RECORD.fields[:-1], T.StructField("message_terms", T.ArrayType(T.StringType())), RECORD.fields[-1]])
RECORD_FIELDS = (
    "schema_version",
    "id",
    "service",
    "level",
    "message",
    "attributes",
    "source",
    "timestamp",
    "received_at",
)

# Columns of Spark's Kafka source, the input contract of the persistence job.
RAW = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
POSITION = ("topic", "partition", "offset")

DEAD_LETTER = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("original_topic", T.StringType()),
        T.StructField("original_partition", T.IntegerType()),
        T.StructField("original_offset", T.LongType()),
        T.StructField("original_timestamp", T.TimestampType()),
        T.StructField("failed_at", T.TimestampType()),
        T.StructField(
            "failure",
            T.StructType(
                [
                    T.StructField("code", T.StringType()),
                    T.StructField("message", T.StringType()),
                ]
            ),
        ),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("payload_bytes", T.IntegerType()),
        T.StructField("key_sha256", T.StringType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
