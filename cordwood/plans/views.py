"""Log views derived from the given tables.

The tables are clean, so ties, duplicates and broken records are built in by
rules on the row number. Every view covers its whole table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions.times import UTC
from cordwood.operators.validate import normalize

# Reference "now" of the views and of the dead letters made from them.
NOW = dt.datetime(2024, 1, 30, 12, 0, tzinfo=UTC)
NOW_TEXT = "2024-01-30T12:00:00Z"
MAX_BATCH = 50


def now_column() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL over the events table.
_EVENT_ID = "concat('evt-', event_id)"
_SERVICE = "concat('svc-', user_id % 7)"
_MESSAGE = "concat(event_type, ' by user ', user_id)"
_FILE = "concat('app', user_id % 3, '.log')"
# Levels as applications write them.
RAW_LEVEL = """CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN ' WARNING '
 WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'trace' ELSE 'info' END"""


def _iso(moment: str) -> str:
    return f"""date_format({moment}, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")"""


def logs(spark: SparkSession, sf_dir: str, ties: bool = False, levels: str = "stored") -> DataFrame:
    """Stored records. ``ties`` cuts the time to the minute, so many rows share it."""
    moment = "cast(date_trunc('minute', ts) AS timestamp_ntz)" if ties else "ts"
    stored = table(spark, sf_dir, "events").selectExpr(
        "1S AS schema_version",
        f"{_EVENT_ID} AS id",
        f"{_SERVICE} AS service",
        f"{RAW_LEVEL} AS level",
        f"{_MESSAGE} AS message",
        "parse_json(props) AS attributes",
        f"map('agent', 'fixture', 'file', {_FILE}) AS source",
        f"{moment} AS timestamp",
        "ts + make_dt_interval(0, 0, 0, event_id % 90) AS received_at",
    )
    return normalize(stored) if levels == "stored" else stored


def untidy_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records with the levels as written, broken in turn by every rule for readers."""
    n = F.col("event_id")
    tidy = logs(spark, sf_dir, levels="raw").withColumn("event_id", F.expr("cast(substring(id, 5) AS bigint)"))
    return tidy.withColumns(
        {
            "schema_version": F.when(n % 11 == 0, 2).otherwise(1).cast("short"),
            "id": F.when(n % 13 == 0, "").otherwise(F.col("id")),
            "service": F.when(n % 17 == 0, "").otherwise(F.col("service")),
            "message": F.when(n % 19 != 0, F.col("message")),
            "timestamp": F.when(n % 23 != 0, F.col("timestamp")),
            "attributes": F.when(n % 29 == 0, F.parse_json(F.lit("[1]"))).otherwise(F.col("attributes")),
            "source": F.when(n % 31 == 0, F.expr("map('file', cast(NULL AS string))")).otherwise(F.col("source")),
        }
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as log messages."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"),
        F.col("source").alias("service"),
        F.lit("info").alias("level"),
        F.col("text").alias("message"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)").alias(
            "timestamp"
        ),
    )


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event is delivered a second time, later and with another message."""
    events = table(spark, sf_dir, "events")
    return events.selectExpr(
        "*", "explode(if(event_id % 10 = 0, array(0, 1), array(0))) AS again"
    )


def _payload(rule: str) -> str:
    """SQL for the JSON of one event, built by hand so that its bytes are known."""
    return f"""concat(
 '{{"schema_version":', if({rule} = 'version', '2', '1'),
 ',"id":"', {_EVENT_ID}, '","service":"', {_SERVICE},
 '","level":"', if({rule} = 'level', 'shouting', {RAW_LEVEL}),
 '","message":"', if({rule} = 'blank', ' ', concat({_MESSAGE}, if(again = 1, ' again', ''),
  if(event_id % 37 = 0, '\\\\ud800!', ''))),
 '","timestamp":"', if(event_id % 6 = 1, concat({_iso('ts - interval 4 hours')}, '-04:00'),
  concat({_iso('ts')}, 'Z')),
 '","attributes":', props, ',"source":{{"agent":"fixture","file":"', {_FILE}, '"}}',
 if({rule} = 'unknown', ',"api_key":"x"', ''), '}}', if({rule} = 'trailing', ' {{}}', ''))"""


def _rule(malformed_allowed: str = "true") -> str:
    """SQL for how an event is broken; the first rule that applies counts."""
    return f"""CASE
 WHEN event_id % 17 = 0 AND {malformed_allowed} THEN 'unknown'
 WHEN event_id % 19 = 0 THEN 'level'
 WHEN event_id % 23 = 0 AND {malformed_allowed} THEN 'trailing'
 WHEN event_id % 29 = 0 THEN 'version'
 WHEN event_id % 31 = 0 THEN 'blank'
 ELSE 'good' END"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records in the columns of the Kafka source."""
    ruled = _deliveries(spark, sf_dir).selectExpr("*", f"{_rule()} AS rule")
    return ruled.selectExpr(
        f"cast({_EVENT_ID} AS binary) AS key",
        f"cast({_payload('rule')} AS binary) AS value",
        "'logs.raw' AS topic",
        "cast(event_id % 4 AS int) AS partition",
        "event_id + again * 10000000L AS offset",
        "cast(ts AS timestamp) AS timestamp",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines: other key names, wrong types, bad times, blanks, broken JSON."""

    def name(first: str, second: str) -> str:
        return f"if(event_id % 3 = 0, '{second}', '{first}')"

    body = f"""concat('{{"', {name('level', 'severity')}, '":',
 if(event_id % 7 = 0, '5', concat('"', {RAW_LEVEL}, '"')),
 ',"', {name('message', 'msg')}, '":"', {_MESSAGE}, '","user_id":', user_id,
 ',"', {name('timestamp', 'time')}, '":"',
 if(event_id % 13 = 0, 'yesterday', concat({_iso('ts')}, 'Z')), '"')"""
    return table(spark, sf_dir, "events").selectExpr(
        f"""concat(CASE WHEN event_id % 37 = 0 THEN '   ' WHEN event_id % 11 = 0 THEN {body}
 ELSE concat({body}, '}}') END, if(event_id % 2 = 0, '\\r', '')) AS value""",
        f"{_SERVICE} AS service",
        f"{_FILE} AS file",
        "'json' AS format",
        "event_id",
    )


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the conversations; odd turns end in a carriage return.

    In every fifth conversation the first byte of a character, cut off, stands before it.
    """
    turns = table(spark, sf_dir, "conversations")
    split = turns.select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    broken = F.when(F.col("conv_id") % 5 == 0, F.expr("cast(X'E2' AS string)")).otherwise("")
    ending = F.when(F.col("turn") % 2 == 1, F.concat(broken, F.lit("\r"))).otherwise("")
    return split.select(
        F.concat("line", ending).alias("value"),
        F.col("role").alias("service"),
        F.concat(F.col("role"), F.lit(".log")).alias("file"),
        F.lit("plain").alias("format"),
        "conv_id",
        "turn",
        F.col("line_no").cast("long").alias("line_no"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest bodies of about forty events each.

    Every fourth group may hold malformed events, every sixth pair of groups
    makes one body over the limit of fifty, and now and then a body is empty.
    """
    events = _deliveries(spark, sf_dir).selectExpr(
        "*", f"{_rule('event_id div 40 % 4 = 0')} AS rule"
    )
    events = events.selectExpr(
        """if(event_id div 80 % 6 = 5, concat('wide-', event_id div 80),
 concat('req-', event_id div 40)) AS request_id""",
        "event_id * 2 + again AS order",
        f"{_payload('rule')} AS value",
    )
    # A group is a fixed span of row numbers, so its array stays small.
    bodies = events.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("order", "value"))).alias("all")
    )
    filled = bodies.select(
        "request_id",
        F.concat(F.lit('{"events":['), F.array_join("all.value", ","), F.lit("]}")).alias("body"),
    )
    empty = table(spark, sf_dir, "events").where("event_id % 360 = 0")
    return filled.unionByName(
        empty.selectExpr("concat('empty-', event_id) AS request_id", """'{"events":[]}' AS body""")
    )


def untidy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events, broken in turn by every rule of the contract."""
    n = F.col("doc_id")
    long_text = F.repeat(F.lit("x"), 262144)
    attributes = F.when(n % 211 == 0, F.create_map(F.lit("payload"), long_text)).otherwise(
        F.create_map(F.lit("n"), F.lit("1"))
    )
    moment = F.expr("timestamp'2024-01-01 00:00:00Z' + make_dt_interval(0, 0, doc_id, 0)")
    language = F.col("lang")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 67 == 0, 2).otherwise(1).cast("long").alias("schema_version"),
        F.when(n % 41 == 0, " \t")
        .when(n % 43 == 0, F.repeat(F.lit("i"), 129))
        .when(n % 44 == 0, F.repeat(F.lit("i"), 128))
        .otherwise(F.concat(F.lit("doc-"), n))
        .alias("id"),
        F.when(n % 47 == 0, "")
        .when(n % 49 == 0, F.repeat(F.lit("é"), 65))
        .when(n % 50 == 0, F.repeat(F.lit("é"), 64))
        .otherwise(F.col("source"))
        .alias("service"),
        F.when(language == "en", "info")
        .when(language == "fr", " WARNING\t")
        .when(language == "de", "Fatal")
        .otherwise("shouting")
        .alias("level"),
        F.when(n % 71 == 0, "\n ").otherwise(F.col("text")).alias("message"),
        F.when(n % 53 != 0, moment).alias("timestamp"),
        F.when(n % 59 != 0, F.to_variant_object(attributes)).alias("attributes"),
        F.when(n % 61 != 0, F.create_map(F.lit("file"), F.lit("a.log"))).alias("source"),
    )


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table held before the raw records arrive: the first ten days."""
    history = logs(spark, sf_dir)
    return history.where(F.col("timestamp") < F.expr("timestamp_ntz'2024-01-11 00:00:00'"))

