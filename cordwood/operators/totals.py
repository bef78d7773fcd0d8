"""Counts of stored records that are written with each batch and merged when read.

A batch writes one row for each day, time of arrival, service and level under a key made from
the positions of its records. A batch that is replayed after it died may write them again,
under the same key and a later attempt; only the last attempt of a batch counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.times import moment_literal

TOTAL = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("attempt", T.LongType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("rows", T.LongType()),
    ]
)

_GROUP = ("event_date", "received_at", "service", "level")


def batch_totals(records: DataFrame, batch: Column, attempt: Column) -> DataFrame:
    """The counts of the records of a batch."""
    counted = records.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(batch.alias("batch"), attempt.alias("attempt"), *_GROUP, "rows")


def last_attempts(totals: DataFrame) -> DataFrame:
    """The counts that hold: those of the last attempt of each batch."""
    last = totals.groupBy("batch").agg(F.max("attempt").alias("attempt"))
    return totals.join(last, ["batch", "attempt"], "left_semi")


def summary(totals: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """The summary of all records from their counts; see ``summary.summary``."""
    if now is None:
        since: Column = F.current_timestamp() - F.expr("interval 1 minute")
    else:
        since = moment_literal(totals, "received_at", now - dt.timedelta(minutes=1))
    recent = F.col("received_at") >= since
    zero = F.lit(0).cast("long")

    def rows(chosen: Column) -> Column:
        return F.coalesce(F.sum(F.when(chosen, F.col("rows"))), zero)

    return totals.agg(
        rows(F.lit(True)).alias("logs_ingested_total"),
        rows(recent).alias("logs_last_minute"),
        rows(recent & (F.col("level") == "error")).alias("errors_last_minute"),
        F.count_distinct("service").alias("active_services"),
    )


def services(totals: DataFrame) -> DataFrame:
    """Distinct service names in order."""
    return totals.select("service").distinct().orderBy("service")


def rows_by_day(totals: DataFrame) -> DataFrame:
    """(event_date, rows) of the stored days, newest first."""
    return totals.groupBy("event_date").agg(F.sum("rows").alias("rows")).orderBy(F.desc("event_date"))
