"""Counts over stored logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.times import moment_literal

SUMMARY_FIELDS = (
    "logs_ingested_total",
    "logs_last_minute",
    "errors_last_minute",
    "active_services",
)


def summary(logs: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """One row of four counts; the minute runs back from ``now`` and has no upper end.

    The minute counts use the arrival time. Only ``error`` counts as an error,
    and a service is active once it has any row at all.
    """
    if now is None:
        since: Column = F.current_timestamp() - F.expr("interval 1 minute")
    else:
        since = moment_literal(logs, "received_at", now - dt.timedelta(minutes=1))
    recent = F.col("received_at") >= since
    return logs.agg(
        F.count(F.lit(1)).alias("logs_ingested_total"),
        F.count_if(recent).alias("logs_last_minute"),
        F.count_if(recent & (F.col("level") == "error")).alias("errors_last_minute"),
        F.count_distinct("service").alias("active_services"),
    )


def services(logs: DataFrame) -> DataFrame:
    """Distinct service names in order."""
    return logs.select("service").distinct().orderBy("service")
