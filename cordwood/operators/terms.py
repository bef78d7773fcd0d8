"""An index of message terms: in which hours a term occurs.

One narrow row for each term, day and hour of a batch, in folders by a hash of the term and
sorted by term, with a Bloom filter for each row group. A search reads the rows of its terms
only, and of the records the days and hours where all terms occur. Rows may repeat, and an
hour may be listed for a record that was never stored; the records decide.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.times import moment_literal

TERM_HOUR = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

#: Folders of the index.
BUCKETS = 32
#: So many stretches of hours become bounds on the time; more are bounds on the day alone.
MOST_STRETCHES = 48
#: Parquet settings by which row groups without a term are skipped.
FILTERED = {
    "parquet.bloom.filter.enabled#term": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.page.row.count.limit": "2000",
}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _hour() -> Column:
    """Hour of the UTC day, whatever the zone of the session."""
    return F.expr("pmod(floor(unix_micros(cast(timestamp AS timestamp)) / 3600000000), 24)").cast("int")


def term_hours(records: DataFrame) -> DataFrame:
    """The index rows of records with ``message_terms``, ``timestamp`` and ``event_date``."""
    hours = records.select(F.explode("message_terms").alias("term"), "event_date", _hour().alias("hour")).distinct()
    return hours.withColumn("bucket", _bucket(F.col("term")))


def hours_of(index: DataFrame, terms: list[str]) -> DataFrame:
    """(event_date, hour) where all terms occur."""
    terms = sorted(set(terms))
    buckets = F.array_distinct(F.transform(F.array(*map(F.lit, terms)), _bucket))
    chosen = [row[0] for row in index.sparkSession.range(1).select(F.explode(buckets)).collect()]
    found = index.where(F.col("bucket").isin(chosen) & F.col("term").isin(terms))
    counted = found.groupBy("event_date", "hour").agg(F.count_distinct("term").alias("_terms"))
    return counted.where(F.col("_terms") == len(terms)).select("event_date", "hour")


def _stretches(hours: list[tuple[dt.date, int]]) -> list[tuple[dt.datetime, dt.datetime]]:
    """``[from, to)`` of hours that follow one another."""
    hour = dt.timedelta(hours=1)
    found: list[tuple[dt.datetime, dt.datetime]] = []
    for day, number in sorted(hours):
        begin = dt.datetime.combine(day, dt.time(number))
        if found and found[-1][1] == begin:
            found[-1] = found[-1][0], begin + hour
        else:
            found.append((begin, begin + hour))
    return found


def within_hours(logs: DataFrame, hours: list[tuple[dt.date, int]]) -> DataFrame:
    """The records of some hours, in predicates that reach the listing of days and the scan."""
    if not hours:
        return logs.where(F.lit(False))
    days = sorted({day for day, _ in hours})
    found = logs.where(F.col("event_date").isin(days))
    stretches = _stretches(hours)
    if len(stretches) <= MOST_STRETCHES:
        moment = F.col("timestamp")
        tests = [
            (moment >= moment_literal(logs, "timestamp", begin)) & (moment < moment_literal(logs, "timestamp", end))
            for begin, end in stretches
        ]
        found = found.where(reduce(or_, tests))
    return found
