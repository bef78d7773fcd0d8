"""RFC 3339 text and typed timestamp literals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark's own cast also takes bare years, dates and zone names, so the shape is
# checked first; ``\z`` because ``$`` would allow a final line break.
_STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
_LENIENT = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"

UTC = dt.timezone.utc


def parse_rfc3339(text: str) -> str:
    """SQL: timestamp of a strict RFC 3339 text, else NULL. Sub-microseconds are cut."""
    return f"if({text} RLIKE r'{_STRICT}', try_cast({text} AS timestamp), NULL)"


def parse_rfc3339_lenient(text: Column) -> Column:
    """Also takes lower-case ``t``/``z`` and a space before the time of day."""
    canonical = F.translate(F.upper(text), " ", "T")
    return F.when(text.rlike(_LENIENT), canonical.try_cast("timestamp"))


def utc_wall_clock(moment: str) -> str:
    """SQL: the instant as UTC wall-clock time, whatever the zone of the session."""
    seconds = f"cast(cast(unix_micros(cast({moment} AS timestamp)) AS decimal(20, 0)) / 1000000 AS decimal(18, 6))"
    return f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})"


def utc_day(moment: str) -> str:
    """SQL: the UTC day of an instant, whatever the zone of the session."""
    return f"date_add(date'1970-01-01', cast(floor(unix_micros(cast({moment} AS timestamp)) / 86400000000) AS int))"


def format_rfc3339(moment: str) -> str:
    """SQL: UTC text with the shortest fraction, such as ``2026-07-07T20:15:00.5Z``.

    Takes instants, and wall-clock times as UTC. Wall-clock times turn into text
    without a look at the zone of the session.
    """
    wall_clock = f"if(typeof({moment}) = 'timestamp_ntz', cast({moment} AS string), cast({utc_wall_clock(moment)} AS string))"
    return f"concat(replace({wall_clock}, ' ', 'T'), 'Z')"


def as_utc(moment: dt.datetime) -> dt.datetime:
    """Aware UTC datetime; a naive value is taken as UTC."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def moment_literal(df: DataFrame, column: str, moment: dt.datetime) -> Column:
    """Literal of the column's own timestamp type.

    A literal of the other type would put a cast around the column and keep the
    comparison out of the Parquet scan.
    """
    utc = as_utc(moment)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(utc.replace(tzinfo=None).isoformat()).cast("timestamp_ntz")
    return F.lit(utc.isoformat()).cast("timestamp")
