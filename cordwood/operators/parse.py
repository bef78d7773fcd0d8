"""Log lines to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.levels import lenient_level
from cordwood.functions.once import with_once
from cordwood.functions.strict_json import NO_FIELDS, kind, text_of, with_fields, without_lone_surrogates
from cordwood.functions.text import is_blank, lossy_utf8, strip_carriage_return
from cordwood.functions.times import parse_rfc3339_lenient
from cordwood.schemas import EVENT_FIELDS, MAX_LINE_BYTES, SCHEMA_VERSION
from cordwood.sources.lines import JSON

_LEVEL_KEYS = ("level", "severity")
_MESSAGE_KEYS = ("message", "msg")
_TIME_KEYS = ("timestamp", "time")
_KEYS = (_LEVEL_KEYS, _MESSAGE_KEYS, _TIME_KEYS)
_ALL_KEYS = _LEVEL_KEYS + _MESSAGE_KEYS + _TIME_KEYS


def prepare_lines(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Strip the line ending and flag what the collector drops.

    The limit counts bytes after stripping and before the repair of broken
    UTF-8; a line of exactly the limit is kept.
    """
    stripped = with_once(lines, "_line", F.expr(strip_carriage_return("value")))
    repaired = stripped.withColumn("value", F.col("_line")).drop("_line")
    repaired = repaired.withColumn(
        "oversized", F.octet_length("value") > max_line_bytes
    ).withColumn("value", F.expr(lossy_utf8("value")))
    return repaired.withColumn("blank", F.expr(is_blank("value")))


def line_counters() -> list[Column]:
    """Aggregates over :func:`prepare_lines`; every line read counts, dropped or not."""
    oversized, blank = F.col("oversized"), F.col("blank")
    return [
        F.count(F.lit(1)).alias("lines_read"),
        F.count_if(oversized).alias("oversized_lines_dropped"),
        F.count_if(oversized).alias("logs_dropped"),
        F.count_if(~oversized & blank).alias("blank_lines"),
        F.count_if(~oversized & ~blank).alias("events"),
    ]


def line_quality(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """One row of collector counters."""
    return prepare_lines(lines, max_line_bytes).agg(*line_counters())


def parse_prepared(
    prepared: DataFrame,
    host: str = "unknown",
    agent: str = "agent",
    now: Column | None = None,
    event_id: Column | None = None,
) -> DataFrame:
    """Events of prepared lines, followed by the other columns of the input.

    A JSON line must be one object; anything else is kept as a plain line.
    ``event_id`` defaults to a random UUID, so land the result before it is
    read twice.
    """
    now = F.current_timestamp() if now is None else now
    event_id = F.uuid() if event_id is None else event_id
    used = ("value", "service", "file", "format", "oversized", "blank")
    extra = [c for c in prepared.columns if c not in used]

    lines = prepared.where(~F.col("oversized") & ~F.col("blank"))
    opened = with_fields(lines, "_fields", f"if(format = '{JSON}', {without_lone_surrogates('value')}, NULL)")
    kinds = ", ".join(f"{kind(f'_fields.`{key}`')} AS `{key}`" for key in _ALL_KEYS)
    opened = with_once(opened, "_opened", F.expr(f"struct(_fields, struct({kinds}) AS kinds)"))

    def first(keys: tuple[str, ...], value) -> str:
        """``value`` of the first key that holds a JSON string."""
        cases = " ".join(f"WHEN _opened.kinds.`{k}` = 'STRING' THEN {value(k)}" for k in keys)
        return f"CASE {cases} END"

    def text(key: str) -> str:
        return text_of(f"_opened._fields.`{key}`")

    taken = ", ".join(first(keys, "'{}'".format) for keys in _KEYS)
    picked = opened.select(
        *extra,
        "value",
        "service",
        "file",
        F.col("_opened._fields").alias("_fields"),
        F.expr(first(_LEVEL_KEYS, text)).alias("_level"),
        F.expr(first(_MESSAGE_KEYS, text)).alias("_message"),
        F.expr(first(_TIME_KEYS, text)).alias("_time"),
        F.expr(f"array_compact(array({taken}))").alias("_taken"),
    )
    rest = f"coalesce(map_filter(_fields, (k, v) -> NOT array_contains(_taken, k)), {NO_FIELDS})"
    source = F.create_map(
        *[F.lit("agent"), F.lit(agent), F.lit("file"), F.col("file"), F.lit("host"), F.lit(host)]
    )
    return picked.select(
        F.lit(SCHEMA_VERSION).cast("long").alias("schema_version"),
        event_id.alias("id"),
        "service",
        F.expr(lenient_level("_level")).alias("level"),
        F.coalesce("_message", "value").alias("message"),
        F.coalesce(parse_rfc3339_lenient(F.col("_time")), now).alias("timestamp"),
        F.expr(f"to_variant_object({rest})").alias("attributes"),
        source.alias("source"),
        *extra,
    )


def parse_lines(lines: DataFrame, max_line_bytes: int = MAX_LINE_BYTES, **options) -> DataFrame:
    """``value, service, file, format`` lines to events (see :func:`parse_prepared`)."""
    return parse_prepared(prepare_lines(lines, max_line_bytes), **options)


def events_only(events: DataFrame) -> DataFrame:
    return events.select(*EVENT_FIELDS)
