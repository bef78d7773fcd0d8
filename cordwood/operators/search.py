"""Filtered search over stored logs with keyset pages, newest first."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.cursors import PageCursor, decode_cursor, encode_cursor, parse_moment
from cordwood.functions.fulltext import query_terms, where_terms, where_text
from cordwood.functions.times import UTC, as_utc, moment_literal
from cordwood.operators.store import LogTable, read_logs, read_term_hours, read_totals
from cordwood.operators.terms import hours_of, within_hours
from cordwood.operators.totals import rows_by_day
from cordwood.schemas import DEFAULT_PAGE, LEVELS, MAX_FILTER_BYTES, MAX_PAGE, RECORD_FIELDS

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)
_PARAMETERS = ("service", "level", "q", "start", "end", "limit", "cursor")


@dataclass(frozen=True)
class SearchParams:
    service: str = ""
    level: str = ""
    query: str = ""
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    limit: int = 0
    cursor: PageCursor | None = None


def _level_name(level: str) -> str:
    folded = level.strip().lower()
    return "warn" if folded == "warning" else folded


def parse_params(
    parameters: Mapping[str, str | Sequence[str]],
    default_page: int = DEFAULT_PAGE,
    max_page: int = MAX_PAGE,
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> SearchParams:
    """Check search parameters given as text; ``ValueError`` names the first bad one."""
    given: dict[str, str] = {}
    for name, value in parameters.items():
        if name not in _PARAMETERS:
            raise ValueError(f'unsupported query parameter "{name}"')
        values = [value] if isinstance(value, str) else list(value)
        if len(values) != 1:
            raise ValueError(f'query parameter "{name}" must appear once')
        given[name] = values[0]

    limit = default_page
    raw_limit = given.get("limit", "")
    if raw_limit.strip():
        digits = raw_limit.removeprefix("+")
        limit = int(digits) if digits.isascii() and digits.isdigit() else 0
        if not 0 < limit <= max_page:
            raise ValueError(f"limit must be between 1 and {max_page}")

    bounded = {}
    for name in ("service", "q"):
        bounded[name] = given.get(name, "").strip()
        if len(bounded[name].encode()) > max_filter_bytes:
            raise ValueError(f"{name} exceeds {max_filter_bytes} bytes")

    bounds: dict[str, dt.datetime | None] = {}
    for name in ("start", "end"):
        text = given.get(name, "")
        try:
            bounds[name] = parse_moment(text) if text.strip() else None
        except ValueError:
            raise ValueError(f"{name} must be RFC3339") from None
    if bounds["start"] and bounds["end"] and bounds["start"] > bounds["end"]:
        raise ValueError("start must not be after end")

    cursor = decode_cursor(given.get("cursor"))
    level = _level_name(given.get("level", ""))
    if level and level not in LEVELS:
        raise ValueError("level is unsupported")
    return SearchParams(
        service=bounded["service"],
        level=level,
        query=bounded["q"],
        start=bounds["start"],
        end=bounds["end"],
        limit=limit,
        cursor=cursor,
    )


def page_limit(limit: int) -> int:
    """The store falls back to the default page where the caller gives no usable limit."""
    return limit if 0 < limit <= MAX_PAGE else DEFAULT_PAGE


def _time_bounds(df: DataFrame, params: SearchParams) -> list[Column]:
    moment = F.col("timestamp")
    tests = []
    if params.start is not None:
        tests.append(moment >= moment_literal(df, "timestamp", params.start))
    if params.end is not None:
        tests.append(moment <= moment_literal(df, "timestamp", params.end))
    if params.cursor is not None and not params.cursor.is_zero():
        # (timestamp, id) < cursor in a form that reaches the Parquet scan.
        last = moment_literal(df, "timestamp", params.cursor.timestamp)
        tests.append(moment <= last)
        tests.append((moment < last) | (F.col("id") < params.cursor.id))
    return tests


def _date_bounds(df: DataFrame, params: SearchParams) -> list[Column]:
    """The same bounds on the partition column, so whole days are never listed."""
    if "event_date" not in df.columns:
        return []
    day = F.col("event_date")
    tests = []
    if params.start is not None:
        tests.append(day >= F.lit(as_utc(params.start).date()))
    ends = [params.end]
    if params.cursor is not None and not params.cursor.is_zero():
        ends.append(params.cursor.timestamp)
    tests.extend(day <= F.lit(as_utc(end).date()) for end in ends if end is not None)
    return tests


def matching(df: DataFrame, params: SearchParams) -> DataFrame:
    """Rows that pass every given filter; without filters all rows."""
    tests = _date_bounds(df, params) + _time_bounds(df, params)
    if params.service:
        tests.append(F.col("service") == params.service)
    if params.level:
        tests.append(F.col("level") == _level_name(params.level))
    found = df.where(reduce(and_, tests)) if tests else df
    if params.query:
        wanted = query_terms(df.sparkSession, params.query)
        if "message_terms" in df.columns:
            found = where_terms(found, "message_terms", "message", wanted)
        else:
            found = where_text(found, "message", wanted)
    return found


def newest_first(df: DataFrame, rows: int) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("id")).limit(rows)


@dataclass(frozen=True)
class SearchPage:
    """A page as a lazy frame; the next cursor is looked up when asked for."""

    items: DataFrame
    one_more: DataFrame
    limit: int

    def next_cursor(self) -> PageCursor | None:
        """Position of the last row when a further row exists (at most 501 rows)."""
        keys = self.one_more.select("id", _instant(self.one_more).alias("_instant"))
        return _next_cursor(keys.collect(), self.limit)


def _instant(df: DataFrame) -> Column:
    """The time of a row in a form that collects the same in every time zone.

    A timestamp with time zone reaches Python in the zone of the machine, so
    it is carried as microseconds; one without is UTC wall-clock time here.
    """
    moment = F.col("timestamp")
    is_wall_clock = isinstance(df.schema["timestamp"].dataType, T.TimestampNTZType)
    return moment if is_wall_clock else F.unix_micros(moment)


def _next_cursor(rows: list[Row], limit: int) -> PageCursor | None:
    if len(rows) <= limit:
        return None
    last = rows[limit - 1]
    instant = last["_instant"]
    if isinstance(instant, int):
        instant = _EPOCH + dt.timedelta(microseconds=instant)
    return PageCursor(as_utc(instant), last["id"])


def _without_instant(rows: list[Row]) -> list[Row]:
    if not rows:
        return []
    shape = Row(*rows[0].__fields__[:-1])
    return [shape(*row[:-1]) for row in rows]


def record_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in RECORD_FIELDS if c in df.columns])


def search(df: DataFrame, params: SearchParams) -> SearchPage:
    """One page of matching records."""
    limit = page_limit(params.limit)
    found = record_columns(matching(df, params))
    return SearchPage(newest_first(found, limit), newest_first(found, limit + 1), limit)


#: Days in the second step of a search over stored days.
_SECOND_STEP = 31


def _stored_windows(days: Sequence[dt.date], enough: int) -> Iterator[tuple[dt.date | None, dt.date | None]]:
    """``[low, high)`` day ranges over the days that exist: the newest ``enough``, the next
    month of them, then all others."""
    days = sorted(days, reverse=True)
    high: dt.date | None = None
    at = 0
    for size in (max(enough, 1), _SECOND_STEP):
        step = days[at : at + size]
        if step:
            yield step[-1], high
            high, at = step[-1], at + size
    if days[at:]:
        yield None, high


def _day_windows(params: SearchParams, today: dt.date) -> Iterator[tuple[dt.date | None, dt.date | None]]:
    """``[low, high)`` day ranges from the newest back, doubling in length, the last unbounded."""
    known_end = min(
        (
            as_utc(m).date()
            for m in (params.end, params.cursor.timestamp if params.cursor else None)
            if m is not None
        ),
        default=None,
    )
    first = min(known_end, today) if known_end else today
    floor = as_utc(params.start).date() if params.start else None
    high: dt.date | None = None
    days = 1
    low = first
    while days <= 8192 and low > dt.date(1970, 1, 1):
        yield low, high
        if floor and low <= floor:
            return
        high, low = low, low - dt.timedelta(days=days)
        days *= 2
    yield None, high


def fetch_page(
    logs: DataFrame,
    params: SearchParams,
    today: dt.date | None = None,
    windows: Iterator[tuple[dt.date | None, dt.date | None]] | None = None,
) -> tuple[list[Row], str]:
    """Rows of one page and the encoded next cursor, reading recent days first.

    For a table partitioned by ``event_date`` the newest days are searched
    before older ones and the search stops once the page is full, so the first
    page of a long history reads a day or two of it. At most limit + 1 rows
    reach the driver. ``windows`` gives the ranges of days to go through, where
    the days that exist are known.
    """
    limit = page_limit(params.limit)
    if "event_date" not in logs.columns:
        one_more = search(logs, params).one_more
        rows = one_more.withColumn("_instant", _instant(logs)).collect()
        return _without_instant(rows[:limit]), encode_cursor(_next_cursor(rows, limit))
    rows: list[Row] = []
    today = today or dt.datetime.now(UTC).date()
    for low, high in _day_windows(params, today) if windows is None else windows:
        window = logs
        if low is not None:
            window = window.where(F.col("event_date") >= F.lit(low))
        if high is not None:
            window = window.where(F.col("event_date") < F.lit(high))
        found = record_columns(matching(window, params))
        newest = newest_first(found, limit + 1 - len(rows))
        rows += newest.withColumn("_instant", _instant(logs)).collect()
        if len(rows) > limit:
            break
    return _without_instant(rows[:limit]), encode_cursor(_next_cursor(rows, limit))


def fetch_stored_page(spark: SparkSession, table: LogTable | str, params: SearchParams) -> tuple[list[Row], str]:
    """A page from a stored table, by its counts and its index of terms.

    A text is looked up in the index first, and only the hours where all its terms occur are
    read. Days come from the counts of the table, so empty days take no job: a first step over
    the newest days that hold a page without filters, then a month, then the rest.
    """
    logs = read_logs(spark, table)
    totals, index = read_totals(spark, table), read_term_hours(spark, table)
    if totals is None:
        return fetch_page(logs, params)
    stored = rows_by_day(totals)
    for test in _date_bounds(stored, params):
        stored = stored.where(test)
    # One row for each stored day.
    days = {row["event_date"]: row["rows"] for row in stored.collect()}
    wanted = query_terms(spark, params.query) if params.query else []
    if wanted:
        hours = hours_of(index, wanted)
        for test in _date_bounds(hours, params):
            hours = hours.where(test)
        found = [tuple(row) for row in hours.collect()]
        logs = within_hours(logs, found)
        days = {day: days.get(day, 0) for day in {day for day, _ in found}}
    limit, enough, rows = page_limit(params.limit), 0, 0
    for day in sorted(days, reverse=True):
        enough, rows = enough + 1, rows + days[day]
        if rows > limit:
            break
    return fetch_page(logs, params, windows=_stored_windows(list(days), enough))


def walk_pages(
    logs: DataFrame, params: SearchParams, today: dt.date | None = None
) -> Iterator[list[Row]]:
    """All pages one after the other, for a reader who scrolls to the end."""
    while True:
        rows, cursor = fetch_page(logs, params, today)
        if rows:
            yield rows
        if not cursor:
            return
        params = replace(params, cursor=decode_cursor(cursor))


def delivery_counts(logs: DataFrame, ids: Mapping[str, str]) -> DataFrame:
    """One row with the number of stored rows per named id."""
    return logs.where(F.col("id").isin(*ids.values())).agg(
        *[F.count_if(F.col("id") == key).alias(name) for name, key in ids.items()]
    )
