from __future__ import annotations

import base64
import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from cordwood.functions.cursors import PageCursor, decode_cursor, encode_cursor
from cordwood.operators.pages import append_unique, page_numbers
from cordwood.operators.search import (
    SearchParams,
    fetch_page,
    matching,
    page_limit,
    parse_params,
    search,
    walk_pages,
)
from tests.samples import UTC


def coded(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).rstrip(b"=").decode()


@pytest.mark.parametrize(
    "hours, moment, text",
    [
        (5.5, (2019, 2, 28, 23, 59, 59, 999999), "2019-02-28T18:29:59.999999Z"),
        (-11, (1999, 12, 31, 18, 0, 0, 0), "2000-01-01T05:00:00Z"),
        (0, (2040, 6, 1, 0, 0, 7, 500000), "2040-06-01T00:00:07.5Z"),
    ],
)
def test_cursor_round_trip(hours, moment, text):
    """Any zone goes in; UTC with the shortest fraction is written and read."""
    zone = dt.timezone(dt.timedelta(hours=hours))
    given = PageCursor(dt.datetime(*moment, tzinfo=zone), "größe/7")
    encoded = encode_cursor(given)
    assert decode_cursor(encoded) == PageCursor(dt.datetime(*moment, tzinfo=zone).astimezone(UTC), "größe/7")
    assert json.loads(base64.urlsafe_b64decode(encoded + "==")) == {"v": 1, "t": text, "i": "größe/7"}


def test_no_cursor():
    assert encode_cursor(None) == ""
    assert decode_cursor("\t ") is None and decode_cursor("") is None


GOOD_CURSOR = {"v": 1, "t": "2033-11-05T08:30:00Z", "i": "k"}


@pytest.mark.parametrize(
    "raw",
    [
        "%%%",
        coded(json.dumps({k: v for k, v in GOOD_CURSOR.items() if k != "i"})),
        coded(json.dumps({k: v for k, v in GOOD_CURSOR.items() if k != "v"})),
        coded(json.dumps(GOOD_CURSOR | {"v": 7})),
        coded(json.dumps(GOOD_CURSOR | {"v": False})),
        coded(json.dumps(GOOD_CURSOR | {"page": 3})),
        coded(json.dumps(GOOD_CURSOR) + "[1]"),
        coded(json.dumps(GOOD_CURSOR | {"t": "noon"})),
        coded(json.dumps(GOOD_CURSOR | {"t": "0001-01-01T00:00:00Z"})),
        coded(json.dumps(GOOD_CURSOR | {"i": "\n"})),
        coded(json.dumps(GOOD_CURSOR | {"i": "ü" * 65}, ensure_ascii=False)),
        coded(json.dumps([GOOD_CURSOR])),
        coded("null"),
        "B" * 600,
    ],
)
def test_bad_cursors(raw):
    assert decode_cursor(coded(json.dumps(GOOD_CURSOR))).id == "k"
    with pytest.raises(ValueError, match="invalid cursor"):
        decode_cursor(raw)


def test_parameters_are_normalised():
    cursor = PageCursor(dt.datetime(2030, 1, 2, 3, 4, 5, tzinfo=UTC), "row-9")
    given = {"q": "\tdisk  full\n", "level": " Fatal", "limit": "+7", "cursor": encode_cursor(cursor)}
    given |= {"service": ["gate way"], "start": "2030-01-01T23:30:00+05:45", "end": "2030-01-01T17:45:00.25Z"}
    assert parse_params(given) == SearchParams(
        service="gate way",
        level="fatal",
        query="disk  full",
        start=dt.datetime(2030, 1, 1, 17, 45, tzinfo=UTC),
        end=dt.datetime(2030, 1, 1, 17, 45, 0, 250000, tzinfo=UTC),
        limit=7,
        cursor=cursor,
    )
    assert parse_params({"level": "wArNiNg"}).level == "warn"
    assert parse_params({}) == SearchParams(limit=100)


BAD_PARAMETERS = {
    "limit must be between 1 and 500": [{"limit": v} for v in ("1000", "-3", "2.5", "٣", "1e2")],
    "service exceeds 256 bytes": [{"service": "漢" * 86}],
    "q exceeds 256 bytes": [{"q": "ab" * 129}],
    "start must be RFC3339": [{"start": v} for v in ("2031-05-06 07:08:09", "1700000000", "2031-13-01T00:00:00Z")],
    "end must be RFC3339": [{"end": "tomorrow"}],
    "start must not be after end": [{"start": "2031-05-06T00:00:01Z", "end": "2031-05-06T02:00:00+02:00"}],
    "invalid cursor": [{"cursor": "page two"}],
    'unsupported query parameter "sort"': [{"sort": "id"}],
    'query parameter "q" must appear once': [{"q": []}, {"q": ["a", "a", "a"]}],
    "level is unsupported": [{"level": "loud"}],
}


@pytest.mark.parametrize("parameters, message", [(p, m) for m, many in BAD_PARAMETERS.items() for p in many])
def test_bad_parameters(parameters, message):
    with pytest.raises(ValueError, match=message):
        parse_params(parameters)


def test_the_store_falls_back_to_its_own_page_size():
    assert [page_limit(n) for n in (-1, 0, 1, 500, 501)] == [100, 100, 1, 500, 100]


ROWS = [
    (f"id-{n:03d}", f"svc-{n % 3}", ("info", "error")[n % 2], f"user {n} logged in", n // 4)
    for n in range(60)
]


@pytest.fixture(scope="module")
def logs(spark):
    frame = spark.createDataFrame(ROWS, "id string, service string, level string, message string, n long")
    moment = F.expr("timestamp'2026-03-01 00:00:00' + make_dt_interval(0, n * 7, 0, 0)")
    frame = frame.withColumn("timestamp", moment).withColumn("event_date", F.to_date("timestamp"))
    return frame.drop("n").cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_bounds_are_inclusive_and_none_means_all(logs):
    assert matching(logs, SearchParams()).count() == 60
    start = dt.datetime(2026, 3, 1, 7, tzinfo=UTC)
    end = dt.datetime(2026, 3, 1, 14, tzinfo=UTC)
    assert sorted(ids(matching(logs, SearchParams(start=start, end=end)))) == [
        f"id-{n:03d}" for n in range(4, 12)
    ]


def test_equality_filters(logs):
    found = matching(logs, SearchParams(service="svc-1", level=" ERROR "))
    assert sorted(ids(found)) == [r[0] for r in ROWS if r[1] == "svc-1" and r[2] == "error"]
    assert matching(logs, SearchParams(service="SVC-1")).count() == 0


def test_text_filter(logs):
    assert sorted(ids(matching(logs, SearchParams(query="the users logging 7")))) == ["id-007"]
    assert matching(logs, SearchParams(query="the of")).count() == 0
    assert matching(logs, SearchParams(query="use")).count() == 0
    assert matching(logs, SearchParams(query="'; DROP TABLE logs --")).count() == 0


EXPECTED = [r[0] for r in sorted(ROWS, key=lambda r: (r[4], r[0]), reverse=True)]


@pytest.mark.parametrize("partitioned", [True, False])
def test_pages_have_no_gaps_and_no_repeats(logs, partitioned):
    table = logs if partitioned else logs.drop("event_date")
    today = dt.date(2026, 3, 5)
    walked = list(walk_pages(table, SearchParams(limit=13), today))
    assert [len(page) for page in walked] == [13, 13, 13, 13, 8]
    assert [row.id for page in walked for row in page] == EXPECTED


def test_a_full_last_page_has_no_next(logs):
    rows, cursor = fetch_page(logs, SearchParams(limit=60), dt.date(2020, 1, 1))
    assert [r.id for r in rows] == EXPECTED and cursor == ""
    assert list(rows[0].asDict()) == ["id", "service", "level", "message", "timestamp"]
    rows, cursor = fetch_page(logs, SearchParams(limit=59), dt.date(2027, 1, 1))
    assert [r.id for r in rows] == EXPECTED[:59] and decode_cursor(cursor).id == EXPECTED[58]


def test_pages_respect_time_bounds(logs):
    start, end = (dt.datetime(2026, 3, d, tzinfo=UTC) for d in (2, 4))
    params = SearchParams(limit=5, start=start, end=end)
    walked = [r.id for page in walk_pages(logs, params, dt.date(2026, 3, 6)) for r in page]
    wanted = [r.id for r in logs.where("timestamp between '2026-03-02' and '2026-03-04'").collect()]
    assert sorted(walked) == sorted(wanted) and len(walked) > 5


def test_cursors_do_not_depend_on_the_zone_of_the_machine(logs, monkeypatch):
    def cursors():
        page = search(logs, SearchParams(limit=7)).next_cursor()
        return page, [fetch_page(t, SearchParams(limit=7))[1] for t in (logs, logs.drop("event_date"))]

    here = cursors()
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        assert cursors() == here and here[1][0] == here[1][1] == encode_cursor(here[0])
    finally:
        monkeypatch.undo()
        time.tzset()


def test_search_gives_a_page_and_the_next_cursor(logs):
    page = search(logs, SearchParams(level="error", limit=10))
    assert page.items.count() == 10
    errors = [i for i in EXPECTED if int(i[3:]) % 2]
    assert ids(page.items) == errors[:10] and page.next_cursor().id == errors[9]
    assert search(logs, SearchParams(level="error", limit=30)).next_cursor() is None


def test_page_numbers_with_one_hot_time(spark):
    hot = spark.range(3000).select(
        F.concat(F.lit("id-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"),
        F.expr("timestamp'2026-01-01' + make_dt_interval(0, 0, if(id % 3 = 0, 0, cast(id AS int)), 0)").alias(
            "timestamp"
        ),
    )
    rows = sorted(page_numbers(hot, 50).collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in rows] == list(range(1, 3001))
    order = [(r.timestamp, r.id) for r in rows]
    assert order == sorted(order, reverse=True)
    assert [r.page_no for r in rows] == [n // 50 + 1 for n in range(3000)]


def test_page_numbers_divide_a_hot_second_and_keep_rows_without_time(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("id-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"),
        F.when(F.col("id") % 10 == 0, None)
        .when(F.col("id") % 3 == 0, F.lit("2026-01-01").cast("timestamp"))
        .otherwise(F.expr("timestamp'2026-01-01' + make_dt_interval(0, 0, 0, cast(id AS int))"))
        .alias("timestamp"),
    )
    numbered = page_numbers(rows, 50)
    found = sorted(numbered.collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in found] == list(range(1, 4001))
    assert all(r.timestamp is None for r in found[3600:]) and found[3599].timestamp is not None
    ids = [r.id for r in found[3600:]]
    assert ids == sorted(ids, reverse=True)
    hot = numbered.where("timestamp = '2026-01-01'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot > 1
    assert page_numbers(rows.where("false")).count() == 0


def test_append_unique_keeps_what_is_shown(spark):
    def frame(rows):
        text = spark.createDataFrame(rows, "id string, message string, t string")
        return text.select("id", "message", F.col("t").cast("timestamp").alias("timestamp"))

    shown = frame([("a", "old", "2026-01-03"), ("b", "old", "2026-01-02")])
    more = frame([("b", "new", "2026-01-02"), ("c", "late", "2026-01-02"), ("c", "early", "2026-01-01")])
    assert sorted((r.id, r.message) for r in append_unique(shown, more).collect()) == [
        ("a", "old"),
        ("b", "old"),
        ("c", "late"),
    ]
