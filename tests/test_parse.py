from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cordwood.operators.parse import line_quality, parse_lines, prepare_lines
from cordwood.sources.lines import LogSource, read_lines, with_source
from tests.samples import NOON


def parsed(spark, rows, fmt="json", **options):
    lines = spark.createDataFrame(
        [(bytearray(r) if isinstance(r, bytes) else bytearray(r.encode()), "api", "api.log", fmt) for r in rows],
        "value binary, service string, file string, format string",
    ).withColumn("value", F.col("value").cast("string"))
    events = parse_lines(lines, now=F.lit(NOON), host="h", agent="a", **options)
    return events.withColumn("attributes", F.to_json("attributes")).collect()


def test_json_line(spark):
    (row,) = parsed(
        spark,
        ['{"shard":7,"severity":" Warning","msg":"disk 91% full","time":"2031-03-07T20:15:00Z","tags":["a"]}'],
    )
    assert (row.level, row.message, row.schema_version) == ("warn", "disk 91% full", 1)
    assert row.attributes == '{"shard":7,"tags":["a"]}'
    assert row.id and row.source == {"file": "api.log", "host": "h", "agent": "a"}
    assert row.timestamp == dt.datetime(2031, 3, 7, 20, 15)


def test_plain_line_keeps_its_spaces(spark):
    (row,) = parsed(spark, ["\t cache warm;  3 keys "], "plain")
    assert (row.level, row.message, row.attributes) == ("info", "\t cache warm;  3 keys ", "{}")


def test_plain_format_never_reads_json(spark):
    (row,) = parsed(spark, ['{"message":"m"}'], "plain")
    assert row.message == '{"message":"m"}'


@pytest.mark.parametrize(
    "line",
    [
        '{"msg":"half a li',
        '["message"]',
        "42",
        "null",
        '{"message":"a"} {"message":"b"}',
        '{"message":"a"}],[{"message":"b"}',
        "{'message':'a'}",
        '{"message":NaN}',
    ],
)
def test_what_is_not_one_object_is_plain_text(spark, line):
    (row,) = parsed(spark, [line])
    assert (row.message, row.level, row.attributes) == (line, "info", "{}")


def test_values_of_other_types_stay_attributes(spark):
    line = '{"level":["loud"],"message":{"text":"full"},"timestamp":false}'
    (row,) = parsed(spark, [line])
    assert (row.level, row.message) == ("info", line)
    assert row.attributes == line


def test_first_string_wins_and_the_loser_stays(spark):
    rows = parsed(
        spark,
        [
            '{"level":"warn","severity":"error","message":"a","msg":"b"}',
            '{"level":5,"severity":"ERROR","message":null,"msg":"b"}',
            '{"message":"","msg":"b"}',
            '{"message":"first","message":"last"}',
        ],
    )
    assert [(r.level, r.message, r.attributes) for r in rows] == [
        ("warn", "a", '{"msg":"b","severity":"error"}'),
        ("error", "b", '{"level":5,"message":null}'),
        ("info", "", '{"msg":"b"}'),
        ("info", "last", "{}"),
    ]


def test_bad_time_is_used_up(spark):
    rows = parsed(
        spark,
        [
            '{"timestamp":"yesterday","time":"2026-01-01T00:00:00Z"}',
            '{"timestamp":7,"time":"2026-01-01t00:00:00.123456789z"}',
            '{"time":"2026-01-01 02:00:00+02:00"}',
            '{"time":"2026-01-01"}',
        ],
    )
    assert rows[0].timestamp == NOON.replace(tzinfo=None)
    assert rows[0].attributes == '{"time":"2026-01-01T00:00:00Z"}'
    assert rows[1].timestamp == dt.datetime(2026, 1, 1, 0, 0, 0, 123456)
    assert rows[2].timestamp == dt.datetime(2026, 1, 1)
    assert rows[3].timestamp == NOON.replace(tzinfo=None)


def test_lenient_levels(spark):
    rows = parsed(spark, ['{"level":"%s"}' % x for x in ("WARNING", " Fatal ", "critical", "")])
    assert [r.level for r in rows] == ["warn", "fatal", "info", "info"]


def test_only_the_line_ending_is_stripped(spark):
    rows = parsed(spark, [" tail of x \r", "a\r\r", "\r", "   ", "  "], "plain")
    assert [r.message for r in rows] == [" tail of x ", "a\r"]


def test_broken_utf8_is_replaced(spark):
    (row,) = parsed(spark, [b"a\xffb"], "plain")
    assert row.message == "a�b"


def test_the_limit_counts_bytes_and_is_inclusive(spark):
    lines = spark.createDataFrame(
        [("éé\r",), ("ééx",), ("abcd",), ("abcde",), (" ",)], "value string"
    )
    counts = line_quality(lines, 4).first().asDict()
    assert counts == {
        "lines_read": 5,
        "oversized_lines_dropped": 2,
        "logs_dropped": 2,
        "blank_lines": 1,
        "events": 2,
    }
    assert prepare_lines(lines, 4).where("oversized").count() == 2


def test_read_lines_of_several_sources(spark, tmp_path):
    (tmp_path / "auth 1.log").write_bytes(b'{"message":"a"}\r\nlast line')
    (tmp_path / "pay-1.log").write_bytes(b"one\rstill one\n")
    (tmp_path / "pay-2.log").write_bytes(b"two\n")
    (tmp_path / "pay-x").mkdir()
    (tmp_path / "pay-x" / "old.log").write_bytes(b"deep\n")
    sources = [
        LogSource("auth", f"{tmp_path}/auth 1.log", "json"),
        LogSource("pay", f"file://{tmp_path}/pay-*.log"),
        LogSource("deep", f"{tmp_path}/pay-[w-z]/{{old,new}}.log"),
    ]
    rows = sorted(read_lines(spark, sources).select("service", "format", "value", "file").collect())
    assert [(r.service, r.format, r.value) for r in rows] == [
        ("auth", "json", "last line"),
        ("auth", "json", '{"message":"a"}\r'),
        ("deep", "plain", "deep"),
        ("pay", "plain", "one\rstill one"),
        ("pay", "plain", "two"),
    ]
    assert {r.file for r in rows} == {s.path for s in sources}
    with pytest.raises(ValueError):
        LogSource("x", "y", "xml")


def test_many_sources_are_looked_up_without_patterns(spark, tmp_path):
    for n in range(0, 200, 40):
        folder = tmp_path / f"s{n}"
        folder.mkdir()
        (folder / f"app-{n}.log").write_text(f"line {n}\n")
        (folder / "app-.log").write_text("short\n")
        (folder / "other.log").write_text("other\n")
    sources = [LogSource(f"svc-{n}", f"{tmp_path}/s{n // 2 * 2}/{'app-*.log' if n % 2 else 'other.log'}") for n in range(200)]
    lines = read_lines(spark, [s for s in sources if int(s.path.split("/s")[-1].split("/")[0]) % 40 == 0])
    found = sorted((r.service, r.value) for r in lines.select("service", "value").collect())
    expected = [(f"svc-{n}", "other") for n in range(0, 200, 40)]
    expected += [(f"svc-{n + 1}", v) for n in range(0, 200, 40) for v in (f"line {n}", "short")]
    assert found == sorted(expected)
    text = spark.createDataFrame([("x", f"{tmp_path}/s40/app-40.log")], "value string, _file string")
    sources.append(LogSource("late", f"{tmp_path}/s40/app-40.log"))
    located = with_source(spark, text, sources)
    assert [r["_source"]["service"] for r in located.collect()] == ["svc-41"]
    plan = located._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("start", [b"\xc3", b"\xe2", b"\xe2\x82", b"\xf0", b"\xf0\x9f\x98"])
def test_a_cut_character_before_the_carriage_return(spark, start):
    """Only the carriage return goes; what stands before it is repaired, not lost."""
    rows = parsed(spark, [b"caf" + start + b"\r", start + b"\r", start, b"ok\r"], "plain")
    assert [r.message for r in rows] == ["caf\ufffd", "\ufffd", "\ufffd", "ok"]


def test_half_a_surrogate_pair_makes_a_line_plain(spark):
    lines = [r'{"msg":"a\ud83d"}', r'{"msg":"a\udc00b"}', r'{"msg":"\ud83d\ude00"}', r'{"msg":"\\ud83d"}']
    rows = parsed(spark, lines)
    assert [r.message for r in rows] == [lines[0], lines[1], "\U0001f600", r"\ud83d"]
