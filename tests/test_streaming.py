from __future__ import annotations

import json
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cordwood.operators.store import LogTable, read_logs
from cordwood.schemas import EVENT
from cordwood.sources.dead_letters import read_dead_letters
from cordwood.sources.lines import LogSource
from cordwood.sources.raw import read_raw_files
from cordwood.sources.requests import read_requests
from cordwood.streaming.jobs import COUNTED, collect, ingest, ingest_totals, parquet_rows, persist
from tests.samples import event, raw_frame

ONCE = {"availableNow": True}


def run(query):
    query.awaitTermination()
    return query


def observed(query, name: str) -> dict[str, int]:
    totals: dict[str, int] = {}
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        for key, value in (row.asDict() if row else {}).items():
            totals[key] = totals.get(key, 0) + value
    return totals


def persist_once(spark, tmp_path, checkpoint="checkpoint"):
    return run(
        persist(
            read_raw_files(spark, f"{tmp_path}/raw", max_files_per_trigger=1),
            LogTable(f"{tmp_path}/table", buckets=4),
            parquet_rows(f"{tmp_path}/dlq"),
            f"{tmp_path}/{checkpoint}",
            trigger=ONCE,
        )
    )


def add_raw(spark, tmp_path, payloads, partition=0):
    raw_frame(spark, payloads, partition=partition).coalesce(1).write.mode("append").parquet(
        f"{tmp_path}/raw"
    )


def test_duplicate_poison_and_barrier(spark, tmp_path):
    twice = event(id="twice")
    add_raw(spark, tmp_path, [twice, twice, "just words", event(id="barrier"), event(level="shouting")])
    query = persist_once(spark, tmp_path)
    assert observed(query, "records") == {
        "records": 5,
        "persisted": 3,
        "dead_lettered": 2,
        "malformed": 1,
        "invalid": 1,
    }
    table = LogTable(f"{tmp_path}/table")
    assert sorted(r.id for r in read_logs(spark, table).collect()) == ["barrier", "twice"]
    letters = read_dead_letters(spark, f"{tmp_path}/dlq")
    assert letters.count() == 2
    poison = letters.where("failure.code = 'malformed_event'").first()
    again = read_dead_letters(spark, f"{tmp_path}/dlq", "logs.raw", poison.payload_sha256)
    assert [r.original_offset for r in again.collect()] == [2]

    add_raw(spark, tmp_path, [dict(twice, message="changed"), event(id="more")], partition=1)
    persist_once(spark, tmp_path)
    rows = {r.id: r.message for r in read_logs(spark, table).collect()}
    assert rows == dict.fromkeys(["twice", "barrier", "more"], "posted entry 12")


def test_a_batch_whose_commit_was_lost_is_replayed_without_harm(spark, tmp_path):
    add_raw(spark, tmp_path, [event(id=str(n)) for n in range(20)] + ["just words"])
    persist_once(spark, tmp_path)
    table = LogTable(f"{tmp_path}/table")
    before = sorted(map(str, read_logs(spark, table).drop("attributes").collect()))
    # The checkpoint as it was before the batch was marked done.
    lost = shutil.ignore_patterns("commits")
    shutil.copytree(tmp_path / "checkpoint", tmp_path / "replayed", ignore=lost)
    persist_once(spark, tmp_path, "replayed")
    assert sorted(map(str, read_logs(spark, table).drop("attributes").collect())) == before
    letters = read_dead_letters(spark, f"{tmp_path}/dlq")
    assert letters.count() == 2 and letters.select("id").distinct().count() == 1


def test_lines_to_search(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "auth-1.log").write_text('{"level":"error","message":"failed login"}\nplain text\n\n')
    sources = [LogSource("auth", f"{logs}/auth-*.log", "json"), LogSource("pay", f"{logs}/pay-*.log")]

    def collect_once():
        return run(
            collect(
                spark,
                sources,
                f"{tmp_path}/landed",
                f"{tmp_path}/collected",
                host="h",
                agent="a",
                max_line_bytes=100,
                trigger=ONCE,
            )
        )

    first = collect_once()
    assert observed(first, "lines") == {
        "lines_read": 3,
        "oversized_lines_dropped": 0,
        "logs_dropped": 0,
        "blank_lines": 1,
        "events": 2,
    }
    (logs / "pay-1.log").write_text("paid\n" + "x" * 101 + "\n")
    second = collect_once()
    assert observed(second, "lines")["oversized_lines_dropped"] == 1
    landed = spark.read.schema(EVENT).parquet(f"{tmp_path}/landed")
    rows = {r.message: r for r in landed.collect()}
    assert sorted(rows) == ["failed login", "paid", "plain text"]
    assert rows["paid"].service == "pay" and rows["failed login"].level == "error"
    again = {r.message: r.id for r in landed.collect()}
    assert again == {m: r.id for m, r in rows.items()} and len(set(again.values())) == 3


def test_requests_to_raw_records(spark, tmp_path):
    bodies = [
        {"events": [event(id="a", level="WARNING"), event(id="b", level="shouting")]},
        {"events": []},
        {"events": [event(id="c")], "more": 1},
        {"events": [event(id="d")]},
    ]
    requests = tmp_path / "requests"
    requests.mkdir()
    (requests / "1.json").write_text(
        "\n".join(json.dumps({"request_id": str(n), "body": json.dumps(b)}) for n, b in enumerate(bodies))
    )
    query = run(
        ingest(
            read_requests(spark, str(requests), streaming=True),
            parquet_rows(f"{tmp_path}/published"),
            parquet_rows(f"{tmp_path}/results"),
            f"{tmp_path}/ingested",
            trigger=ONCE,
        )
    )
    assert observed(query, "ingest") == {"ingested_events": 2, "rejected_events": 1}
    results = {r.request_id: (r.status, r.accepted, r.rejected) for r in spark.read.parquet(f"{tmp_path}/results").collect()}
    assert results == {
        "0": ("accepted", 1, 1),
        "1": ("invalid_request", 0, 0),
        "2": ("invalid_json", 0, 0),
        "3": ("accepted", 1, 0),
    }
    published = spark.read.parquet(f"{tmp_path}/published")
    raw = published.select(
        "key",
        "value",
        F.lit("logs.raw").alias("topic"),
        F.lit(0).alias("partition"),
        F.monotonically_increasing_id().alias("offset"),
        "timestamp",
    )
    raw.write.parquet(f"{tmp_path}/raw")
    persist_once(spark, tmp_path)
    rows = {r.id: r.level for r in read_logs(spark, f"{tmp_path}/table").collect()}
    assert rows == {"a": "warn", "d": "info"}


def test_counts_survive_a_failing_publish(spark, tmp_path):
    bodies = [{"events": [event(id="a"), event(id="b", level="shouting")]}, {"events": [event(id="c", service="")]}]
    requests = tmp_path / "requests"
    requests.mkdir()
    (requests / "1.json").write_text(
        "\n".join(json.dumps({"request_id": str(n), "body": json.dumps(b)}) for n, b in enumerate(bodies))
    )

    def fail(rows):
        raise RuntimeError("no broker")

    def attempt(publish):
        return ingest(
            read_requests(spark, str(requests), streaming=True),
            publish,
            parquet_rows(f"{tmp_path}/results"),
            f"{tmp_path}/ingested",
            trigger=ONCE,
            counters=f"{tmp_path}/counters",
        )

    def totals():
        return ingest_totals(spark.read.schema(COUNTED).parquet(f"{tmp_path}/counters")).first().asDict()

    for _ in range(2):
        with pytest.raises(StreamingQueryException, match="no broker"):
            attempt(fail).awaitTermination()
        assert totals() == {"ingested_events": 0, "rejected_events": 2}
    run(attempt(parquet_rows(f"{tmp_path}/published")))
    assert totals() == {"ingested_events": 1, "rejected_events": 2}
    assert spark.read.parquet(f"{tmp_path}/published").count() == 1
