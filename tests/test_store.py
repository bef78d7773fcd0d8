from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cordwood.functions.times import format_rfc3339
from cordwood.operators import store, terms, totals
from cordwood.operators.firstwins import first_per_key
from cordwood.operators.quality import constraint_violations, contract_violations, summary_contract
from cordwood.operators.search import SearchParams, delivery_counts, fetch_page, fetch_stored_page
from cordwood.operators.store import LogTable, insert_logs, read_logs, read_term_hours, read_totals
from cordwood.operators.summary import services, summary
from cordwood.operators.validate import classify, valid_events
from tests.samples import UTC, event, raw_frame


def deliveries(spark, payloads, **where):
    return valid_events(classify(raw_frame(spark, payloads, **where)))


@pytest.fixture()
def table(tmp_path):
    return LogTable(str(tmp_path / "table"), buckets=4)


def test_first_write_wins_within_and_across_batches(spark, table):
    first = deliveries(spark, [event(message="one"), event(message="two"), event(id="b")])
    assert insert_logs(first, table) == {"unique": 2, "stored": 2}
    later = deliveries(spark, [event(message="three"), event(id="c")], partition=1)
    assert insert_logs(later, table) == {"unique": 2, "stored": 1}
    rows = {r.id: r for r in read_logs(spark, table).collect()}
    assert sorted(rows) == ["b", "c", "m-300"]
    assert rows["m-300"].message == "one" and rows["b"].received_at is not None
    assert rows["b"].event_date == dt.date(2031, 3, 7)


def test_a_replay_changes_nothing(spark, table):
    batch = deliveries(spark, [event(), event(id="b"), event(id="b")])
    assert insert_logs(batch, table)["stored"] == 2
    assert insert_logs(batch, table)["stored"] == 0
    assert read_logs(spark, table).count() == 2


@pytest.mark.parametrize("broadcast_bytes, probed", [(0, 0), (50, 0), (1 << 20, 0), (0, 256)])
def test_a_batch_that_died_between_its_two_writes_is_completed(spark, table, monkeypatch, broadcast_bytes, probed):
    monkeypatch.setattr(store, "PROBED_IDS", probed)
    table = LogTable(table.path, table.buckets, broadcast_bytes)
    insert_logs(deliveries(spark, [event(id="old")], partition=3), table)
    batch = deliveries(spark, [event(), event(id="b", timestamp="2031-03-09T00:00:00Z"), event(id="old")])
    append = store._append

    def fail_on_logs(df, path, *rest):
        if path == table.logs_path:
            raise RuntimeError("lost")
        append(df, path, *rest)

    monkeypatch.setattr(store, "_append", fail_on_logs)
    with pytest.raises(RuntimeError):
        insert_logs(batch, table)
    assert read_logs(spark, table).count() == 1
    monkeypatch.setattr(store, "_append", append)
    assert insert_logs(batch, table)["stored"] == 2
    assert sorted(r.id for r in read_logs(spark, table).collect()) == ["b", "m-300", "old"]
    assert_totals_agree(spark, table)


def assert_totals_agree(spark, table):
    """Counts of the table are those of its records."""
    now = dt.datetime.now(UTC)
    logs, counted = read_logs(spark, table), read_totals(spark, table)
    assert totals.summary(counted, now).first() == summary(logs, now).first()
    assert totals.services(counted).collect() == services(logs).collect()
    by_day = {r.event_date: r.n for r in logs.groupBy("event_date").agg(F.count("*").alias("n")).collect()}
    assert {r.event_date: r.rows for r in totals.rows_by_day(counted).collect()} == by_day


def test_totals_count_every_record_once(spark, table, monkeypatch):
    first = deliveries(spark, [event(id=str(n), service=f"s-{n % 3}", level="error") for n in range(20)])
    later = deliveries(spark, [event(id=str(n), timestamp="2031-04-01T00:00:00Z") for n in range(15, 40)], partition=1)
    assert read_totals(spark, table).count() == 0
    for batch in (first, later, first, later):
        insert_logs(batch, table)
        assert_totals_agree(spark, table)


def bytes_read(spark) -> int:
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_lookup_follows_the_batch(spark, tmp_path):
    """A hundred ids cost about the same in a history ten times as long."""
    cost = []
    ids = spark.range(100).selectExpr("concat('new-', id) AS id").collect()
    for size in (40_000, 400_000):
        table = store.open_table(spark, LogTable(str(tmp_path / str(size)), buckets=4), create=True)
        history = spark.range(size).selectExpr("concat('old-', id) AS id", "'t' AS topic", "0 AS partition", "id AS offset")
        history = history.withColumn("id_hash", F.xxhash64("id")).withColumn("bucket", store._bucket(table))
        store._append(history, table.claims_path, "bucket", ["id_hash"], store._PROBED)
        wanted = spark.createDataFrame([*ids, ("old-7",), ("old-39999",)], "id string").withColumn("bucket", store._bucket(table))
        found = store._probed_claims(wanted, table)
        before = bytes_read(spark)
        assert sorted(r.id for r in found.collect()) == ["old-39999", "old-7"]
        cost.append(bytes_read(spark) - before)
    stored = sum(f.stat().st_size for f in (tmp_path / "400000").rglob("*.parquet"))
    assert cost[1] < 2.5 * cost[0] and cost[1] < stored / 4, (cost, stored)


def test_a_table_without_hashes_is_joined(spark, table, monkeypatch):
    """What was written before claims had hashes is looked up by a join and read by its text."""
    monkeypatch.setattr(store, "VERSION", 1)
    assert insert_logs(deliveries(spark, [event(id="a"), event(id="b")]), table)["stored"] == 2
    monkeypatch.undo()
    again = deliveries(spark, [event(id="a"), event(id="c", message="posting entries")], partition=1)
    assert insert_logs(again, table) == {"unique": 2, "stored": 1}
    assert read_totals(spark, table) is None and read_term_hours(spark, table) is None
    rows, _ = fetch_stored_page(spark, table, SearchParams(query="entry"))
    assert [r.id for r in rows] == ["c", "b", "a"]


def test_a_text_is_looked_up_in_the_index(spark, table):
    days = [f"20{year}-05-0{day}T0{day}:30:00Z" for year in range(10, 20) for day in (1, 2)]
    events = [event(id=f"d-{n}", timestamp=day, message=f"posted entry {n}") for n, day in enumerate(days)]
    events += [event(id="rare", timestamp=days[0], message="a zebra was seen"), event(id="two", timestamp=days[3], message="Zebras")]
    insert_logs(deliveries(spark, events), table)
    logs = read_logs(spark, table)
    hours = sorted(map(tuple, terms.hours_of(read_term_hours(spark, table), ["zebra"]).collect()))
    assert hours == [(dt.date(2010, 5, 1), 1), (dt.date(2011, 5, 2), 2)]
    narrow = terms.within_hours(logs, hours)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = narrow._jdf.queryExecution().explainString(mode)
    assert "event_date#" in text.split("PartitionFilters:")[1].split("\n")[0] and "GreaterThanOrEqual(timestamp," in text
    assert len(narrow.inputFiles()) <= 20 and narrow.count() == 4
    for query in ("zebra", "entries 3", "posting", "nothing like it", "the of", "seen zebras"):
        rows, cursor = fetch_stored_page(spark, table, SearchParams(query=query, limit=7))
        plain = fetch_page(logs.drop("message_terms"), SearchParams(query=query, limit=7))
        assert ([r.id for r in rows], cursor) == ([r.id for r in plain[0]], plain[1])
    old = logs.withColumn("message_terms", F.lit(None).cast("array<string>"))
    assert [r.id for r in fetch_page(old, SearchParams(query="zebra"))[0]] == ["two", "rare"]


def test_a_sparse_history_takes_three_jobs(spark, table, monkeypatch):
    days = [f"20{year}-0{month}-01T00:00:00Z" for year in range(10, 30) for month in range(1, 10, 2)]
    insert_logs(deliveries(spark, [event(id=f"{n:03}", timestamp=day) for n, day in enumerate(days)]), table)
    from cordwood.operators import search

    seen = []
    newest_first = search.newest_first
    monkeypatch.setattr(search, "newest_first", lambda df, n: seen.append(n) or newest_first(df, n))
    expected = [f"{n:03}" for n in reversed(range(100))]
    rows, cursor = fetch_stored_page(spark, table, SearchParams(limit=10))
    assert [r.id for r in rows] == expected[:10] and cursor and len(seen) == 1
    seen.clear()
    rows, cursor = fetch_stored_page(spark, table, SearchParams(limit=60, level="info"))
    assert [r.id for r in rows] == expected[:60] and len(seen) <= 3
    seen.clear()
    rows, _ = fetch_stored_page(spark, table, SearchParams(limit=60, level="error"))
    assert rows == [] and len(seen) <= 3
    from cordwood.functions.cursors import decode_cursor

    rows, cursor = fetch_stored_page(spark, table, SearchParams(limit=60, cursor=decode_cursor(cursor)))
    assert [r.id for r in rows] == expected[60:] and cursor == ""


@pytest.mark.parametrize("limit, joins, broadcasts", [(0, 4, 0), (200, 2, 2), (360, 1, 1)])
def test_claims_are_looked_up_in_groups(spark, table, limit, joins, broadcasts):
    """Four buckets of 90 bytes each: one by one, in pairs, or all at once."""
    events = [event(id=f"id-{n}") for n in range(40)]
    insert_logs(deliveries(spark, events), table)
    grouped = LogTable(table.path, table.buckets, limit)
    ids = spark.range(30, 70).selectExpr("concat('id-', id) AS id").withColumn("bucket", store._bucket(table))
    sizes = ids.groupBy("bucket").agg(F.count("*").alias("rows"), F.lit(90).alias("bytes")).collect()
    found = store._claims_of(ids, sizes, grouped)
    assert sorted(r.id for r in found.collect()) == sorted(f"id-{n}" for n in range(30, 40))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftSemi") == joins
    assert text.count("rightHint=(strategy=broadcast)") == broadcasts
    replay = deliveries(spark, events + [event(id="new")])
    assert insert_logs(replay, grouped) == {"unique": 41, "stored": 1}


def test_a_hot_id_is_collapsed_before_the_shuffle(spark):
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id AS string)) AS id", "'t' AS topic", "0 AS partition", "id AS offset"
    )
    winners = first_per_key(rows.repartition(8), "id", store.POSITION)
    text = winners._jdf.queryExecution().toString()
    assert "partial_min_by" in text
    assert winners.count() == 20_001 and winners.where("id = 'hot'").first().offset == 0


def test_an_empty_batch_writes_nothing(spark, table):
    assert insert_logs(deliveries(spark, ["just words"]), table) == {"unique": 0, "stored": 0}
    assert read_logs(spark, table).count() == 0


def test_filters_and_two_pages_over_the_table(spark, table):
    times = [f"2031-03-07T20:15:0{n}Z" for n in range(3)]
    rows = [
        event(
            id=f"it-{n}",
            service="it",
            level="error",
            message="nightly rollup zanzibarmark",
            timestamp=times[n],
            attributes={"probe": True},
            source={"origin": "suite"},
        )
        for n in range(3)
    ]
    insert_logs(deliveries(spark, rows + [rows[0], event()]), table)
    logs = read_logs(spark, table)
    from cordwood.functions.cursors import decode_cursor

    params = dict(service="it", level="error", query="zanzibarmark", limit=2)
    first, cursor = fetch_page(logs, SearchParams(**params))
    assert [r.id for r in first] == ["it-2", "it-1"] and cursor
    assert first[0].attributes.toPython() == {"probe": True}
    second, cursor = fetch_page(logs, SearchParams(**params, cursor=decode_cursor(cursor)))
    assert [r.id for r in second] == ["it-0"] and cursor == ""
    assert [r.service for r in services(logs).collect()] == ["it", "ledger"]
    counts = delivery_counts(logs, {"twice": "it-0", "other": "m-300", "none": "x"}).first()
    assert counts.asDict() == {"twice": 1, "other": 1, "none": 0}


def test_a_time_range_prunes_days_and_row_groups(spark, table):
    rows = [event(id=str(d), timestamp=f"2031-03-0{d}T00:00:00Z") for d in range(1, 8)]
    insert_logs(deliveries(spark, rows), table)
    from cordwood.operators.search import matching

    found = matching(
        read_logs(spark, table),
        SearchParams(start=dt.datetime(2031, 3, 3, tzinfo=UTC), end=dt.datetime(2031, 3, 4, tzinfo=UTC)),
    )
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = found._jdf.queryExecution().explainString(mode)
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "GreaterThanOrEqual(timestamp," in text
    assert sorted(r.id for r in found.collect()) == ["3", "4"]


def test_summary_counts(spark):
    now = dt.datetime(2031, 3, 7, 12, tzinfo=UTC)
    rows = [("a", "error", 60), ("a", "fatal", 0), ("b", "error", 61), ("c", "info", -300), ("c", "warn", 59)]
    frame = spark.createDataFrame(rows, "service string, level string, age int").withColumn(
        "received_at", F.expr("timestamp'2031-03-07 12:00:00' - make_dt_interval(0, 0, 0, age)")
    )
    counts = summary(frame, now)
    assert counts.first().asDict() == {
        "logs_ingested_total": 5,
        "logs_last_minute": 4,
        "errors_last_minute": 1,
        "active_services": 3,
    }
    assert summary(frame.where("false"), now).first().asDict() == {
        "logs_ingested_total": 0,
        "logs_last_minute": 0,
        "errors_last_minute": 0,
        "active_services": 0,
    }
    assert summary(frame).first().logs_ingested_total == 5
    assert summary_contract(counts).first().valid
    broken = counts.withColumn("active_services", F.lit(-1)).withColumn("logs_last_minute", F.lit(1 << 53))
    checked = summary_contract(broken).first()
    assert (checked.active_services, checked.logs_last_minute, checked.valid) == (False, False, False)


def test_row_contract_and_constraints(spark, table):
    insert_logs(deliveries(spark, [event(), event(id="b")]), table)
    logs = read_logs(spark, table)
    assert contract_violations(logs).count() == 0
    for name, value in {
        "schema_version": "2S",
        "id": "''",
        "level": "'WARN'",
        "attributes": "parse_json('[1]')",
        "source": "map('a', cast(NULL AS string))",
        "timestamp": "cast(NULL AS timestamp)",
        "message": "cast(NULL AS string)",
    }.items():
        assert contract_violations(logs.withColumn(name, F.expr(value))).count() == 2
    doubled = logs.unionByName(logs.where("id = 'b'").withColumn("schema_version", F.expr("2S")))
    found = sorted(tuple(r) for r in constraint_violations(doubled).collect())
    assert found == [("schema_version", "b", 1), ("unique_id", "b", 2)]


def test_the_bucket_count_stays_with_the_table(spark, table):
    batch = deliveries(spark, [event(id=f"n-{n}") for n in range(50)])
    assert insert_logs(batch, table)["stored"] == 50
    # Opened by its path, the table keeps its four buckets.
    again = deliveries(spark, [event(id=f"n-{n}") for n in range(60)], partition=2)
    assert insert_logs(again, table.path) == {"unique": 60, "stored": 10}
    assert read_logs(spark, table.path).count() == 60
    with pytest.raises(ValueError, match="has 4 buckets, not 8"):
        insert_logs(again, LogTable(table.path, buckets=8))


def test_inserts_leave_no_extra_folder(spark, table, tmp_path):
    for n in range(3):
        insert_logs(deliveries(spark, [event(id=f"n-{n}")], partition=n), table)
    left = {path.name for path in (tmp_path / "table").iterdir()}
    assert left <= {"logs", "claims", "terms", "totals", "layout", "_lookup"}
    assert not list((tmp_path / "table").glob("_lookup/[!.]*"))


def test_a_replay_reads_only_its_own_days(spark, table):
    days = [f"20{year}-01-01T00:00:00Z" for year in range(10, 30)]
    insert_logs(deliveries(spark, [event(id=day, timestamp=day) for day in days]), table)
    batch = deliveries(spark, [event(id=days[0], timestamp=days[0]), event(id=days[-1], timestamp=days[-1])])
    assert insert_logs(batch, table)["stored"] == 0
    assert read_logs(spark, table).count() == 20


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu"])
def test_the_zone_of_the_session_changes_nothing(spark, table, zone):
    moments = ["2031-03-09T02:30:00Z", "2031-03-08T23:59:59.5Z", "1969-12-31T23:00:00Z", "2031-11-02T06:30:00Z"]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        insert_logs(deliveries(spark, [event(id=m, timestamp=m) for m in moments]), table)
        logs = read_logs(spark, table)
        days = {r.id: str(r.event_date) for r in logs.select("id", "event_date").collect()}
        assert days == {m: m[:10] for m in moments}
        for m in moments:
            start = dt.datetime.fromisoformat(m)
            rows, _ = fetch_page(logs, SearchParams(start=start, end=start), today=dt.date(2032, 1, 1))
            assert [r.id for r in rows] == [m]
        text = logs.select("id", F.expr(format_rfc3339("timestamp")).alias("text")).collect()
        assert {r.id: r.text for r in text} == {m: m for m in moments}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
