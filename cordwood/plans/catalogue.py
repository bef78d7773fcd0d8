"""The named queries: each takes a session and a table folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions import cursors
from cordwood.functions.cursors import PageCursor
from cordwood.functions.fulltext import message_terms, query_terms
from cordwood.functions.levels import lenient_level
from cordwood.functions.times import UTC, parse_rfc3339_lenient
from cordwood.operators import deadletter, ingest, pages, parse, quality, search, terms, totals, validate
from cordwood.operators import summary as counts
from cordwood.operators.firstwins import first_per_key
from cordwood.operators.store import pending, to_records
from cordwood.plans import views
from cordwood.schemas import EXPLORER_PAGE, POSITION
from cordwood.session import configure
from cordwood.sources.requests import explode_requests

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Search arguments, shared with the SQL side.
START = dt.datetime(2024, 1, 10, 6, 0, tzinfo=UTC)
END = dt.datetime(2024, 1, 12, 18, 30, tzinfo=UTC)
CURSOR = PageCursor(dt.datetime(2024, 1, 20, 3, 45, tzinfo=UTC), "evt-6382")
SEARCH_TEXT = "Licensing the versions"
MAX_LINE = 120


def query(function: Query) -> Query:
    """Register a query under its own name; its session gets the settings it needs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def _shown(df: DataFrame) -> DataFrame:
    """Semi-structured columns as JSON text."""
    for name in ("attributes", "source"):
        if name in df.columns:
            df = df.withColumn(name, F.to_json(name))
    return df


def _wall_clock(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


# Stored logs: scans, filters, pages.


@query
def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(views.logs(spark, sf_dir))


def _found(df: DataFrame, **params) -> DataFrame:
    return _shown(search.record_columns(search.matching(df, search.SearchParams(**params))))


@query
def search_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(views.logs(spark, sf_dir), service="svc-3")


@query
def search_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(views.logs(spark, sf_dir), level=" WARNING")


@query
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = views.document_logs(spark, sf_dir)
    return _found(logs, query=SEARCH_TEXT).select("id", "service", "timestamp")


@query
def search_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(views.logs(spark, sf_dir), start=START, end=END)


@query
def search_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = search.SearchParams(
        service="svc-2",
        level="error",
        query="errors users",
        start=START,
        end=END,
        limit=25,
        cursor=PageCursor(END, "evt-9"),
    )
    return _shown(search.search(views.logs(spark, sf_dir, ties=True), params).items)


@query
def search_page1(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = search.SearchParams(level="error", limit=EXPLORER_PAGE)
    return _shown(search.search(views.logs(spark, sf_dir, ties=True), params).items)


@query
def search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = search.SearchParams(limit=EXPLORER_PAGE, cursor=CURSOR)
    return _shown(search.search(views.logs(spark, sf_dir, ties=True), params).items)


@query
def cursor_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.logs(spark, sf_dir).select(
        "id", cursors.cursor_column("timestamp", "id").alias("cursor")
    )



@query
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.logs(spark, sf_dir, ties=True).select("timestamp", "id")
    return pages.page_numbers(keys)


@query
def append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = views.logs(spark, sf_dir).select("id", "level", "message", "timestamp")
    day = F.col("timestamp").cast("date")
    shown = logs.where(day >= F.lit("2024-01-20").cast("date"))
    # Every record comes again, some of them twice at the same time.
    later = logs.withColumn("position", F.lit(1)).withColumn("level", F.lit("later"))
    last = later.where("id LIKE '%7'").withColumn("position", F.lit(2)).withColumn("level", F.lit("last"))
    return pages.append_unique(shown, later.unionByName(last))


@query
def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.services(views.logs(spark, sf_dir))


@query
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.summary(views.logs(spark, sf_dir), views.NOW)


def _with_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs as the table keeps them."""
    logs = views.logs(spark, sf_dir).withColumn("message_terms", message_terms("message"))
    return logs.withColumn("event_date", F.to_date("timestamp"))


@query
def search_stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_with_terms(spark, sf_dir), query="errors users")


@query
def term_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours that a search for a text has to read."""
    index = terms.term_hours(_with_terms(spark, sf_dir))
    hours = terms.hours_of(index, query_terms(spark, "errors users"))
    return hours.withColumn("event_date", F.col("event_date").cast("string"))


def _counted_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the logs as if each day were a batch; some of them were tried twice."""
    logs = views.logs(spark, sf_dir).withColumn("event_date", F.to_date("timestamp"))
    counted = totals.batch_totals(logs, F.col("event_date").cast("string"), F.lit(2).cast("long"))
    lost = counted.where("day(event_date) % 3 = 0 AND level = 'error'").withColumn("attempt", F.lit(1).cast("long"))
    return totals.last_attempts(counted.unionByName(lost))


@query
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.summary(_counted_by_day(spark, sf_dir), views.NOW)


@query
def services_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.services(_counted_by_day(spark, sf_dir))


# Lines to events.


@query
def parse_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_lines(
        views.plain_lines(spark, sf_dir),
        host="host-1",
        agent="agent-1",
        now=views.now_column(),
        event_id=F.concat_ws("-", "conv_id", "turn", "line_no"),
    )
    return _wall_clock(_shown(events), "timestamp").drop("conv_id", "turn", "line_no")


@query
def parse_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_lines(
        views.lines(spark, sf_dir),
        host="host-1",
        agent="agent-1",
        now=views.now_column(),
        event_id=F.col("event_id").cast("string"),
    )
    return _wall_clock(_shown(events), "timestamp").drop("event_id")


@query
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = views.plain_lines(spark, sf_dir).select("value")
    every = every.unionByName(views.lines(spark, sf_dir).select("value"))
    return parse.line_quality(every, MAX_LINE)


@query
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 9
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    written = (
        F.when(n == 0, F.concat(text, F.lit("Z")))
        .when(n == 1, F.concat(text, F.lit("-04:30")))
        .when(n == 2, F.concat(text, F.lit("+02:00")))
        .when(n == 3, F.concat(F.translate(text, "T", "t"), F.lit("z")))
        .when(n == 4, F.concat(F.translate(text, "T", " "), F.lit("789+00:00")))
        .when(n == 5, F.substring(text, 1, 10))
        .when(n == 6, text)
        .when(n == 7, F.concat(F.substring(text, 1, 11), F.lit("25:00:00Z")))
        .otherwise(F.substring(text, 1, 4))
    )
    parsed = views.table(spark, sf_dir, "events").select(
        "event_id", parse_rfc3339_lenient(written).alias("timestamp")
    )
    return _wall_clock(parsed, "timestamp")


@query
def level_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    written = (
        F.when(n % 5 == 0, "critical")
        .when(n % 7 == 0, "\tFATAL ")
        .when(n % 11 == 0, None)
        .otherwise(F.expr(views.RAW_LEVEL))
    )
    named = views.table(spark, sf_dir, "events").select("event_id", written.alias("level"))
    return named.withColumn("level", F.expr(lenient_level("level")))


# Raw records: decode, check, route.


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.classify(views.raw(spark, sf_dir))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.to_dead_letters(_classified(spark, sf_dir), views.now_column())


@query
def decode_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select(
        "partition",
        "offset",
        F.coalesce("failure.code", F.lit("valid")).alias("class"),
        F.coalesce("failure.message", F.lit("")).alias("reason"),
    )


@query
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate(views.untidy_events(spark, sf_dir))
    return checked.select("doc_id", F.coalesce("violation", F.lit("valid")).alias("violation"))


@query
def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = validate.valid_events(_classified(spark, sf_dir))
    return _wall_clock(events.select("offset", "id", "level", "timestamp"), "timestamp")


@query
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = _letters(spark, sf_dir)
    flat = letters.select(
        *[c for c in letters.columns if c != "failure"],
        F.col("failure.code").alias("failure_code"),
        F.col("failure.message").alias("failure_message"),
    )
    return _wall_clock(flat, "original_timestamp", "failed_at")


@query
def dlq_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The payload of a record, as an operator looking it up would have it at hand.
    poison = views.raw(spark, sf_dir).where(F.col("key") == F.encode(F.lit("evt-17"), "utf-8"))
    wanted = poison.select(F.sha2("value", 256).alias("payload_sha256"))
    letters = _letters(spark, sf_dir).where(F.col("original_topic") == "logs.raw")
    found = letters.join(wanted, "payload_sha256", "left_semi")
    return found.select("id", "original_offset", "payload_sha256", "payload_bytes")


@query
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).agg(*validate.route_counters())


def _after_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the raw records arrive on top of the stored history."""
    incoming = validate.valid_events(_classified(spark, sf_dir))
    records = _wall_clock(
        to_records(incoming, views.now_column(), keep=POSITION), "timestamp", "received_at"
    )
    history = views.stored_history(spark, sf_dir)
    # What the claims of the history would say: positions of an earlier stream.
    claim = F.struct(F.lit("history").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"))
    fresh = pending(first_per_key(records, "id", POSITION), history.select("id", claim.alias("_claim")))
    return history.unionByName(fresh.select(*history.columns))


@query
def insert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_after_insert(spark, sf_dir))


@query
def delivery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {"redelivered": "evt-20", "barrier": "evt-21"}
    return search.delivery_counts(_after_insert(spark, sf_dir), ids)


# Ingest requests.


@query
def ingest_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explode_requests(views.requests(spark, sf_dir))
    return rows.select("request_id", F.col("pos").cast("long").alias("pos"), "id")


@query
def ingest_batch_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = ingest.ingest_results(views.requests(spark, sf_dir), max_batch=views.MAX_BATCH)
    return results.withColumn("message", F.coalesce("message", F.lit("")))


@query
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ingest.judge_requests(views.requests(spark, sf_dir), max_batch=views.MAX_BATCH)
    return judged.agg(*ingest.ingest_counters())


@query
def publish_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ingest.judge_requests(views.requests(spark, sf_dir), max_batch=views.MAX_BATCH)
    rows = ingest.publish_events(ingest.accepted_events(judged))
    texts = rows.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp"
    )
    return _wall_clock(texts, "timestamp")


# Stored rows: quality.


@query
def record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = quality.contract_violations(views.untidy_logs(spark, sf_dir))
    return broken.select("event_id", "level")


@query
def summary_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The summary of the logs, and figures that no summary may show.
    figures = counts.summary(views.logs(spark, sf_dir), views.NOW)
    broken = figures.withColumns({"logs_last_minute": F.lit(-1).cast("long"), "active_services": F.lit(None).cast("long")})
    large = figures.withColumn("logs_ingested_total", F.col("logs_ingested_total") + F.lit(1 << 53))
    return quality.summary_contract(figures.unionByName(broken).unionByName(large))


@query
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw deliveries would do to the table without checks on insert."""
    events = _classified(spark, sf_dir).where(F.coalesce("failure.code", F.lit("")) != validate.MALFORMED)
    return quality.constraint_violations(events.select("event.id", "event.schema_version"))
