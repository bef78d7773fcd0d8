"""The three jobs of the pipeline.

``collect``  log lines to landed events,
``ingest``   request bodies to raw records,
``persist``  raw records to the log table or to dead letters.

Each advances its checkpoint only after its sinks have taken the batch, so a
crash replays the batch; event ids, positions and first-write-wins make the
replay harmless.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from cordwood.operators.deadletter import dead_letter_rows, to_dead_letters
from cordwood.operators.ingest import (
    accepted_events,
    ingest_counters,
    judge_requests,
    publish_events,
)
from cordwood.operators.parse import events_only, line_counters, parse_prepared, prepare_lines
from cordwood.operators.store import LogTable, insert_logs
from cordwood.operators.validate import classify, route_counters, valid_events
from cordwood.schemas import MAX_BATCH_EVENTS, MAX_LINE_BYTES
from cordwood.sources.lines import LogSource, read_lines

RowSink = Callable[[DataFrame], None]


def parquet_rows(path: str) -> RowSink:
    """Append rows to a Parquet folder."""
    return lambda rows: rows.write.mode("append").parquet(path)


def kafka_rows(brokers: str, topic: str) -> RowSink:
    """Publish ``key, value`` rows, waiting for all replicas; needs Spark's Kafka connector."""

    def publish(rows: DataFrame) -> None:
        (
            rows.select("key", "value")
            .write.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("kafka.acks", "all")
            .option("topic", topic)
            .save()
        )

    return publish


def _start(writer: DataStreamWriter, checkpoint: str, trigger: dict[str, Any] | None) -> StreamingQuery:
    trigger = trigger or {"processingTime": "1 minute"}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def collect(
    spark: SparkSession,
    sources: list[LogSource],
    out: str,
    checkpoint: str,
    host: str = "unknown",
    agent: str = "agent",
    max_line_bytes: int = MAX_LINE_BYTES,
    max_files_per_trigger: int | None = None,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Read, parse and land log lines.

    Ids are drawn here and fixed by the file sink, which writes each line
    once; every later job reads the landed id. The counters appear as
    ``lines`` in the query's progress.
    """
    lines = read_lines(spark, sources, True, max_files_per_trigger)
    counted = prepare_lines(lines, max_line_bytes).observe("lines", *line_counters())
    events = events_only(parse_prepared(counted, host=host, agent=agent))
    writer = events.writeStream.format("parquet").option("path", out).outputMode("append")
    return _start(writer, checkpoint, trigger)


JUDGED, PUBLISHED = "judged", "published"
COUNTED = "batch long, phase string, ingested_events long, rejected_events long"


def _count(row: DataFrame, path: str) -> None:
    named = row.toDF("batch", "phase", "ingested_events", "rejected_events")
    typed = named.selectExpr("cast(batch AS long)", "phase", "cast(ingested_events AS long)", "cast(rejected_events AS long)")
    typed.coalesce(1).write.mode("append").parquet(path)


def ingest_totals(counted: DataFrame) -> DataFrame:
    """One row of counts from the ``counters`` of an ingest job.

    A batch counts once, however often it was tried: its rejected events as soon as it was
    judged, its accepted ones once they were published.
    """
    batches = counted.groupBy("batch").agg(
        F.max("ingested_events").alias("ingested"),
        F.max("rejected_events").alias("rejected"),
        F.bool_or(F.col("phase") == PUBLISHED).alias("published"),
    )
    zero = F.lit(0).cast("long")
    return batches.agg(
        F.coalesce(F.sum(F.when(F.col("published"), F.col("ingested"))), zero).alias("ingested_events"),
        F.coalesce(F.sum("rejected"), zero).alias("rejected_events"),
    )


def ingest(
    requests: DataFrame,
    publish: RowSink,
    results: RowSink,
    checkpoint: str,
    max_batch: int = MAX_BATCH_EVENTS,
    trigger: dict[str, Any] | None = None,
    counters: str | None = None,
) -> StreamingQuery:
    """Judge request bodies, publish their valid events, then report the results.

    ``counters`` names a folder for counts that survive a failure: rejected events are counted
    before the publish, whatever becomes of it, and accepted ones are confirmed after it;
    see ``ingest_totals``.
    """

    def handle(batch: DataFrame, number: int) -> None:
        judged = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if counters:
                # One row for each phase of a batch; a replay writes the same figures again.
                told = judged.agg(*ingest_counters())
                _count(told.select(F.lit(number), F.lit(JUDGED), "ingested_events", "rejected_events"), counters)
            publish(publish_events(accepted_events(judged)))
            if counters:
                nothing = F.lit(0)
                _count(batch.sparkSession.range(1).select(F.lit(number), F.lit(PUBLISHED), nothing, nothing), counters)
            results(judged.drop("body", "valid"))
        finally:
            judged.unpersist()

    judged = judge_requests(requests, max_batch=max_batch).observe("ingest", *ingest_counters())
    return _start(judged.writeStream.foreachBatch(handle), checkpoint, trigger)


def persist_batch(
    classified: DataFrame, table: LogTable | str, dead_letters: RowSink, as_rows: bool = False
) -> dict[str, int]:
    """Store the valid records of a classified batch and dead-letter the others.

    Dead letters may be written again when a batch is replayed; their id stays
    the same.
    """
    batch = classified.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stored = insert_logs(valid_events(batch), table)
        letters = to_dead_letters(batch, F.current_timestamp())
        dead_letters(dead_letter_rows(letters) if as_rows else letters)
        return stored
    finally:
        batch.unpersist()


def persist(
    raw: DataFrame,
    table: LogTable | str,
    dead_letters: RowSink,
    checkpoint: str,
    as_rows: bool = False,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Raw records to the log table; the counters appear as ``records`` in the progress.

    ``as_rows`` turns dead letters into ``key, value`` rows for a message sink.
    """

    def handle(batch: DataFrame, _: int) -> None:
        persist_batch(batch, table, dead_letters, as_rows)

    classified = classify(raw).observe("records", *route_counters())
    return _start(classified.writeStream.foreachBatch(handle), checkpoint, trigger)
