"""The raw event stream, in the columns of Spark's Kafka source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cordwood.schemas import RAW


def read_raw_stream(
    spark: SparkSession,
    brokers: str,
    topic: str = "logs.raw",
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Kafka topic as a stream; needs Spark's Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(*RAW.fieldNames())


def read_raw_files(
    spark: SparkSession,
    path: str,
    streaming: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same records landed as Parquet files."""
    if not streaming:
        return spark.read.schema(RAW).parquet(path)
    reader = spark.readStream.schema(RAW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
