"""The stored log table: idempotent insert, first write wins.

Parquet folders make up a table:

``logs/``    the records with their index terms, partitioned by ``event_date``
             and sorted by time within each file;
``claims/``  one narrow row per stored id with the stream position that won
             it, partitioned by a hash bucket of the id and sorted by a hash;
``terms/``   in which hours a term occurs (``operators.terms``);
``totals/``  counts of each batch (``operators.totals``);
``layout/``  the number of buckets, written with the first batch.

A batch looks its ids up in the claims, which hold every id ever stored and
nothing else, instead of in the records. A small batch probes the claims by the
hashes of its ids, so it reads the pages that may hold them and not the
history. Claims, terms and totals are written before the records. One writer
per table is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.fulltext import message_terms
from cordwood.functions.levels import strict_level
from cordwood.functions.times import utc_day
from cordwood.operators import terms, totals
from cordwood.operators.firstwins import first_per_key
from cordwood.schemas import POSITION, STORED

CLAIM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("id_hash", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType()), T.StructField("version", T.IntegerType())])
#: From this version on claims have hashes, and terms and totals cover all records.
VERSION = 2

#: Buckets of a new table whose creator doesn't choose.
DEFAULT_BUCKETS = 16
#: A batch of up to so many ids probes the claims; a larger one is joined to them.
PROBED_IDS = 256
#: Parquet settings by which pages and row groups without an id are skipped.
_PROBED = {
    "parquet.bloom.filter.enabled#id_hash": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.page.row.count.limit": "1000",
}


@dataclass(frozen=True)
class LogTable:
    """Location and layout of a stored log table.

    The number of buckets is kept with the table. Leave it out to take what the
    table has; a number that differs from it is an error. The ids of a batch are
    broadcast to the claims in groups of buckets of at most ``broadcast_bytes``.
    """

    path: str
    buckets: int | None = None
    broadcast_bytes: int = 64 * 1024 * 1024
    version: int | None = None

    @property
    def layout_path(self) -> str:
        return f"{self.path.rstrip('/')}/layout"

    @property
    def logs_path(self) -> str:
        return f"{self.path.rstrip('/')}/logs"

    @property
    def claims_path(self) -> str:
        return f"{self.path.rstrip('/')}/claims"

    @property
    def terms_path(self) -> str:
        return f"{self.path.rstrip('/')}/terms"

    @property
    def totals_path(self) -> str:
        return f"{self.path.rstrip('/')}/totals"


def _read(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A Parquet folder with a fixed schema; empty before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_logs(spark: SparkSession, table: LogTable | str) -> DataFrame:
    """All stored records, with ``event_date`` for partition pruning and ``message_terms``."""
    table = LogTable(table) if isinstance(table, str) else table
    return _read(spark, STORED, table.logs_path)


def read_term_hours(spark: SparkSession, table: LogTable | str) -> DataFrame | None:
    """The index of terms, where it covers all records."""
    table = open_table(spark, table)
    return _read(spark, terms.TERM_HOUR, table.terms_path) if table.version >= VERSION else None


def read_totals(spark: SparkSession, table: LogTable | str) -> DataFrame | None:
    """The counts of all records, where they cover them."""
    table = open_table(spark, table)
    return totals.last_attempts(_read(spark, totals.TOTAL, table.totals_path)) if table.version >= VERSION else None


def open_table(spark: SparkSession, table: LogTable | str, create: bool = False) -> LogTable:
    """The table with its own number of buckets; ``create`` writes that of a new one."""
    table = LogTable(table) if isinstance(table, str) else table
    kept = _read(spark, LAYOUT, table.layout_path).first()
    if kept is None:
        table = replace(table, buckets=table.buckets or DEFAULT_BUCKETS, version=VERSION)
        if create:
            row = spark.createDataFrame([(table.buckets, table.version)], LAYOUT)
            row.coalesce(1).write.mode("overwrite").parquet(table.layout_path)
        return table
    if table.buckets not in (None, kept["buckets"]):
        raise ValueError(f"the table at {table.path} has {kept['buckets']} buckets, not {table.buckets}")
    return replace(table, buckets=kept["buckets"], version=kept["version"] or 1)


def to_records(
    events: DataFrame, received_at: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Events in stored form; the level is normalised once more, as the store does."""
    received_at = F.current_timestamp() if received_at is None else received_at
    return events.select(
        F.col("schema_version").cast("short").alias("schema_version"),
        "id",
        "service",
        F.expr(strict_level("level")).alias("level"),
        "message",
        "attributes",
        "source",
        "timestamp",
        received_at.alias("received_at"),
        *keep,
    )


def _bucket(table: LogTable) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(table.buckets)).cast("int")


def _append(df: DataFrame, path: str, partition: str, order: list[str], settings: Mapping[str, str] | None = None) -> None:
    """Append with few files per partition; a hot partition is split, not piled up."""
    balanced = df.hint("rebalance", F.col(partition))
    ordered = balanced.sortWithinPartitions(partition, *order)
    ordered.write.mode("append").options(**settings or {}).partitionBy(partition).parquet(path)


def _claims_of(ids: DataFrame, sizes: list[Row], table: LogTable) -> DataFrame:
    """Claims of the given ids, without a shuffle of the claims where it can be helped.

    The buckets are taken in groups whose ids fit a broadcast. Each group reads
    only its own claim folders, so together the groups read no claim twice. A
    bucket whose ids do not fit is left to a shuffle join.
    """
    groups: list[list[int]] = []
    room = 0
    for size in sorted(sizes, key=lambda s: s["bytes"]):
        if not groups or size["bytes"] > room:
            groups.append([])
            room = table.broadcast_bytes
        groups[-1].append(size["bucket"])
        room -= size["bytes"]
    fits = {size["bucket"]: size["bytes"] <= table.broadcast_bytes for size in sizes}
    claims = _read(ids.sparkSession, CLAIM, table.claims_path)
    found = []
    for group in groups:
        chosen = F.col("bucket").isin(group)
        wanted = ids.where(chosen)
        wanted = F.broadcast(wanted) if all(fits[bucket] for bucket in group) else wanted
        found.append(claims.where(chosen).join(wanted, ["bucket", "id"], "left_semi"))
    return reduce(DataFrame.unionByName, found)


def _probed_claims(ids: DataFrame, table: LogTable) -> DataFrame:
    """Claims of a few ids: only pages that may hold one of their hashes are read.

    Equalities are pushed down one by one; a list of values would reach Parquet as its
    bounds only.
    """
    rows = ids.select("bucket", "id", F.xxhash64("id").alias("id_hash")).collect()
    claims = _read(ids.sparkSession, CLAIM, table.claims_path)
    tests = [F.col("id_hash") == row["id_hash"] for row in rows]
    while len(tests) > 1:
        # Pair by pair, so that the tree stays flat.
        tests = [reduce(or_, tests[at : at + 2]) for at in range(0, len(tests), 2)]
    chosen = F.col("bucket").isin(sorted({row["bucket"] for row in rows}))
    return claims.where(chosen).where(tests[0]).where(F.col("id").isin([row["id"] for row in rows]))


def pending(winners: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """The winners still to be stored, each with the claim on its id (``_claim``) if any.

    ``seen`` has the ids already claimed and the position that won each
    (``_claim``). An id claimed by another position is left out; a claim by the
    winner's own position means that a replay may have to store it.
    """
    own = F.struct(*POSITION) == F.col("_claim")
    return winners.join(seen, key, "left").where(F.col("_claim").isNull() | own)


def insert_logs(
    events: DataFrame, table: LogTable | str, received_at: Column | None = None
) -> dict[str, int]:
    """Store the events whose id is new; the earliest position of an id wins.

    ``events`` carry the event columns and ``topic, partition, offset``.
    Claims are written before records. When a batch is replayed after a
    failure, its own claims are recognised by their position, and the rows
    that made it into the table the first time are left out, so a replay
    completes a batch without repeating any of it.
    """
    spark = events.sparkSession
    table = open_table(spark, table)
    winners = first_per_key(events, "id", POSITION).withColumn("bucket", _bucket(table))
    winners = winners.persist(StorageLevel.MEMORY_AND_DISK)
    # Spark recomputes cached rows that read a folder once that folder is written to, so
    # the result of the lookup is cut loose from the claims, under the table's own path.
    lookup = f"{table.path.rstrip('/')}/_lookup/{uuid.uuid4().hex}"
    try:
        # One row per bucket, so at most table.buckets rows.
        sizes = (
            winners.groupBy("bucket")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum(F.octet_length("id") + 32).alias("bytes"),
            )
            .collect()
        )
        unique = sum(size["rows"] for size in sizes)
        if not unique:
            return {"unique": 0, "stored": 0}
        table = open_table(spark, table, create=True)
        ids = winners.select("bucket", "id")
        probed = unique <= PROBED_IDS and table.version >= VERSION
        found = _probed_claims(ids, table) if probed else _claims_of(ids, sizes, table)
        found.groupBy("id").agg(F.min(F.struct(*POSITION)).alias("_claim")).write.parquet(lookup)
        seen = spark.read.parquet(lookup)
        small = sum(size["bytes"] for size in sizes) <= table.broadcast_bytes
        fresh = pending(winners, F.broadcast(seen) if small else seen)
        fresh = fresh.withColumn("event_date", F.expr(utc_day("timestamp")))
        fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return {"unique": unique, "stored": _store(fresh, table, received_at)}
        finally:
            fresh.unpersist()
    finally:
        winners.unpersist()
        _delete(spark, lookup)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _store(pending: DataFrame, table: LogTable, received_at: Column | None) -> int:
    replayed = F.col("_claim").isNotNull()
    facts = pending.agg(
        F.count_if(~replayed).alias("fresh"),
        F.count_if(replayed).alias("again"),
        F.bit_xor(F.xxhash64("id", *POSITION)).alias("key"),
    ).first()
    missing, lost = pending, 0
    if facts["again"]:
        # Same position means same event, hence same day: only the days of replayed
        # events are read, however far apart they are.
        days = pending.where(replayed).select("event_date").distinct()
        present = read_logs(pending.sparkSession, table).join(F.broadcast(days), "event_date", "left_semi")
        missing = pending.join(present.select("event_date", "id"), ["event_date", "id"], "left_anti")
        lost = missing.where(replayed).count()
    if facts["fresh"]:
        fresh = pending.where(~replayed).withColumn("id_hash", F.xxhash64("id")).select(*CLAIM.fieldNames())
        _append(fresh, table.claims_path, "bucket", ["id_hash"], _PROBED)
    if not facts["fresh"] + lost:
        return 0
    records = to_records(missing, received_at).withColumn("event_date", F.expr(utc_day("timestamp")))
    if table.version >= VERSION:
        records = records.withColumn("message_terms", message_terms("message"))
    else:
        records = records.withColumn("message_terms", F.lit(None).cast("array<string>"))
    records = records.select(*STORED.fieldNames()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if table.version >= VERSION:
            _append(terms.term_hours(records), table.terms_path, "bucket", ["term", "event_date", "hour"], terms.FILTERED)
            # The same records of a batch make the same key, whenever they are stored.
            key = F.lit(f"{facts['key']}:{facts['fresh'] + facts['again']}")
            counted = totals.batch_totals(records, key, F.unix_micros(F.current_timestamp()))
            counted.coalesce(1).write.mode("append").parquet(table.totals_path)
        _append(records, table.logs_path, "event_date", ["timestamp", "id"])
    finally:
        records.unpersist()
    return facts["fresh"] + lost
