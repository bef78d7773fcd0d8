"""What the operators of this package share: input tables, shared folders, text columns."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver did.

    This serves sessions on one machine. On a cluster the library is installed or sent with
    ``--py-files`` as usual.
    """
    root = str(Path(__file__).resolve().parents[2])
    places = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in places:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, places)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where a session names none, as in
    tests on one machine, a temporary folder is made and kept for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='cordwood-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_within: ContextVar[str | None] = ContextVar("_within", default=None)


@contextmanager
def cleared(spark: SparkSession, name: str) -> Iterator[None]:
    """All scratch tables made inside are deleted at the end: what is wanted of them has been
    written elsewhere by then."""
    path = f"{_within.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    token = _within.set(path)
    try:
        yield
    finally:
        _within.reset(token)
        delete(spark, path)


class Scratch:
    """Intermediate tables of one run, written to the shared folder.

    A written table cuts the lineage and survives the loss of executors. ``drop``
    removes tables that no later step reads, ``keep_only`` all but some.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{_within.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._next = 0
        self._written: set[str] = set()

    def folder(self, name: str) -> str:
        self._next += 1
        return f"{self.path}/{self._next:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df``, written once and read back."""
        path = self.folder(name)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch_path = path
        self._written.add(path)
        return read

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            delete(self.spark, frame._scratch_path)
            self._written.discard(frame._scratch_path)

    def keep_only(self, *frames: DataFrame) -> None:
        for path in self._written - {frame._scratch_path for frame in frames}:
            delete(self.spark, path)
        self._written = {frame._scratch_path for frame in frames}


def small_batch_settings(rows: int = 500, size: int = 2 << 20) -> dict[str, str]:
    """Bounds of what Spark hands Python at once: rows, and bytes for long texts."""
    prefix = "spark.sql.execution.arrow"
    return {f"{prefix}.maxRecordsPerBatch": str(rows), f"{prefix}.maxBytesPerBatch": str(size)}


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: int = 2 << 20) -> Iterator[None]:
    """Jobs run inside hand Python at most so many rows, or about so many bytes, at once.

    Whole texts make Arrow batches of the usual 10000 rows large, on both sides of the pipe,
    and a few very long texts make a batch of any number of rows large.
    """
    wanted = small_batch_settings(rows, size)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes; nulls stay null."""
    return pc.cast(column, pa.large_binary()).to_pylist()


def release_memory() -> None:
    """Give memory that nothing holds any more back to the machine.

    Python workers go on from stage to stage; what one task needed at most would otherwise
    stay with them, beside the executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # with the GNU library only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, few at a time, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release_memory()


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next: the last thing asked for.

    Workers go on from stage to stage, so the tables of one operator make room for those of
    the next.
    """
    if key not in _held:
        _held.clear()
        release_memory()
        _held[key] = make()
    return _held[key]
