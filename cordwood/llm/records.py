"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A folder holds shards and a manifest. Each shard is a file of records::

    length        8 bytes, little-endian, of the payload
    masked CRC    4 bytes, CRC-32C of the length bytes
    payload       ``length`` bytes
    masked CRC    4 bytes, CRC-32C of the payload

A payload is one byte of flags (1: ids take 4 bytes, else 2; 2: the document has no id),
8 bytes of document id, then the ids. Beside it an index file lists where each record
starts, as 8-byte integers. Documents lie in ascending ``doc_id`` order over the shards.

Tasks write under names of their own and return what they wrote; the manifest, committed
by Spark, lists the files that count. Files of failed attempts are never read.

A null or empty text has the end id only. Rows without ``doc_id`` come first. Rows that
share a ``doc_id`` are all written, ordered by a hash of their text. An empty table makes a
manifest without shards. Other columns of the input are not read.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordwood.llm.crc32c import crc32c, masked
from cordwood.llm.shared import as_bytes
from cordwood.llm.wordpieces import encoder

MANIFEST = "shard int, records_file string, index_file string, n_records long, n_tokens long, n_bytes long"
DECODED = "shard int, record long, doc_id long, before long, n_tokens long, ids binary, ids_crc32 long"

_WIDE, _NO_ID = 1, 2
_HEAD = struct.Struct("<Bq")
_BLOCK = 8 << 20


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return arrow_fs.FileSystem.from_uri(uri)


def frame(payloads: list[bytes]) -> list[bytes]:
    """Records of payloads."""
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    size_sums, sums = masked(crc32c(sizes)), masked(crc32c(payloads))
    return [
        b"".join((size, struct.pack("<I", a), payload, struct.pack("<I", b)))
        for size, a, payload, b in zip(sizes, size_sums.tolist(), payloads, sums.tolist(), strict=True)
    ]


def payload_of(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (_WIDE if wide else 0) | (_NO_ID if doc_id is None else 0)
    return _HEAD.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def read_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_HEAD.size)
    return (None if flags & _NO_ID else doc_id), ids.astype("<u4")


def write_records(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int, shards: int | None = None
) -> DataFrame:
    """Write all documents; returns the manifest.

    ``shards`` is the number of files; by default the session's shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        wide = encode.vocabulary > 1 << 16
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        place, path = _place(name)
        starts: list[int] = []
        at = tokens = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                place.create_dir(path.rpartition("/")[0], recursive=True)
                out = place.open_output_stream(f"{path}.records")
            doc_ids = batch.column(0).to_pylist()
            payloads = []
            for doc_id, ids in zip(doc_ids, encode.encode(as_bytes(batch.column(1))), strict=True):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                tokens += len(ids)
                payloads.append(payload_of(doc_id, ids, wide))
            for record in frame(payloads):
                starts.append(at)
                at += len(record)
                out.write(record)
        if out is None:
            return
        out.close()
        with place.open_output_stream(f"{path}.index") as index:
            index.write(np.array(starts, "<u8").tobytes())
        row = [[shard], [f"{name}.records"], [f"{name}.index"], [len(starts)], [tokens], [at]]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["shard", "records_file", "index_file", "n_records", "n_tokens", "n_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], names=names)

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("tie"),
    )
    # Only the keys are sampled for the ranges; texts are moved once and tokenized after.
    ordered = narrow.repartitionByRange(shards, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "tie"
    )
    ordered.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with the ids in the shards before it (``before``).

    The running sum goes over one row per shard.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")
    return manifest.withColumn("before", before)


def _checked(payloads: list[bytes], sums: list[int], sizes: list[bytes], size_sums: list[int]) -> None:
    if masked(crc32c(sizes)).tolist() != size_sums or masked(crc32c(payloads)).tolist() != sums:
        raise ValueError("a record's checksum does not match")


def _read_shard(uri: str, n_records: int) -> Iterator[list[bytes]]:
    """Payloads of a shard in blocks, each checksum verified."""
    place, path = _place(uri)
    read = 0
    with place.open_input_stream(path, buffer_size=1 << 20) as source:
        payloads, sums, sizes, size_sums, held = [], [], [], [], 0
        while head := source.read(12):
            sizes.append(head[:8])
            size_sums.append(struct.unpack("<I", head[8:])[0])
            body = source.read(struct.unpack("<Q", head[:8])[0] + 4)
            payloads.append(body[:-4])
            sums.append(struct.unpack("<I", body[-4:])[0])
            held += len(body)
            if held >= _BLOCK:
                _checked(payloads, sums, sizes, size_sums)
                read += len(payloads)
                yield payloads
                payloads, sums, sizes, size_sums, held = [], [], [], [], 0
        _checked(payloads, sums, sizes, size_sums)
        if read + len(payloads) != n_records:
            raise ValueError(f"{uri}: {read + len(payloads)} records, the manifest has {n_records}")
        yield payloads


def read_records(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """All records of a folder: document, ids in all documents before it, ids and checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "record", "doc_id", "before", "n_tokens", "ids", "ids_crc32"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            for shard in batch.to_pylist():
                before, record = shard["before"], 0
                for payloads in _read_shard(shard["records_file"], shard["n_records"]):
                    rows = []
                    for payload in payloads:
                        doc_id, ids = read_payload(payload)
                        raw = ids.tobytes()
                        kept = raw if keep_ids else None
                        rows.append((shard["shard"], record, doc_id, before, len(ids), kept, zlib.crc32(raw)))
                        before += len(ids)
                        record += 1
                    columns = list(zip(*rows, strict=True)) or [[]] * 7
                    arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    manifest = read_manifest(spark, folder).select("shard", "records_file", "n_records", "before")
    # One row per shard: spread them, so that shards are read in parallel.
    spread = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(run, DECODED)


def shuffled(records_file: str, index_file: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of one shard in an order drawn from ``seed``, found by the index."""
    place, path = _place(index_file)
    with place.open_input_stream(path) as source:
        starts = np.frombuffer(source.read(), "<u8").tolist()
    random.Random(seed).shuffle(starts)
    place, path = _place(records_file)
    with place.open_input_file(path) as source:
        for start in starts:
            head = source.read_at(12, start)
            body = source.read_at(struct.unpack("<Q", head[:8])[0] + 4, start + 12)
            _checked([body[:-4]], list(struct.unpack("<I", body[-4:])), [head[:8]], list(struct.unpack("<I", head[8:])))
            yield read_payload(body[:-4])
