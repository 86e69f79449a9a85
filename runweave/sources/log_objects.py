"""Compressed log objects: one gzip text object per stream, a JSON line per record.

Tasks put the objects themselves, `objects/<stream>.gz`, and return a receipt for each;
`receipts` is a table, so nobody lists or moves the objects. A store that Arrow does not
open has Spark's own gzip text folders instead, one per stream.
"""

from __future__ import annotations

import io
import itertools
import operator
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and characters but for the last row, that a task hands to Spark at once.
ROWS, CHARS = 4096, 1 << 22
_RECEIPT = "stream long, records long"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _opens(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return itertools.chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)


def _key(root: str, stream: int | None) -> str:
    return f"{root}/{'null' if stream is None else stream}.gz"


def _put(objects: str) -> Run:
    """Rows (stream, line), a stream's together. An attempt writes under a name of its own, so a repeated one replaces whole objects."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(objects)

        def install(stream: int | None, rows: Iterator[tuple]) -> tuple[int | None, int]:
            key, n = _key(root, stream), 0
            own = f"{key}.{uuid.uuid4().hex}"
            with store.open_output_stream(own, compression="gzip") as out:
                for n, (_, line) in enumerate(rows, 1):
                    out.write(f"{line}\n".encode())
            store.move(own, key)
            return stream, n

        done = (install(*g) for g in itertools.groupby(_pairs(batches), operator.itemgetter(0)))
        while some := list(itertools.islice(done, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], ["stream", "records"])

    return put


def _get(objects: str) -> Run:
    """Receipts to rows (stream, line); an object that is missing, cut short or not of its receipt's records is an error."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(objects)

        def lines() -> Iterator[tuple[int | None, str]]:
            for stream, records in _pairs(batches):
                n = 0
                with store.open_input_stream(_key(root, stream), compression="gzip") as raw:
                    for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", newline="\n"), 1):
                        yield stream, line
                if n != records:
                    raise ValueError(f"{_key(root, stream)} has {n} records, its receipt {records}")

        def batch(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["stream", "value"])

        held: list[tuple[int | None, str]] = []
        size = 0
        for row in lines():
            held.append(row)
            size += len(row[1])
            if len(held) == ROWS or size >= CHARS:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return get


def write_logs(records: DataFrame, path: str) -> None:
    """records: stream, sequence, bytes. Rows are dealt by stream first, so each stream gets one object. What the path held is replaced."""
    line = F.to_json(F.struct("sequence", "bytes"), {"ignoreNullFields": "false"}).alias("value")
    sealed = records.withColumn("stream", F.col("stream").cast("long")).repartition("stream").sortWithinPartitions("stream", "sequence").select("stream", line)
    if not _opens(path):
        sealed.write.mode("overwrite").partitionBy("stream").text(path, compression="gzip")
        return
    store, root = fs.FileSystem.from_uri(f"{path}/objects")
    store.create_dir(root)
    store.delete_dir_contents(root)
    sealed.mapInArrow(_put(f"{path}/objects"), _RECEIPT).write.mode("overwrite").parquet(f"{path}/receipts")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    if _opens(path):
        raw = spark.read.schema(_RECEIPT).parquet(f"{path}/receipts").mapInArrow(_get(f"{path}/objects"), "stream long, value string")
    else:
        raw = spark.read.schema("value string, stream long").text(path)
    return raw.select("stream", F.from_json("value", "sequence long, bytes string").alias("r")).select("stream", "r.sequence", "r.bytes")
