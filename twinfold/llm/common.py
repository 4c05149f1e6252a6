"""Shared pieces: tables, durable intermediate results, Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into word arrays at once (a single longer text is one slice, whose bytes
#: are expanded piece by piece; see wordhash).
SLICE_BYTES = 1 << 20


#: Bytes that travel to Python at once; Spark's own default holds tens of MB of texts several times over.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that gives back what it has freed after each batch and at the end: idle workers stay for a minute and
    count, beside the JVM, as memory of their executor."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(fed())
        finally:
            give_back()

    return lean_run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="twinfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/twinfold/{name}-{uuid.uuid4().hex}"


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors cost nothing that is written. The shuffle
    files of the writing job go when it ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = path or new_path(spark, name)
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Durable tables of one operator. On leaving, or on an error, all go but those that its lazy result still reads (kept)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths[path] = None
        out = durable(df, name, path)
        self.paths[path] = out
        return out

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return durable(df, name)

    def drop(self, *tables: DataFrame) -> None:
        """These tables go at once."""
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            delete(self.spark, path)
            del self.paths[path]

    def __exit__(self, *_) -> None:
        for path in self.paths:
            with contextlib.suppress(Exception):  # what can't be deleted must not hide the error that led here
                delete(self.spark, path)


#: A key is common if more than one in so many rows has it; so there are at most as many common keys.
COMMON_SHARE = 2_000


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_semi) with keyed, which has one row for each key and n, the key's number of rows among
    the total. Common keys are broadcast, so their rows stay where they are; the others are dealt out by key."""
    limit = total // COMMON_SHARE
    common = F.broadcast(keyed.where(F.col("n") > limit).drop("n"))
    rare = keyed.where(F.col("n") <= limit).drop("n")
    return rows.join(common, on, "inner" if how == "left" else how).unionByName(rows.join(common, on, "left_anti").join(rare, on, how))


#: Ids of rows are broadcast up to so many (8 bytes each); beyond, they are joined like any other table.
BROADCAST_IDS = 200_000


def chosen(rows: DataFrame, ids: DataFrame, on: str, n: int, but: bool = False) -> DataFrame:
    """The rows whose id is (or, with but, isn't) among n distinct ids."""
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, "left_anti" if but else "left_semi")


#: Partial sums that meet in one task.
SUM_FAN = 16


def packed(array: np.ndarray) -> bytes:
    return zlib.compress(array.tobytes(), 1)


def tree_sum(parts: DataFrame, dtype, scratch: Scratch) -> np.ndarray | None:
    """The sum of arrays of one size, each packed in a row of the only column of parts. Sixteen meet in a task, and
    so on by rounds, so that no task and not the driver reads more than sixteen at once."""
    name = parts.columns[0]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column(0):
                part = np.frombuffer(zlib.decompress(one.as_py()), dtype)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)])], names=[name])

    parts = scratch.table(parts, "partial-sums")
    n = parts.count()
    while n > SUM_FAN:
        groups = math.ceil(n / SUM_FAN)
        parts = scratch.table(parts.repartition(groups).mapInArrow(lean(merge), f"{name} binary"), "partial-sums")
        n = min(groups, parts.count())
    total = None
    for row in parts.collect():
        part = np.frombuffer(zlib.decompress(bytes(row[0])), dtype)
        total = part.copy() if total is None else total + part
    return total


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets into them) for slices of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def arrow_batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)
