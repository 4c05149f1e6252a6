"""Files on a mounted file system: a Python data source that lists trees, and hashes of byte ranges.

Listing by scan: rounds of tasks. A task walks its directories until it has listed BUDGET of them; those still open then are
dealt out among the tasks of the next round, so a deep or large subtree is shared out wherever it lies. The data source by itself has one
round: the driver expands the roots level by level until there are enough directories to share out, and each task walks its own. Hidden and empty files are rows; links, pipes, sockets and devices are not; a directory that
can't be listed contributes an error row instead of files. A root's own name is never tested for exclusion.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

from ..functions.globs import python_pattern
from ..model import FILES

BLOCK = 64 << 10
BATCH = 1000
#: Directories to share out, at least, if there are as many (data source alone).
FAN_OUT = 64
#: Directories that a task lists in a round, and tasks of a round at most.
BUDGET, MOST_TASKS = 2000, 20_000
#: Bytes that a task hashes, unless one range has more.
HASH_BYTES = 4 << 30
#: pending: a directory that is still to be walked.
SCHEMA = T.StructType([*FILES.fields, T.StructField("error", T.StringType()), T.StructField("pending", T.BooleanType())])
_MASK = (1 << 64) - 1


def signed(n: int) -> int:
    n &= _MASK
    return n - (1 << 64) if n >> 63 else n


class Directory(InputPartition):
    def __init__(self, path: bytes, root_idx: int, deep: bool):
        self.path, self.root_idx, self.deep = path, root_idx, deep


def scan_directory(path: bytes, excluded) -> tuple[list[os.DirEntry], list[bytes]]:
    """Regular files and subdirectories, those of excluded names left out."""
    files, below = [], []
    with os.scandir(path) as entries:
        for entry in entries:
            name = os.fsdecode(entry.name)
            if entry.is_dir(follow_symlinks=False):
                if not (excluded and excluded.match(name)):
                    below.append(entry.path)
            elif entry.is_file(follow_symlinks=False) and not (excluded and excluded.match(name)):
                files.append(entry)
    return files, below


def walk(open_: list[tuple[bytes, int]], excluded, min_size: int, budget: int, deep: bool = True) -> Iterator[tuple]:
    """Rows of the directories and of what is below them; after budget directories (0: no limit) rows of those still open."""
    listed = 0
    while open_:
        if budget and listed >= budget:
            yield from ((path.decode("utf-8", "replace"), path, None, None, None, None, None, root, None, True) for path, root in open_)
            return
        path, root = open_.pop()
        listed += 1
        try:
            if not stat.S_ISDIR(os.lstat(path).st_mode):
                raise NotADirectoryError(f"not a directory: {os.fsdecode(path)!r}")
            files, below = scan_directory(path, excluded)
        except OSError as e:
            yield (path.decode("utf-8", "replace"), path, None, None, None, None, None, root, str(e), False)
            continue
        if deep:
            open_ += [(d, root) for d in below]
        for entry in files:
            try:
                s = entry.stat(follow_symlinks=False)
            except OSError:
                continue
            if s.st_size >= min_size:
                yield (entry.path.decode("utf-8", "replace"), entry.path, s.st_size, s.st_mtime_ns, signed(s.st_dev), signed(s.st_ino), s.st_nlink, root, None, False)


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.fsencode(os.path.abspath(p)) for p in options["roots"].split("\0") if p]
        self.globs = [g for g in options.get("excludes", "").split("\0") if g]
        self.min_size, self.budget = int(options.get("minSize", "0")), int(options.get("budget", "0"))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("size",):
                self.min_size = max(self.min_size, f.value + isinstance(f, GreaterThan))
            yield f  # Spark tests all of them again: error rows have no size

    def partitions(self):
        excluded, out = python_pattern(self.globs), []
        level = [(root, k) for k, root in enumerate(self.roots)]
        while level and len(level) < FAN_OUT and not self.budget:
            below = []
            for path, k in level:
                out.append(Directory(path, k, False))
                try:
                    below += [(d, k) for d in scan_directory(path, excluded)[1]]
                except OSError:
                    pass  # the task that lists it reports it
            level = below
        return out + [Directory(path, k, True) for path, k in level]

    def read(self, partition):
        if partition is None:  # there are no roots
            return
        yield from walk([(partition.path, partition.root_idx)], python_pattern(self.globs), self.min_size, self.budget, partition.deep)


class FilesSource(DataSource):
    """spark.read.format("files").option("roots", "/a\\0/b").option("excludes", "*.bak").load()"""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FilesReader(dict(self.options))


def scan(spark: SparkSession, paths: list[str], min_size: int = 0, excludes: tuple[str, ...] = (), budget: int = BUDGET) -> DataFrame:
    """The listing, with a column error that is null but in rows of directories that couldn't be listed. Each round is checkpointed."""
    from ..operators.verify import kept

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilesSource)
    options = {"roots": "\0".join(paths), "excludes": "\0".join(excludes), "minSize": str(min_size), "budget": str(budget)}
    rows = kept(spark.read.format("files").options(**options).load())
    globs, names = list(excludes), SCHEMA.names
    kinds = [pa.string(), pa.binary(), *[pa.int64()] * 5, pa.int32(), pa.string(), pa.bool_()]

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        found = walk(open_, python_pattern(globs), min_size, budget)
        while part := list(itertools.islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    out = rows.where("not pending")
    while n := rows.where("pending").count():
        rows = kept(rows.where("pending").select("path_raw", "root_idx").repartition(min(n, MOST_TASKS)).mapInArrow(go_on, SCHEMA))
        out = out.unionByName(rows.where("not pending"))
    return out.drop("pending")


def hash_range(path: bytes, start: int, length: int) -> tuple[str, int]:
    """SHA-256 in hex of up to length bytes from start, and how many there were."""
    digest, left = hashlib.sha256(), length
    with open(path, "rb") as file:
        file.seek(start)
        while left > 0 and (block := file.read(min(BLOCK, left))):
            digest.update(block)
            left -= len(block)
    return digest.hexdigest(), length - left


def hash_files(requests: DataFrame) -> DataFrame:
    """requests (with path_raw, start, len) and hash, n_read, error; a file that can't be read gives an error, not a failed task.

    Work is dealt out by bytes: each range of HASH_BYTES or more is a task's only one, the others share tasks of about so many bytes."""
    schema = T.StructType([*requests.schema.fields, T.StructField("hash", T.StringType()), T.StructField("n_read", T.LongType()), T.StructField("error", T.StringType())])
    at = [requests.columns.index(c) for c in ("path_raw", "start", "len")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, start, length in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                try:
                    out.append((*hash_range(path, start, length), None))
                except OSError as e:
                    out.append((None, None, str(e)))
            columns = [[row[k] for row in out] for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=schema.names)

    large = F.col("len") >= HASH_BYTES
    n = requests.agg(F.count_if(large).alias("large"), F.coalesce(F.sum(F.when(~large, F.col("len"))), F.lit(0)).alias("bytes"), F.count_if(~large).alias("small")).first()
    parts = max(1, min(n["small"], max(n["bytes"] // HASH_BYTES + 1, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    dealt = requests.where(~large).repartition(parts).mapInArrow(run, schema)
    return dealt.unionByName(requests.where(large).repartition(n["large"]).mapInArrow(run, schema)) if n["large"] else dealt
