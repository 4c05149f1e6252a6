"""Schemas and options."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: dev and ino hold unsigned 64-bit numbers as their two's complement; only equality is used. mtime_ns keeps nanoseconds.
FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("path_raw", T.BinaryType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("dev", T.LongType()),
    T.StructField("ino", T.LongType()),
    T.StructField("nlink", T.LongType()),
    T.StructField("root_idx", T.IntegerType()),
])
CACHE_KEY = ("path", "file_size", "ino", "mtime_ns", "start", "len")
CACHE_VERSION = 1
HASH_CACHE = T.StructType([
    T.StructField("key_version", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("ino", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("len", T.LongType()),
    T.StructField("hash", T.BinaryType()),
])
ERRORS = T.StructType([T.StructField("stage", T.StringType()), T.StructField("path", T.StringType()), T.StructField("message", T.StringType())])

# The first probe and the chunk of progressive hashing, in bytes.
PROBE, CHUNK = 1 << 20, 1 << 30
HARDLINK, SYMLINK, SKIPPED = "hardlink", "symlink", "skipped"


@dataclass(frozen=True)
class DedupeOptions:
    min_size: str = "1"
    excludes: tuple[str, ...] = ()
    dry_run: bool = True
    verbose: bool = False
    symlink_fallback: bool = False
    trust_device_boundaries: bool = False
    cache_file: str | None = None
    path_priority: tuple[str, ...] = field(default=())
    probe: int = PROBE
    chunk: int = CHUNK
