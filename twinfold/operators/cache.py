"""The hash cache: a Parquet table on any file system that Spark reaches, looked up by a left join and rewritten by each run with what it used."""

from __future__ import annotations

import os
import threading
import time
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CACHE_KEY, CACHE_VERSION, HASH_CACHE


def valid(cache: DataFrame) -> DataFrame:
    """Entries of this version with a whole SHA-256, one for each key."""
    at = cache.where((F.col("key_version") == CACHE_VERSION) & (F.octet_length("hash") == 32))
    return at.groupBy(*CACHE_KEY).agg(F.min("hash").alias("hash"))


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (rep_path, size, ino, rep_mtime_ns, start, len) with cached_hash in hex, null on a miss: any changed field misses."""
    names = {"path": "rep_path", "file_size": "size", "mtime_ns": "rep_mtime_ns"}
    known = valid(cache).select(*(F.col(c).alias(names.get(c, c)) for c in CACHE_KEY), F.lower(F.hex("hash")).alias("cached_hash"))
    return requests.join(known, [names.get(c, c) for c in CACHE_KEY], "left")


def rewritten(hashes: DataFrame) -> DataFrame:
    """The next cache: hits and new hashes of this run, nothing else."""
    return hashes.select(F.lit(CACHE_VERSION).alias("key_version"), *CACHE_KEY, "hash").where(F.octet_length("hash") == 32).dropDuplicates(list(CACHE_KEY))


#: Seconds that a second writer waits; a lock is renewed by its owner each BEAT seconds and counts as left behind after STALE.
WAIT, BEAT, STALE = 1.0, 10.0, 60.0


class Store:
    """A place on a file system of Spark's; a plain path is one of the driver's, as the file system of the session's default may be another."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.uri = spark._jvm, path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, suffix: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(self.uri.rstrip("/") + suffix)

    def exists(self, suffix: str = "") -> bool:
        return self.fs.exists(self.at(suffix))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; an absent or unreadable one is empty. All of its files are read once here, so that none fails a later job."""
    store = Store(spark, path)
    if store.exists():
        cache = spark.read.schema(HASH_CACHE).parquet(store.uri)
        try:
            cache.agg(F.sum(F.octet_length("hash"))).first()
            return cache
        except (PySparkException, Py4JError):
            pass
    return spark.createDataFrame([], HASH_CACHE)


@contextmanager
def single_writer(spark: SparkSession, path: str, wait: float = WAIT, stale: float = STALE):
    """Holds path.lock; a second writer fails after a short wait. The lock of a run that was killed is taken over once it is stale."""
    store = Store(spark, path)
    lock, until, done = store.at(".lock"), time.time() + wait, threading.Event()
    store.fs.mkdirs(lock.getParent())
    while not store.fs.createNewFile(lock):
        try:
            old = time.time() * 1000 - store.fs.getFileStatus(lock).getModificationTime() > stale * 1000
        except Py4JError:  # it went meanwhile
            continue
        if old:
            store.fs.delete(lock, False)
        elif time.time() >= until:
            raise RuntimeError(f"cache {path} is in use")
        else:
            time.sleep(min(0.1, wait))

    def renew() -> None:
        while not done.wait(BEAT):
            store.fs.create(lock, True).close()  # a new modification time on any file system

    beat = threading.Thread(target=renew, daemon=True)
    beat.start()
    try:
        yield
    finally:
        done.set()
        beat.join()
        store.fs.delete(lock, False)


def commit(cache: DataFrame, path: str) -> None:
    """Writes path.new, then puts it in the old one's place."""
    store = Store(cache.sparkSession, path)
    cache.write.mode("overwrite").parquet(store.uri.rstrip("/") + ".new")
    store.fs.delete(store.at(".old"), True)
    if store.exists():
        store.fs.rename(store.at(), store.at(".old"))
    store.fs.rename(store.at(".new"), store.at())
    store.fs.delete(store.at(".old"), True)
