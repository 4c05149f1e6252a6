"""Verification: equal content by SHA-256, in stages that stop reading what is already alone.

Stage 0 reads the head, stage 1 the tail, later stages chunks in between; every byte is in one range. A group is
the chain of all hashes so far and the size, so groups only ever split. A round hashes one
representative of each inode, drops inodes that are alone in their group, and hands those that still have bytes
to the next. The first rounds are of one stage; from stage 3 on each is of twice as many, so contents that first differ after n
bytes are read to 2n at most, and the number of jobs grows with the logarithm of the largest size.
Between rounds the survivors are checkpointed (reliably: spark.checkpoint.dir).
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CHUNK, PROBE


def n_stages(size: Column, probe: int = PROBE, chunk: int = CHUNK) -> Column:
    more = F.ceil((size - 2 * probe) / F.lit(chunk)).cast("long")
    return F.when(size <= probe, F.lit(1).cast("long")).when(size <= 2 * probe, 2).otherwise(more + 2)


def range_columns(size: Column, stage: Column, probe: int = PROBE, chunk: int = CHUNK) -> tuple[Column, Column, Column]:
    """start, len and bytes known after a stage."""
    p, at = F.lit(probe).cast("long"), F.lit(probe).cast("long") + (stage - 2) * F.lit(chunk).cast("long")
    start = F.when(stage == 0, F.lit(0).cast("long")).when(stage == 1, F.greatest(p, size - p)).otherwise(at)
    length = F.when(stage == 0, F.least(p, size)).when(stage == 1, F.least(p, size - p)).otherwise(F.least(F.lit(chunk).cast("long"), size - p - at))
    total = F.when(stage == 0, length).when(stage == 1, p + length).otherwise(p + at + length)
    return start, length, total


def range_plan(sizes: DataFrame, probe: int = PROBE, chunk: int = CHUNK) -> DataFrame:
    """size, stage, start, len, total_bytes, done: a row for each range of each size."""
    at = sizes.select("size", F.explode(F.sequence(F.lit(0).cast("long"), n_stages(F.col("size"), probe, chunk) - 1)).alias("stage"))
    start, length, total = range_columns(F.col("size"), F.col("stage"), probe, chunk)
    return at.select("size", "stage", start.alias("start"), length.alias("len"), total.alias("total_bytes"), (total == F.col("size")).alias("done"))


def content_hash(content: str, start: Column, length: Column) -> Column:
    return F.sha2(F.substring(F.col(content), (start + 1).cast("int"), length.cast("int")), 256)


def hash_contents(contents: DataFrame, stage: int, probe: int = PROBE, chunk: int = CHUNK) -> DataFrame:
    """path, start, len, hash of one stage's range of every content long enough; contents: path, size, content."""
    start, length, _ = range_columns(F.col("size"), F.lit(stage), probe, chunk)
    at = contents.where(n_stages(F.col("size"), probe, chunk) > stage)
    return at.select("path", start.alias("start"), length.alias("len"), content_hash("content", start, length).alias("hash"))


Hasher = Callable[[DataFrame, int], DataFrame]


class TableHasher:
    """Requests with hash, n_read, error, from a table of contents: it is hashed where it is read, only hashes are shuffled. Once
    the probes have ruled out most, only the contents of the survivors are kept and read."""

    def __init__(self, contents: DataFrame, probe: int, chunk: int):
        self.contents, self.probe, self.chunk, self.narrowed = contents, probe, chunk, False

    def __call__(self, requests: DataFrame, first: int) -> DataFrame:
        if first >= 2 and not self.narrowed:
            self.contents, self.narrowed = kept(self.contents.join(requests.select(F.col("rep_path").alias("path")).distinct(), "path", "left_semi")), True
        last = first + round_length(first)
        stages = F.sequence(F.lit(first).cast("long"), F.least(n_stages(F.col("size"), self.probe, self.chunk), F.lit(last)) - 1)

        def one(stage: Column) -> Column:
            start, length, _ = range_columns(F.col("size"), stage, self.probe, self.chunk)
            return F.struct(stage.alias("stage"), content_hash("content", start, length).alias("hash"))

        at = self.contents.where(n_stages(F.col("size"), self.probe, self.chunk) > first)
        hashed = at.select(F.col("path").alias("rep_path"), F.inline(F.transform(stages, one)))
        done = requests.join(hashed, ["rep_path", "stage"], "left")
        return done.withColumn("n_read", F.when(F.col("hash").isNotNull(), F.col("len"))).withColumn("error", F.when(F.col("hash").isNull(), F.lit("no content")))


def table_hasher(contents: DataFrame, probe: int = PROBE, chunk: int = CHUNK) -> Hasher:
    return TableHasher(contents, probe, chunk)


def round_length(first: int) -> int:
    """Stages of the round that begins with a stage: 0, 1, 2, 3-4, 5-8, 9-16, ..."""
    return 1 if first < 3 else first - 1


def file_hasher(requests: DataFrame, first: int) -> DataFrame:
    from ..sources.files import hash_files

    return hash_files(requests.withColumnRenamed("rep_path_raw", "path_raw")).withColumnRenamed("path_raw", "rep_path_raw")


def one_pass(chosen: DataFrame, contents: DataFrame) -> DataFrame:
    """chosen with hash and group_id where another inode has the same size and content; each content is hashed once, whole."""
    hashed = contents.select(F.col("path").alias("rep_path"), F.sha2("content", 256).alias("hash"))
    at = chosen.join(hashed, "rep_path")
    shared = at.groupBy("size", "hash").agg(F.count("*").alias("n")).where("n >= 2").select("size", "hash")
    return at.join(shared, ["size", "hash"], "left_semi").withColumn("group_id", F.concat_ws(":", F.col("size").cast("string"), "hash"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="twinfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The folder as a path of the file system that processes have mounted, whether its name has a scheme or not; None if it lies on another."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    found = system.resolvePath(at).toUri()
    return found.getPath() if found.getScheme() == "file" else None


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@dataclass
class Verified:
    confirmed: DataFrame  # chosen's columns and group_id
    stats: DataFrame  # one row a stage: stage, verified, cached, skipped, eliminated
    errors: DataFrame  # stage, path, message
    hashes: DataFrame  # path, file_size, ino, mtime_ns, start, len, hash, cached


def staged(chosen: DataFrame, hasher: Hasher, cache: DataFrame | None = None, probe: int = PROBE, chunk: int = CHUNK) -> Verified:
    """Progressive verification. cache: known hashes by path, file_size, ino, mtime_ns, start, len. stats: verified and cached bytes of
    each stage, skipped (never read, of the inodes that the stage eliminates) and eliminated.

    An inode of which a range can't be read is dropped with an error; it counts in no figure.
    """
    from .cache import lookup

    columns = [*chosen.columns, "group_id"]
    open_ = kept(chosen.withColumn("group_id", F.col("size").cast("string")))
    confirmed, stats, errors, hashes, first = [], [], [], [], 0
    size = F.col("size")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    while True:
        last = first + round_length(first)
        of_row = F.least(n_stages(size, probe, chunk), F.lit(last)) - 1
        start, length, _ = range_columns(size, F.col("stage"), probe, chunk)
        asked = open_.withColumn("stage", F.explode(F.sequence(F.lit(first).cast("long"), of_row))).withColumn("start", start).withColumn("len", length)
        if cache is not None:
            asked = kept(lookup(asked, cache))
            known, asked = asked.where("cached_hash is not null"), asked.where("cached_hash is null").drop("cached_hash")
            known = known.withColumnRenamed("cached_hash", "hash").withColumn("n_read", F.lit(0).cast("long")).withColumn("error", F.lit(None).cast("string")).withColumn("cached", F.lit(True))
            done = hasher(asked, first).withColumn("cached", F.lit(False)).unionByName(known)
        else:
            done = hasher(asked, first).withColumn("cached", F.lit(False))
        done = kept(done)
        errors.append(done.where("error is not null").groupBy(F.lit("verify").alias("stage"), F.col("rep_path").alias("path")).agg(F.min("error").alias("message")))
        # the chain of hashes after each stage of the round; an inode with an unread range has none
        parts = F.array_sort(F.collect_list(F.struct("stage", "hash", "start", "len", "n_read", "cached")))
        rows = done.groupBy("sibling_id").agg(*(F.first(c).alias(c) for c in columns if c != "sibling_id"), parts.alias("parts"), F.count("error").alias("failed")).where("failed = 0")
        chain = F.aggregate("parts", F.array("group_id"), lambda g, p: F.concat(g, F.array(F.sha2(F.concat_ws(":", F.element_at(g, -1), p["hash"]), 256))))
        rows = rows.withColumn("chain", F.slice(chain, 2, F.size("parts")))
        at_stage = rows.select("sibling_id", F.posexplode("chain").alias("k", "gid"))
        shared = at_stage.groupBy("k", "gid").agg(F.count("*").alias("n"))
        alone = at_stage.join(shared.where("n < 2"), ["k", "gid"]).groupBy("sibling_id").agg(F.min("k").alias("alone_at"))
        rows = kept(rows.join(alone, "sibling_id", "left").withColumn("group_id", F.element_at("chain", -1)).drop("chain", "failed"))
        flat = rows.select(*columns, "alone_at", F.posexplode("parts").alias("k", "p")).select("*", "p.*")
        hashes.append(flat.select(F.col("rep_path").alias("path"), size.alias("file_size"), "ino", F.col("rep_mtime_ns").alias("mtime_ns"), "start", "len", F.unhex("hash").alias("hash"), "cached"))
        _, _, read = range_columns(size, of_row, probe, chunk)
        here = F.col("alone_at") == F.col("k")
        stats.append(flat.groupBy("stage").agg(zero("n_read").alias("verified"), zero(F.when(F.col("cached"), F.col("len"))).alias("cached"), zero(F.when(here, size - read)).alias("skipped"), F.count_if(here).alias("eliminated")))
        together, whole = F.col("alone_at").isNull(), n_stages(size, probe, chunk) <= last
        confirmed.append(rows.where(together & whole).select(*columns))
        open_ = rows.where(together & ~whole).select(*columns)
        first = last
        if open_.isEmpty():
            break

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    nothing = chosen.sparkSession.createDataFrame([(0, 0, 0, 0, 0)], "stage long, verified long, cached long, skipped long, eliminated long")
    total = nothing.unionByName(union(stats)).groupBy(F.col("stage").cast("int").alias("stage")).agg(*(F.sum(c).alias(c) for c in ("verified", "cached", "skipped", "eliminated")))
    return Verified(union(confirmed), total, union(errors), union(hashes))


def confirmed_stats(confirmed: DataFrame) -> DataFrame:
    """Inodes, bytes and sets confirmed; the one that is kept of each set doesn't count."""
    sets = confirmed.groupBy("group_id", "size").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sets.agg(zero(F.col("n") - 1).alias("n_inodes"), zero((F.col("n") - 1) * F.col("size")).alias("bytes"), F.count("*").alias("n_sets"))


def percent(part: Column, total: Column) -> Column:
    """The share of the total in percent; 0 of nothing."""
    return F.when(total > 0, 100.0 * part / total).otherwise(F.lit(0.0))
