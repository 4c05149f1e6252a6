"""Screening: paths that share storage are siblings; sizes that two of them share are worth reading.

A very common size isn't gathered anywhere: only counts by size are shuffled, and the siblings are
joined with the sizes that count two or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sibling_key(trust_device: bool) -> list[str]:
    return ["size", "dev", "ino"] if trust_device else ["size", "ino"]


def by_size(listing: DataFrame) -> DataFrame:
    return listing.groupBy("size").agg(F.count("*").alias("n_files"), F.sum("size").cast("long").alias("bytes"))


def siblings(listing: DataFrame, trust_device: bool = False) -> DataFrame:
    """A row for each inode (by default whatever its device): its first path, that file's data, how many paths."""
    key = sibling_key(trust_device)
    raw = ["path_raw"] if "path_raw" in listing.columns else []
    rep = F.min(F.struct("path", *(F.col(c) for c in ("mtime_ns", "nlink", "dev")), *(F.col(c) for c in raw)))
    grouped = listing.groupBy(*key).agg(rep.alias("rep"), F.count("*").alias("n_paths"))
    return grouped.select(
        *key,
        F.concat_ws(":", *(F.col(c).cast("string") for c in key)).alias("sibling_id"),
        F.col("rep.path").alias("rep_path"),
        F.col("rep.mtime_ns").alias("rep_mtime_ns"),
        F.col("rep.nlink").alias("rep_nlink"),
        F.col("rep.dev").alias("rep_dev"),
        *(F.col(f"rep.{c}").alias(f"rep_{c}") for c in raw),
        "n_paths",
    )


def candidates(found: DataFrame) -> DataFrame:
    """Siblings whose size another inode shares."""
    shared = found.groupBy("size").agg(F.count("*").alias("n")).where("n >= 2").select("size")
    return found.join(shared, "size", "left_semi")


def screen(listing: DataFrame, trust_device: bool = False) -> DataFrame:
    return candidates(siblings(listing, trust_device))


def screen_stats(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.count("*").alias("n_inodes"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def members(listing: DataFrame, chosen: DataFrame, trust_device: bool = False) -> DataFrame:
    """The listing's rows of chosen siblings (sibling_id, group_id, rep_path, rep_nlink), each path of a sibling once."""
    key = sibling_key(trust_device)
    columns = [c for c in ("sibling_id", "group_id", "rep_path", "rep_nlink") if c in chosen.columns]
    rows = listing.drop("root_idx").dropDuplicates([*key, "path"])
    return rows.join(chosen.select(*key, *columns), key).withColumnRenamed("rep_path", "sibling_first_path")
