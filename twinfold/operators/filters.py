"""Filters and statistics of a listing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import any_of
from ..functions.paths import basename, directories


def large_enough(min_size: int) -> Column:
    return F.col("size") >= F.lit(min_size)


def not_excluded(globs: Iterable[str]) -> Column:
    """The file's own name matches no glob."""
    pattern = any_of(globs)
    return ~basename(F.col("path")).rlike(pattern) if pattern else F.lit(True)


def not_pruned(globs: Iterable[str], below: str = "/") -> Column:
    """No directory between the root and the file matches a glob; the root's own name isn't tested."""
    pattern = any_of(globs)
    rest = F.substring(F.col("path"), len(below.rstrip("/")) + 1, 1 << 30)
    return ~F.exists(directories(rest), lambda name: name.rlike(pattern)) if pattern else F.lit(True)


def scan_stats(listing: DataFrame, matched: Column) -> DataFrame:
    """One row: files and bytes listed, and those that match; repeated rows count as often."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return listing.agg(
        F.count("*").alias("n_scanned"),
        zero(F.sum("size")).alias("bytes_scanned"),
        F.count_if(matched).alias("n_matched"),
        zero(F.sum(F.when(matched, F.col("size")))).alias("bytes_matched"),
    )
