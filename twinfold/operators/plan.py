"""Which copy to keep, and what to do with the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import priority
from ..model import HARDLINK, SKIPPED, SYMLINK


def sources(members: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """group_id, source, source_sibling, source_dev, source_mtime_ns.

    The first prefix that any path of the group begins with decides; under it the sibling with the smallest first
    path, and its smallest such path. Without a match: the most links, then the smallest first path.
    """
    keep = F.struct(F.col("path"), F.col("sibling_id"), F.col("dev"), F.col("mtime_ns"))
    pref = priority(F.col("path"), prefixes)
    by_prefix = F.min(F.when(pref.isNotNull(), F.struct(pref.alias("pref"), "sibling_first_path", keep.alias("keep"))))
    by_links = F.min(F.when(F.col("path") == F.col("sibling_first_path"), F.struct((-F.col("rep_nlink")).alias("links"), "sibling_first_path", keep.alias("keep"))))
    chosen = members.groupBy("group_id").agg(by_prefix.alias("p"), by_links.alias("l")).select("group_id", F.coalesce("p.keep", "l.keep").alias("k"))
    return chosen.select("group_id", F.col("k.path").alias("source"), F.col("k.sibling_id").alias("source_sibling"), F.col("k.dev").alias("source_dev"), F.col("k.mtime_ns").alias("source_mtime_ns"))


def plan(members: DataFrame, prefixes: Sequence[str] = (), symlink_fallback: bool = False) -> DataFrame:
    """A row for each path of each inode that isn't the source's: source, target, action, bytes_saved, err.

    dry_run_action is what a run without changes reports, a hardlink whatever the devices.
    """
    chosen = sources(members, prefixes)
    targets = members.join(chosen, "group_id").where(F.col("sibling_id") != F.col("source_sibling"))
    same = F.col("dev").eqNullSafe(F.col("source_dev"))
    action = F.when(same, HARDLINK).when(F.lit(symlink_fallback), SYMLINK).otherwise(SKIPPED)
    return targets.select(
        "group_id",
        "source",
        F.col("path").alias("target"),
        action.alias("action"),
        F.when(action == SKIPPED, F.lit(0).cast("long")).otherwise(F.col("size")).alias("bytes_saved"),
        F.when(action == SKIPPED, F.lit("cross-device link")).alias("err"),
        F.lit(HARDLINK).alias("dry_run_action"),
        "size",
        "mtime_ns",
        "source_mtime_ns",
    )


def dedupe_stats(actions: DataFrame) -> DataFrame:
    """Paths replaced, bytes saved, sets processed (a set counts even if all its targets failed)."""
    ok = F.col("err").isNull()
    return actions.agg(F.count_if(ok).alias("n_files"), F.coalesce(F.sum(F.when(ok, F.col("bytes_saved"))), F.lit(0)).cast("long").alias("bytes_saved"), F.countDistinct("group_id").alias("n_sets"))


def target_count(confirmed: DataFrame) -> DataFrame:
    """Paths that may be replaced: all but those of each group's first sibling."""
    groups = confirmed.groupBy("group_id").agg(F.sum("n_paths").alias("n"), F.min(F.struct("rep_path", "n_paths")).alias("first"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - F.col("first.n_paths")), F.lit(0)).cast("long").alias("n_targets"))


def stale(actions: DataFrame, now: DataFrame) -> DataFrame:
    """Targets that are gone or have another mtime in a fresh listing."""
    fresh = now.select(F.col("path").alias("target"), F.col("mtime_ns").alias("mtime_now")).dropDuplicates(["target"])
    return actions.join(fresh, "target", "left").where(~F.col("mtime_now").eqNullSafe(F.col("mtime_ns"))).select("source", "target", "mtime_ns", "mtime_now")
