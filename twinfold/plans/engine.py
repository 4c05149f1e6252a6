"""The whole run: scan, screen, verify, plan, and on request apply."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import validate_globs
from ..functions.sizes import format_bytes_py, parse_size
from ..model import ERRORS, DedupeOptions
from ..operators import cache as caches
from ..operators import filters, plan, screen, verify
from ..operators.apply import Result, apply


@dataclass
class Run:
    actions: DataFrame | None
    errors: DataFrame
    summaries: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, options: DedupeOptions = DedupeOptions()):
        self.spark, self.options = spark, options
        self.min_size = parse_size(options.min_size)
        validate_globs(options.excludes)

    def run(self, paths: list[str], act: bool = False, on_result: Callable[[Result], None] | None = None, on_summary: Callable[[str], None] | None = None) -> Run:
        """Plans for the trees at paths; with act, walks the plan (changing nothing if dry_run). Results, and the summary of each
        stage, are told as they come."""
        from ..sources.files import scan

        options, began = self.options, time.time()
        rows = scan(self.spark, paths, 0, options.excludes)
        errors = rows.where("error is not null").select(F.lit("scan").alias("stage"), "path", F.col("error").alias("message"))
        rows = rows.where("error is null").drop("error")
        out = Run(None, self.spark.createDataFrame([], ERRORS).unionByName(errors))

        def note(line: str) -> None:
            out.summaries.append(line)
            if on_summary is not None:
                on_summary(line)

        s = filters.scan_stats(rows, filters.large_enough(self.min_size)).first()
        note(f"Scanned {s['n_scanned']} files ({format_bytes_py(s['bytes_scanned'])}), matched {s['n_matched']} ({format_bytes_py(s['bytes_matched'])}) in {time.time() - began:.1f}s")
        rows = rows.where(filters.large_enough(self.min_size))
        if not s["n_matched"]:
            return out
        began = time.time()
        chosen = verify.kept(screen.screen(rows, options.trust_device_boundaries))
        s = screen.screen_stats(chosen).first()
        note(f"Selected {s['n_inodes']} candidates ({format_bytes_py(s['bytes'])}) in {time.time() - began:.1f}s")
        if not s["n_inodes"]:
            return out
        began, total = time.time(), s["bytes"]
        if options.cache_file:
            with caches.single_writer(self.spark, options.cache_file):
                done = verify.staged(chosen, verify.file_hasher, caches.open_cache(self.spark, options.cache_file), options.probe, options.chunk)
                caches.commit(caches.rewritten(done.hashes), options.cache_file)
        else:
            done = verify.staged(chosen, verify.file_hasher, None, options.probe, options.chunk)
        out.errors = out.errors.unionByName(done.errors)
        share = verify.percent(F.sum("skipped"), F.lit(total)).alias("share")
        v = done.stats.agg(*(F.sum(c).alias(c) for c in ("verified", "cached", "skipped")), share).first()
        c = verify.confirmed_stats(done.confirmed).first()
        known = f" ({format_bytes_py(v['cached'])} cached)" if v["cached"] else ""
        note(f"Verified {format_bytes_py(v['verified'])}{known}, skipped {format_bytes_py(v['skipped'])} ({v['share']:.0f}%), confirmed {c['n_inodes']} duplicates ({format_bytes_py(c['bytes'])}) in {c['n_sets']} sets in {time.time() - began:.1f}s")
        began = time.time()
        found = screen.members(rows, done.confirmed, options.trust_device_boundaries)
        out.actions = verify.kept(plan.plan(found, options.path_priority or tuple(paths), options.symlink_fallback))
        if act:
            ok = n = saved = 0
            for result in apply(out.actions, options.dry_run, options.symlink_fallback):
                n, ok, saved = n + 1, ok + (result.err is None), saved + (result.bytes_saved if result.err is None else 0)
                if on_result is not None:
                    on_result(result)
            note(f"Processed {ok}/{n} files in {c['n_sets']} sets, saved {format_bytes_py(saved)} in {time.time() - began:.1f}s")
        return out


def main(argv: list[str] | None = None) -> int:
    import argparse

    parser = argparse.ArgumentParser("twinfold", description="Finds files with equal content and plans their replacement by links.")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("-m", "--min-size", default="1")
    parser.add_argument("-e", "--exclude", action="append", default=[], help="glob on names; repeatable, commas separate")
    parser.add_argument("-w", "--workers", type=int, help="tasks at once in local mode")
    parser.add_argument("--no-progress", action="store_true")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("-n", "--dry-run", action="store_true")
    parser.add_argument("--symlink-fallback", action="store_true")
    parser.add_argument("--trust-device-boundaries", action="store_true")
    parser.add_argument("--cache-file")
    parser.add_argument("--version", action="version", version="twinfold 1")
    args = parser.parse_args(argv)
    options = DedupeOptions(args.min_size, tuple(g for e in args.exclude for g in e.split(",") if g), args.dry_run, args.verbose, args.symlink_fallback, args.trust_device_boundaries, args.cache_file, tuple(args.paths))
    builder = SparkSession.builder.config("spark.ui.showConsoleProgress", str(not args.no_progress).lower()).config("spark.sql.python.filterPushdown.enabled", "true")
    spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
    clean = lambda p: p.replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")

    def tell(r: Result) -> None:
        print(f"skipped {clean(r.target)}: {r.err}" if r.err else f"Replaced {clean(r.target)} with {r.action} to {clean(r.source)}")

    try:
        run = Engine(spark, options).run(args.paths, True, tell if args.verbose else None, lambda line: print(line, file=sys.stderr, flush=True))
    except (ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    for row in run.errors.toLocalIterator():
        print(f"{row['stage']}: {row['path']}: {row['message']}", file=sys.stderr)
    return 0
