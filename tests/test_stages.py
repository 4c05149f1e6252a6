"""Screening, ranges, verification, source selection on literal rows."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinfold.operators import cache, plan, screen, verify

FILE = "path string, size long, dev long, ino long, mtime_ns long, nlink long"


def files(spark, rows):
    return spark.createDataFrame([(p, s, d, i, 1, 1) for p, s, d, i in rows], FILE)


SCREENS = [
    ("two inodes", [("/a", 100, 1, 1), ("/b", 100, 1, 2)], 2, 2),
    ("hardlinks", [("/a", 100, 1, 1), ("/b", 100, 1, 1), ("/c", 100, 1, 2)], 2, 2),
    ("sizes", [("/a", 100, 1, 1), ("/b", 100, 1, 2), ("/c", 200, 1, 3)], 2, 2),
    ("one inode", [("/a", 100, 1, 1), ("/b", 100, 1, 1)], 0, 0),
    ("empty", [], 0, 0),
    ("unique", [("/a", 100, 1, 1), ("/b", 200, 1, 2)], 0, 0),
    ("devices", [("/mnt/1/f", 100, 1, 5000), ("/mnt/2/f", 100, 2, 5000)], 0, 2),
    ("large", [(f"/{k}", 100, 1, k) for k in range(100)], 100, 100),
]


@pytest.mark.parametrize(("rows", "by_ino", "by_dev"), [s[1:] for s in SCREENS], ids=[s[0] for s in SCREENS])
def test_screen(spark, rows, by_ino, by_dev):
    listing = files(spark, rows)
    assert screen.screen(listing).count() == by_ino
    assert screen.screen(listing, True).count() == by_dev


def steps(size, probe, chunk):
    """Ranges one after the other: head, tail, then chunks between them."""
    at, out = 0, [(0, min(probe, size))]
    at = min(probe, size)
    if at < size:
        n = min(probe, size - at)
        out.append((size - n, n))
        end = size - n
        while at < end:
            n = min(chunk, end - at)
            out.append((at, n))
            at += n
    return out


def test_range_plan(spark):
    for probe, chunk in ((4, 16), (3, 5), (1, 1)):
        sizes = spark.createDataFrame([(s,) for s in range(0, 80)], "size long")
        got = {}
        for r in verify.range_plan(sizes, probe, chunk).orderBy("size", "stage").collect():
            got.setdefault(r.size, []).append((r.start, r.len, r.total_bytes, r.done))
        for s in range(80):
            want, total = [], 0
            for start, n in steps(s, probe, chunk):
                total += n
                want.append((start, n, total, total == s))
            assert got[s] == want, (s, probe, chunk)
    p, c = verify.PROBE, verify.CHUNK
    big = [p - 1, p, p + 1, 2 * p - 1, 2 * p, 2 * p + 1, 2 * p + c, 2 * p + c + 1, 2 * p + 2 * c]
    got = {}
    for r in verify.range_plan(spark.createDataFrame([(s,) for s in big], "size long")).orderBy("size", "stage").collect():
        got.setdefault(r.size, []).append((r.start, r.len))
    assert got == {s: steps(s, p, c) for s in big}


def stage_tables(spark, texts):
    listing = spark.createDataFrame([(f"/{k:04d}", len(t), 1, k, 1, 1) for k, t in enumerate(texts)], FILE)
    content = spark.createDataFrame([(f"/{k:04d}", len(t), bytearray(t)) for k, t in enumerate(texts)], "path string, size long, content binary")
    return screen.screen(listing), content


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", max_size=14).map(str.encode), min_size=2, max_size=14))
def test_staged_is_one_pass(spark, texts):
    chosen, content = stage_tables(spark, texts)
    done = verify.staged(chosen, verify.table_hasher(content, 2, 3), None, 2, 3)
    groups = lambda df: sorted(sorted(r[0]) for r in df.groupBy("group_id").agg(F.collect_list("rep_path")).select("collect_list(rep_path)").collect())
    assert groups(done.confirmed) == groups(verify.one_pass(chosen, content))
    s = done.stats.agg(F.sum("verified"), F.sum("cached"), F.sum("skipped")).first()
    assert sum(s) == (chosen.agg(F.sum("size")).first()[0] or 0)


def test_cache_and_errors(spark):
    chosen, content = stage_tables(spark, [b"aaaaaa", b"aaaaaa", b"aaaaab", b"baaaaa"])
    hasher = verify.table_hasher(content, 2, 3)
    first = verify.staged(chosen, hasher, spark.createDataFrame([], cache.HASH_CACHE), 2, 3)
    assert first.stats.agg(F.sum("cached")).first()[0] == 0
    kept = verify.kept(cache.rewritten(first.hashes))
    again = verify.staged(chosen, hasher, kept, 2, 3)
    s = again.stats.agg(F.sum("verified"), F.sum("cached"), F.sum("skipped")).first()
    assert s[0] == 0 and s[1] + s[2] == 24
    assert {r.rep_path for r in again.confirmed.collect()} == {"/0000", "/0001"}
    moved = kept.withColumn("mtime_ns", F.col("mtime_ns") + 1)
    assert verify.staged(chosen, hasher, moved, 2, 3).stats.agg(F.sum("cached")).first()[0] == 0
    assert cache.valid(kept.withColumn("hash", F.substring("hash", 1, 5))).count() == 0
    broken = verify.staged(chosen, verify.table_hasher(content.where("path <> '/0000'"), 2, 3), None, 2, 3)
    assert [r.path for r in broken.errors.collect()] == ["/0000"]
    assert broken.confirmed.count() == 0


def test_sha256(spark):
    row = spark.createDataFrame([(bytearray(b"hello world"),)], "c binary").select(verify.content_hash("c", F.lit(0), F.lit(5))).first()[0]
    assert row == hashlib.sha256(b"hello").hexdigest()


def group(spark, rows):
    """rows: path, sibling, first path, nlink of the first path."""
    return spark.createDataFrame([("g", f"{s}", f, n, p, 1, 1, 100, 1) for p, s, f, n in rows], "group_id string, sibling_id string, sibling_first_path string, rep_nlink long, path string, dev long, ino long, size long, mtime_ns long")


SOURCES = [
    ([("/backup/f", 1, "/backup/f", 1), ("/archive/f", 2, "/archive/f", 1)], ["/archive"], "/archive/f"),
    ([("/backup/f", 1, "/backup/f", 1), ("/archive/f", 2, "/archive/f", 1)], ["/backup"], "/backup/f"),
    ([("/a", 1, "/a", 1), ("/b", 2, "/b", 3)], [], "/b"),
    ([("/b", 1, "/b", 1), ("/a", 2, "/a", 1)], [], "/a"),
    ([("/archive/f", 1, "/archive/f", 1), ("/backup/f", 2, "/backup/f", 5)], ["/archive"], "/archive/f"),
    ([("/a/x", 1, "/a/x", 2), ("/p/z", 1, "/a/x", 2), ("/b/y", 2, "/b/y", 2), ("/p/a", 2, "/b/y", 2)], ["/p"], "/p/z"),
]


@pytest.mark.parametrize(("rows", "prefixes", "want"), SOURCES)
def test_sources(spark, rows, prefixes, want):
    members = group(spark, rows)
    assert plan.sources(members, prefixes).first().source == want
    actions = plan.plan(members, prefixes).collect()
    mine = next(s for p, s, _, _ in rows if p == want)
    assert {a.target for a in actions} == {p for p, s, _, _ in rows if s != mine}
