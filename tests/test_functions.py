import posixpath

import pytest
from pyspark.sql import functions as F

from twinfold.functions.globs import BadGlob, any_of, compile_glob, python_pattern, validate_globs
from twinfold.functions.paths import escape_path, relative_path
from twinfold.functions.sizes import format_bytes, format_bytes_py, parse_size

# Size strings and what they mean, and strings that mean none.
SIZES = {"1k": 1000, "1K": 1000, "1kb": 1000, "1KB": 1000, "1M": 10**6, "1g": 10**9, "1T": 10**12, "1KiB": 1 << 10, "1MiB": 1 << 20, "1GiB": 1 << 30, "1TiB": 1 << 40, "1234": 1234, "1.5M": 1_500_000, "0.5K": 500, "0": 0, "0G": 0}


@pytest.mark.parametrize(("text", "size"), SIZES.items())
def test_sizes(text, size):
    assert parse_size(text) == size


@pytest.mark.parametrize("text", ["invalid", "abc", "1.5.5", "--100", "-1", "-1k", "-100M", "-0", "999999999999999999T", "99999999999999999999", ""])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        parse_size(text)


# Patterns, names, and whether they match.
GLOBS = [
    ("*.txt", "a.txt", True), ("*.txt", "a.txt\n", False), ("*.txt", ".txt", True), ("***", "anything", True), ("file?.txt", "file1.txt", True), ("file?.txt", "file.txt", False),
    ("[abc].txt", "b.txt", True), ("[^abc].txt", "b.txt", False), ("[!a]", "!", True), ("[a-c]x", "bx", True), ("{a,b}", "a", False), ("{a,b}", "{a,b}", True),
    ("\\*", "*", True), ("\\*", "a", False), ("[\\]]", "]", True), ("A", "a", False), (".*", ".git", True), ("a+b", "a+b", True), ("a.b", "axb", False),
]


@pytest.mark.parametrize(("glob", "name", "want"), GLOBS)
def test_globs(spark, glob, name, want):
    assert bool(python_pattern([glob]).match(name)) is want
    assert spark.createDataFrame([(name,)], "n string").select(F.col("n").rlike(any_of([glob]))).first()[0] is want


@pytest.mark.parametrize("glob", ["[invalid", "[]a]", "a\\", "[a-]"])
def test_bad_globs(glob):
    with pytest.raises(BadGlob):
        compile_glob(glob)
    with pytest.raises(BadGlob):
        validate_globs(["ok", glob])
    assert any_of([glob]) is None
    assert any_of([]) is None


def test_format_bytes(spark):
    shown = {0: "0 B", 9: "9 B", 10: "10 B", 1023: "1023 B", 1024: "1.0 KiB", 10 * 1024: "10 KiB", 8 << 40: "8.0 TiB", (5 << 40) + (100 << 30): "5.1 TiB"}
    rows = spark.createDataFrame([(n,) for n in shown], "n long").select("n", format_bytes(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == shown
    assert {n: format_bytes_py(n) for n in shown} == shown


def test_escape_and_relative(spark):
    assert spark.createDataFrame([("a\tb\nc\rd",)], "p string").select(escape_path(F.col("p"))).first()[0] == "a\\tb\\nc\\rd"
    pairs = [("/vol1/source.txt", "/vol2/target.txt"), ("/data/root.txt", "/data/subdir/nested.txt"), ("/a/b/c", "/a/b/d"), ("/a", "/b"), ("/a/b/c", "/a")]
    rows = spark.createDataFrame(pairs, "s string, t string").select("s", "t", relative_path(F.col("s"), F.col("t")).alias("r")).collect()
    assert all(r.r == posixpath.relpath(r.s, posixpath.dirname(r.t)) for r in rows)
