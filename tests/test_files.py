"""The whole engine on trees of real files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from twinfold.model import DedupeOptions
from twinfold.operators import apply as apply_
from twinfold.operators import cache
from twinfold.plans.engine import Engine, main
from twinfold.sources import files
from twinfold.sources.files import hash_range, scan


def sow(root, **files):
    for name, text in files.items():
        path = os.path.join(root, name.replace("__", "/").replace("_dot_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as file:
            file.write(text)


def ino(path):
    return os.stat(path).st_ino


def test_scan(spark, tmp_path):
    root = str(tmp_path / "r")
    sow(root, a_dot_txt=b"1", b_dot_bak=b"22", _dot_hidden=b"3", empty=b"", skip__x=b"4", **{"with space__ü": b"5"})
    os.symlink(root + "/a.txt", root + "/link")
    os.mkfifo(root + "/pipe")
    with open(os.fsencode(root) + b"/bad\xff", "wb") as file:
        file.write(b"6")
    rows = scan(spark, [root, root + "/skip", root + "/a.txt", root + "/none"], 0, ("*.bak", "skip")).collect()
    names = sorted((r.path_raw[len(root) :], r.root_idx) for r in rows if r.error is None)
    assert names == sorted([(b"/a.txt", 0), (b"/.hidden", 0), (b"/empty", 0), ("/with space/ü".encode(), 0), (b"/bad\xff", 0), (b"/skip/x", 1)])
    assert {r.root_idx for r in rows if r.error is not None} == {2, 3}
    assert scan(spark, [root]).where("size >= 2").count() == 1


@pytest.mark.parametrize("budget", [1, 3, 100])
def test_scan_shares_out_deep_trees(spark, tmp_path, budget):
    deep = "/".join("d" for _ in range(9))
    sow(str(tmp_path), **{f"{deep}/f{k}": b"x" for k in range(3)}, **{f"w{k}/g": b"y" for k in range(12)}, top=b"z")
    rows = scan(spark, [str(tmp_path)], budget=budget).collect()
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in rows) == sorted([*(f"{deep}/f{k}" for k in range(3)), *(f"w{k}/g" for k in range(12)), "top"])
    assert scan(spark, []).count() == 0


def test_hashing_is_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HASH_BYTES", 1000)
    sow(str(tmp_path), **{f"f{k}": bytes([k]) * (3000 if k < 2 else 10) for k in range(20)})
    requests = spark.createDataFrame([(bytearray(os.fsencode(f"{tmp_path}/f{k}")), 0, 3000 if k < 2 else 10) for k in range(20)] + [(bytearray(b"/none"), 0, 5)], "path_raw binary, start long, len long")
    out = files.hash_files(requests).withColumn("part", F.spark_partition_id()).collect()
    assert {bytes(r.path_raw)[-3:].lstrip(b"/"): r.hash for r in out if r.hash} == {f"f{k}".encode(): hashlib.sha256(bytes([k]) * (3000 if k < 2 else 10)).hexdigest() for k in range(20)}
    large = [r.part for r in out if r.len == 3000]
    assert len(set(large)) == 2 and not set(large) & {r.part for r in out if r.len != 3000}
    assert [r.n_read for r in out if r.error] == [None]


def test_cache_store(spark, tmp_path):
    path = str(tmp_path / "c" / "hashes")
    rows = spark.createDataFrame([(1, "/a", 1, 1, 1, 0, 1, bytearray(32))], cache.HASH_CACHE)
    assert cache.open_cache(spark, path).count() == 0
    with cache.single_writer(spark, path):
        cache.commit(rows, path)
        with pytest.raises(RuntimeError), cache.single_writer(spark, path, wait=0.2):
            pass
        with cache.single_writer(spark, path, stale=-1.0):  # as if its owner had been killed long ago
            cache.commit(rows.unionByName(rows.withColumn("path", F.lit("/b"))), "file://" + path)
    assert cache.open_cache(spark, path).count() == 2 and sorted(os.listdir(tmp_path / "c")) == ["hashes"]
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            with open(f"{path}/{name}", "wb") as file:
                file.write(b"broken")
    assert cache.open_cache(spark, path).count() == 0


def test_orphans(tmp_path):
    """An old temporary link that a broken run left is removed and the link is made; a young one, or another's file, is not."""
    sow(str(tmp_path), a=b"1", b=b"1", c=b"1")
    a, b, temporary = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "b") + apply_.SUFFIX
    os.link(str(tmp_path / "c"), temporary)
    assert not apply_.remove_orphan(temporary) and os.path.lexists(temporary)
    assert apply_.remove_orphan(temporary, -1.0) and not os.path.lexists(temporary)
    os.symlink("nowhere", temporary)
    assert apply_.remove_orphan(temporary, -1.0)
    sow(str(tmp_path), **{"b" + apply_.SUFFIX: b"a file of someone's"})
    assert not apply_.remove_orphan(temporary, -1.0)
    os.unlink(temporary)
    os.link(str(tmp_path / "c"), temporary)
    before = apply_.remove_orphan.__defaults__
    apply_.remove_orphan.__defaults__ = (-1.0,)
    try:
        apply_.hardlink(a, b)
    finally:
        apply_.remove_orphan.__defaults__ = before
    assert ino(a) == ino(b) and not os.path.lexists(temporary)


def test_hash_range(tmp_path):
    (tmp_path / "f").write_bytes(b"hello world")
    assert hash_range(bytes(tmp_path / "f"), 0, 5)[0].startswith("2cf24dba")
    assert hash_range(bytes(tmp_path / "f"), 6, 100)[1] == 5


def test_engine(spark, tmp_path):
    root = str(tmp_path / "r")
    sow(root, a=b"D" * 1024, b=b"D" * 1024, c=b"E" * 1024, s1=b"x", s2=b"x", t__a=b"A" * 3000 + b"A", t__b=b"A" * 3000 + b"B")
    os.link(root + "/a", root + "/a2")
    options = DedupeOptions("500", probe=64, chunk=256, dry_run=True)
    told = []
    Engine(spark, options).run([root], act=True, on_result=told.append)
    assert [(r.target, r.action) for r in told] == [(root + "/b", "hardlink")]
    assert ino(root + "/a") != ino(root + "/b")
    cached = str(tmp_path / "cache" / "hashes")
    options = DedupeOptions("500", probe=64, chunk=256, dry_run=False, cache_file=cached)
    run = Engine(spark, options).run([root], act=True)
    assert ino(root + "/a") == ino(root + "/b") and ino(root + "/s1") != ino(root + "/s2")
    assert os.path.isdir(cached) and not os.path.exists(cached + ".lock")
    sow(root, d=b"E" * 1024)
    run = Engine(spark, options).run([root], act=True)
    assert "cached" in run.summaries[2] and ino(root + "/c") == ino(root + "/d")


def test_nothing_to_do(spark, tmp_path):
    assert Engine(spark).run([str(tmp_path)]).actions is None
    sow(str(tmp_path), a=b"1", b=b"22")
    assert Engine(spark).run([str(tmp_path)]).actions is None


def test_apply_checks(tmp_path):
    root = str(tmp_path)
    sow(root, a=b"1", b=b"1")
    a, b = root + "/a", root + "/b"
    at = lambda p: os.stat(p).st_mtime_ns
    assert apply_.replace_one(a, b, 1, at(b) + 1, at(a)).err == "modified since scan"
    assert apply_.replace_one(a, root + "/none", 1, 0, at(a)).action == "skipped"
    import fcntl

    with open(b) as held:
        fcntl.flock(held, fcntl.LOCK_EX)
        assert apply_.replace_one(a, b, 1, at(b), at(a)).err == "file in use"
    assert apply_.replace_one(a, b, 1, at(b), at(a), dry_run=True).action == "hardlink" and ino(a) != ino(b)
    sow(root, sub__c=b"1")
    apply_.symlink(a, root + "/sub/c")
    assert os.readlink(root + "/sub/c") == "../a"
    with pytest.raises(FileNotFoundError):
        apply_.symlink(root + "/none", root + "/sub/c")
    open(b + apply_.SUFFIX, "w").close()
    with pytest.raises(FileExistsError):
        apply_.hardlink(a, b)
    os.unlink(b + apply_.SUFFIX)
    apply_.hardlink(a, b)
    apply_.hardlink(a, b)
    assert ino(a) == ino(b) and not os.path.lexists(b + apply_.SUFFIX)


def test_command_line(tmp_path, capsys):
    assert main(["-m", "abc", str(tmp_path)]) == 1
    assert main(["-e", "[bad", str(tmp_path)]) == 1
    sow(str(tmp_path), a=b"1", b=b"1")
    assert main(["-n", "-v", str(tmp_path)]) == 0
    assert f"Replaced {tmp_path}/b with hardlink to {tmp_path}/a" in capsys.readouterr().out
