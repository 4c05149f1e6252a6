"""Scenarios: a tree before, options, the tree after."""

import json
import os
import subprocess
import sys

import pytest

from twinfold.model import DedupeOptions
from twinfold.plans.engine import Engine

from .trees import expected, reap, reap_json, sow, total_size


def file(*paths, chunks):
    return {"paths": list(paths), "chunks": chunks}


A, B = [["A", "1KiB"], ["B", 10]], [["A", "1KiB"], ["C", 10]]
SCENARIOS = {
    "copies become one file": ([file("x/1", chunks=A), file("y/2", chunks=A), file("z", chunks=B)], {}, [file("x/1", "y/2", chunks=A), file("z", chunks=B)]),
    "the most links stay": ([file("a", chunks=A), file("b", "c", chunks=A)], {}, [file("a", "b", "c", chunks=A)]),
    "small files stay": ([file("a", chunks=[["A", 5]]), file("b", chunks=[["A", 5]])], {"min_size": "6"}, [file("a", chunks=[["A", 5]]), file("b", chunks=[["A", 5]])]),
    "excluded names stay": ([file("a", chunks=A), file("b.bak", chunks=A), file("skip/c", chunks=A), file("d", chunks=A)], {"excludes": ("*.bak", "skip")}, [file("a", "d", chunks=A), file("b.bak", chunks=A), file("skip/c", chunks=A)]),
    "a dry run changes nothing": ([file("a", chunks=A), file("b", chunks=A)], {"dry_run": True}, [file("a", chunks=A), file("b", chunks=A)]),
    "late differences are seen": ([file("a", chunks=[["A", "300KiB"], ["B", 1], ["A", "9KiB"]]), file("b", chunks=[["A", "300KiB"], ["C", 1], ["A", "9KiB"]]), file("c", chunks=[["A", "300KiB"], ["B", 1], ["A", "9KiB"]])], {"probe": 16, "chunk": 4096}, [file("a", "c", chunks=[["A", "300KiB"], ["B", 1], ["A", "9KiB"]]), file("b", chunks=[["A", "300KiB"], ["C", 1], ["A", "9KiB"]])]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, tmp_path, name):
    before, options, after = SCENARIOS[name]
    links = {"link": "x/1", "sub/dangling": "nowhere"}
    sow(str(tmp_path), json.dumps({"files": before, "symlinks": links}))
    assert reap(spark, str(tmp_path)) == expected({"files": before, "symlinks": links})
    lines = []
    run = Engine(spark, DedupeOptions(**{"dry_run": False, **options})).run([str(tmp_path)], act=True, on_summary=lines.append)
    assert lines == run.summaries
    assert json.loads(reap_json(spark, str(tmp_path))) == expected({"files": after, "symlinks": links})


def test_total_size():
    assert total_size(file("a", chunks=[["A", "1KiB"], ["B", 10], ["C", "1k"]])) == 2034


def test_as_a_program(spark, tmp_path):
    """A process of its own, from the command line to the file system."""
    tree = {"files": [file("a", chunks=A), file("b", chunks=A), file("c", chunks=B)]}
    sow(str(tmp_path / "t"), tree)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "twinfold", "-v", "-w", "2", str(tmp_path / "t")], cwd=tmp_path, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"Replaced {tmp_path}/t/b with hardlink to {tmp_path}/t/a" in done.stdout and "Processed 1/1 files in 1 sets" in done.stderr
    assert reap(spark, str(tmp_path / "t")) == expected({"files": [file("a", "b", chunks=A), file("c", chunks=B)]})
