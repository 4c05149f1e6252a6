"""Trees of files from JSON, and snapshots of trees as JSON, for tests of the whole engine.

A tree: {"files": [{"paths": [...], "chunks": [[letter, size], ...]}], "symlinks": {path: target}}. The paths of one file share an inode.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinfold.functions.sizes import parse_size
from twinfold.sources.files import scan


def chunk_size(size: str | int) -> int:
    return size if isinstance(size, int) else parse_size(size)


def total_size(file: dict) -> int:
    return sum(chunk_size(size) for _, size in file["chunks"])


def content(file: dict) -> bytes:
    return b"".join(letter.encode() * chunk_size(size) for letter, size in file["chunks"])


def sow(root: str, tree: dict | str) -> None:
    """Makes the tree (or the one in a JSON text) under root."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    for file in tree.get("files", []):
        first, *links = (os.path.join(root, p) for p in file["paths"])
        for path in (first, *links):
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(first, "wb") as out:
            out.write(content(file))
        for path in links:
            os.link(first, path)
    for path, target in tree.get("symlinks", {}).items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        os.symlink(target, os.path.join(root, path))


def reap(spark: SparkSession, root: str) -> dict:
    """A snapshot: sizes and hashes of files with the paths that share each inode, and symlinks."""
    rows = scan(spark, [root]).where("error is null").groupBy("dev", "ino").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("path")).alias("paths"))
    files = []
    for row in rows.collect():
        with open(row.paths[0], "rb") as file:
            files.append({"paths": [os.path.relpath(p, root) for p in row.paths], "size": row["size"], "sha256": hashlib.sha256(file.read()).hexdigest()})
    links = {}
    for folder, below, names in os.walk(root):
        links |= {os.path.relpath(os.path.join(folder, n), root): os.readlink(os.path.join(folder, n)) for n in (*below, *names) if os.path.islink(os.path.join(folder, n))}
    return {"files": sorted(files, key=lambda f: f["paths"]), "symlinks": dict(sorted(links.items()))}


def reap_json(spark: SparkSession, root: str) -> str:
    return json.dumps(reap(spark, root), sort_keys=True)


def expected(tree: dict) -> dict:
    """The snapshot of a tree that was just made."""
    files = [{"paths": sorted(f["paths"]), "size": total_size(f), "sha256": hashlib.sha256(content(f)).hexdigest()} for f in tree.get("files", [])]
    return {"files": sorted(files, key=lambda f: f["paths"]), "symlinks": dict(sorted(tree.get("symlinks", {}).items()))}
