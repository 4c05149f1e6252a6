"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint of 64 bits is cut into 16 segments; their bit counts embed it in a grid. Each
differing bit moves one count by one at most, so the Manhattan distance of two embeddings is a lower
bound of the Hamming distance: fingerprints that differ in two bits or fewer lie within distance
two and so share a cell at distance one or zero of both. Every distinct fingerprint goes to the cells
within distance one of its own, rows that share a cell are compared bit by bit. A cell that holds more than
FULL_CELL fingerprints is divided by a finer grid: other segments of the bits embed its fingerprints once more, and
as the bound holds there too, linked ones share a cell of both grids. Cells of any size are compared in pairs of
blocks (blocks.py), and what a pair of blocks links is told as stars, so it tells fewer links than it has rows. Equal
fingerprints are one node from the start. Components are found by star rounds.

Very long texts are hashed a piece at a time. Texts: A-Z is lower-cased; words are runs of bytes other than space and \\t..\\r; a text of fewer words
than a shingle is one shingle; a text without words (or null) has fingerprint 0, linked like any
other. Rows with a null id have a fingerprint and component but can't name it. Repeated rows each give a
row. Empty tables give empty results. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import Scratch, lean, spread_join, table
from .components import components

SEED, SHINGLE_WORDS = 42, 3
SEGMENTS, SEGMENT_BITS, MAX_DISTANCE = 16, 4, 2
#: Fingerprints in a cell before it is divided by the finer grid.
FULL_CELL = 512
#: Bytes of a text whose words are in memory at once (longer where no blank comes).
PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of PIECE bytes or a little more, cut at blanks."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end]
        at = end


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text over the XXH64 of its shingles."""
    total, n, before = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(words: list[bytes], k: int) -> int:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
        for a in range(0, len(hashes), 1 << 16):
            total[:] += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return len(hashes)

    for part in pieces(text):
        words = before + part.lower().split()  # of bytes: A-Z, and the six blanks, only
        if len(words) >= shingle:
            n += add(words, shingle)
            words = words[len(words) - shingle + 1 :]
        before = words
    if not n and before:
        n = add(before, len(before))
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """id, fingerprint (the 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fingerprint"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def cells(prints: DataFrame, name: str, spread: bool) -> DataFrame:
    """prints (f and others) with a row for each grid point within Manhattan distance one of the bit counts of f, three bits a
    count. Segments are neighbouring bits, or (spread) bits that lie SEGMENTS apart."""
    if spread:
        masks = [sum(1 << (k + SEGMENTS * j) for j in range(SEGMENT_BITS)) for k in range(SEGMENTS)]
    else:
        masks = [((1 << SEGMENT_BITS) - 1) << SEGMENT_BITS * k for k in range(SEGMENTS)]
    count = [F.bit_count(F.col("f").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))).cast("long") for m in masks]
    own = count[0]
    for k in range(1, SEGMENTS):
        own = own.bitwiseOR(F.shiftleft(count[k], 3 * k))
    counted = prints.withColumn("own", own)
    at = lambda k: F.shiftright("own", 3 * k).bitwiseAND(F.lit(7))
    near = [F.col("own")]
    for k in range(SEGMENTS):
        near += [F.when(at(k) < SEGMENT_BITS, F.col("own") + F.lit(1 << 3 * k)), F.when(at(k) > 0, F.col("own") - F.lit(1 << 3 * k))]
    return counted.withColumn(name, F.explode(F.array(*near))).where(F.col(name).isNotNull()).drop("own")


def compared(rows: DataFrame) -> DataFrame:
    """(a, b): links that connect what differs in MAX_DISTANCE bits or fewer within each cell and pair of blocks."""
    keys = ["cell", "finer", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in blocks.groups(batches, keys):
            f, b = part.column("f").to_numpy(), part.column("b").to_numpy()
            within = part.column("bi").to_numpy() == part.column("bj").to_numpy()
            u = f.view(np.uint64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in blocks.index_pairs(at):
                near = (np.bitwise_count(u[i] ^ u[j]) <= MAX_DISTANCE) & (within[i] | (b[i] != b[j]))
                found.append((i[near], j[near]))
            if found:
                root = blocks.roots(len(f), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
                tied = np.flatnonzero(root != np.arange(len(f)))
                yield pa.RecordBatch.from_arrays([pa.array(f[tied]), pa.array(f[root[tied]])], names=["a", "b"])

    dealt = rows.select(*keys, "b", "f").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between distinct fingerprints f, enough to connect all that lie within MAX_DISTANCE bits."""
    at = cells(prints, "cell", False)
    full = scratch.table(at.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    shared = scratch.table(at.join(full, "cell"), "shared-cells")
    few = shared.where(F.col("n") <= FULL_CELL).withColumn("finer", F.lit(0).cast("long"))
    divided = cells(shared.where(F.col("n") > FULL_CELL).drop("n"), "finer", True)
    finer = divided.groupBy("cell", "finer").agg(F.count("*").alias("n")).where("n > 1")
    rows = few.unionByName(divided.join(finer, ["cell", "finer"]))
    return scratch.table(compared(blocks.met(rows, "f", "n")), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """id, fingerprint, component_id (the smallest id reachable over links of two bits or fewer): a row for each row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        own = scratch.kept(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        prints = scratch.table(own.groupBy("fingerprint").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
        roots = components(links(prints.select(F.col("fingerprint").alias("f")), scratch), scratch)
        linked = scratch.table(prints.join(roots, prints["fingerprint"] == roots["node"]).select("fingerprint", "root", "low"), "linked-fingerprints")
        names = scratch.table(linked.groupBy("root").agg(F.min("low").alias("name"), F.count("*").alias("n")), "names")
        named = spread_join(linked, names, ["root"], linked.count()).select("fingerprint", "name")
        named = scratch.kept(prints.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("name", "low").alias("component_id"), "n"), "named-fingerprints")
        return spread_join(own, named, ["fingerprint"], own.count()).select(id_col, "fingerprint", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
