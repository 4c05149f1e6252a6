"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch, lean, spread_join

#: Edges that are joined in one task (16 bytes each, some arrays); more are contracted by partitions and go through the rounds.
FOREST_EDGES = 1_000_000


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours; total is the number of edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), F.count("*").alias("n"))
    return spread_join(both.where("b > a"), low, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    tied = spread_join(down, low, ["a"], total)
    return tied.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def all_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller end, which is no edge's larger end: then the smaller ends are the roots."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the edges a, b; root is the smallest node reachable. Nothing is collected
    but counts; rounds, one table each, grow as the logarithm of the longest path. A node with a large
    share of all edges keeps them where they are: its smallest neighbour is broadcast."""
    edges = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not all_stars(edges):
        last, total = edges, edges.count()
        edges = scratch.table(small_star(large_star(last, total), total), "edges")
        scratch.drop(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(edges: DataFrame) -> DataFrame:
    """(a, b): what the edges a, b of each partition connect, each node tied to the smallest one; no more rows than nodes are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.empty(0, np.int64)
        more, n = [], 0

        def contracted() -> tuple[np.ndarray, np.ndarray]:
            x, y = (np.concatenate([u, *(m.column(k).to_numpy() for m in more)]) for k, u in enumerate((a, b)))
            nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            root = blocks.roots(len(nodes), at[: len(x)], at[len(x) :])
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[tied], nodes[root[tied]]

        for batch in batches:
            more.append(batch)
            n += batch.num_rows
            if n >= max(len(a), 1 << 18):
                (a, b), more, n = contracted(), [], 0
        a, b = contracted()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(lean(run), "a long, b long")


def joined(edges: DataFrame, scratch: Scratch, most: int = FOREST_EDGES) -> DataFrame:
    """As components, for edges between whole numbers, in a table of its own: what each partition connects is found first, and is
    joined at once if it has most rows or fewer, else by rounds. A few jobs, where rounds plan several joins each on the driver."""
    near = scratch.table(forest(edges), "forests")
    if near.count() > most:
        return scratch.table(components(near, scratch), "classes")
    stars = scratch.table(forest(near.coalesce(1)), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
