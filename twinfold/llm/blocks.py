"""Pairs inside groups of any size: a group is cut into blocks by a hash, a task meets one pair of blocks at a time.

So a group of n rows is compared as n * n / BLOCK**2 pieces of work of bounded size, in any number of tasks, with the
same result as if it were compared at once; a group of one block is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
#: Pairs whose indices are in memory at once.
PAIRS = 1 << 20


def block_of(node: str, size: Column, block: int = BLOCK) -> Column:
    return F.pmod(F.xxhash64(node), F.ceil(size / F.lit(block)).cast("long")).cast("int")


def met(rows: DataFrame, node: str, size: str, block: int = BLOCK) -> DataFrame:
    """rows with bi, bj, b: each row once for each pair of blocks that its own, b, takes part in; size: rows of its group."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    at = rows.withColumn("b", block_of(node, F.col(size), block)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return at.withColumn("bi", F.least("b", "other")).withColumn("bj", F.greatest("b", "other")).drop("other")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with the edges of the groups in each."""
    held: pa.Table | None = None

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            new |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held is not None else now
        at = edges(held)
        if len(at) > 2:  # the last group may go on in the next batch
            yield held.slice(0, int(at[-2])), at[:-1]
            held = held.slice(int(at[-2]))
    if held is not None:
        yield held, edges(held)


def index_pairs(at: np.ndarray, first: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside the groups between the edges, about PAIRS at a time (or those of one row). With first,
    each row only meets those of its group from row first on, which must be later than itself."""
    n = int(at[-1])
    first = np.arange(1, n + 1) if first is None else first
    more = np.repeat(at[1:], np.diff(at)) - first
    total = np.concatenate([[0], np.cumsum(more)])
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        left = np.repeat(np.arange(a, b), more[a:b])
        if len(left):
            yield left, np.repeat(first[a:b], more[a:b]) + np.arange(len(left)) - np.repeat(total[a:b] - total[a], more[a:b])
        a = b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected to by the links a, b."""
    r = np.arange(n)
    while len(a):
        low = np.minimum(r[a], r[b])
        np.minimum.at(r, r[a], low)
        np.minimum.at(r, r[b], low)
        while (r[r] != r).any():
            r = r[r]
        apart = r[a] != r[b]
        a, b = a[apart], b[apart]
    return r


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links a, b of n nodes connect all that they do, the least of weight first: n - 1 at most."""
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    root, kept, left = np.arange(n), [], np.flatnonzero(a != b)
    while len(left):
        first = np.full(n, len(order))
        np.minimum.at(first, root[a[left]], left)
        np.minimum.at(first, root[b[left]], left)
        some = np.unique(first[first < len(order)])
        kept.append(some)
        root = roots(n, np.concatenate([np.arange(n), a[some]]), np.concatenate([root, b[some]]))
        left = left[root[a[left]] != root[b[left]]]
    return order[np.concatenate(kept)] if kept else np.empty(0, np.int64)
