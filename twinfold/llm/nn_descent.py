"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search walks it.

Equal vectors are one node, named by its smallest id, so neither a common vector nor its copies make pairs.
Graph: a few random orderings (signs of random projections, hashes among equals) are range-partitioned
and cut into blocks of fixed size; the nearest within its blocks are a node's first neighbours. Then rounds
of joins: each node gathers its neighbours and its best reverse neighbours with their vectors, all of
them are compared with each other, and each keeps the nearest of what its own gatherings told. Vectors
travel as integers of 16 bits a component; vectors with equal ones are one node too; every round is written to the shared folder.

Search: the graph is a bucketed table of nodes with their neighbours' vectors, in the shared folder, so that each step only
shuffles its frontier. A query keeps a beam of the nearest found, expands the best of those not
yet expanded, and ends when all of the beam are; no number of steps is set (a node is expanded at most once a query). The whole beam, with all vectors of each of its nodes, is then scored in
double precision on the original vectors.

Nearness is the cosine; a vector shorter than others counts as followed by zeros. Ids that are null, and vectors that are
null, zero or hold null or non-finite components take no part. Rows with one id are one vector, the greatest of them by
component order. Ties go to the smaller id. Empty tables give empty results. Columns besides id and vector are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, delete, new_path, table

NEIGHBOURS, REVERSE, ROUNDS = 24, 24, 5
ORDERINGS, BLOCK, PLANES = 6, 512, 24
TOLD = 12  # candidates that one gathering tells each of its members
BEAM, EXPAND = 256, 128
SEED = 6
CODE = np.int16
_LINK = "array<struct<s: double, v: long>>"


def usable(vectors: DataFrame, id_col: str, vector_col: str, scratch: Scratch) -> DataFrame:
    """(id, e): one row for each id that takes part, e as array<double>, all of the greatest length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where("id is not null and e is not null")
    finite = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = scratch.table(rows.where(finite & F.exists("e", lambda x: x != 0)).groupBy("id").agg(F.max("e").alias("e")), "vectors")
    longest = rows.agg(F.max(F.size("e"))).first()[0] or 0
    return rows.withColumn("e", F.concat("e", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("e"))))


def coded(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as small integers, and one over the length of each."""
    top = np.abs(e).max(axis=1, keepdims=True)
    codes = np.rint(e / np.where(top > 0, top, 1) * np.iinfo(CODE).max).astype(CODE)
    return codes, 1.0 / np.maximum(np.sqrt((codes.astype(np.int64) ** 2).sum(1)), 1e-9)


def rows_of(column: pa.Array, dtype, width: int | None = None) -> np.ndarray:
    """Fixed-width binaries or lists as a matrix."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        raw = np.frombuffer(b"".join(column.to_pylist()), dtype)
        return raw.reshape(len(column), -1) if len(column) else raw.reshape(0, width or 1)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, width or 1)


def best(row: np.ndarray, s: np.ndarray, v: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which links, in order, are the k nearest distinct ones of each of n rows, and how many those are."""
    order = np.lexsort((v, -s, row))
    r, w = row[order], v[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    order, r = order[fresh], r[fresh]
    rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
    keep = rank < k
    return order[keep], np.bincount(r[keep], minlength=n)


def link_lists(s: np.ndarray, v: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(v, pa.int64())], names=["s", "v"]))


def encode(nodes: DataFrame) -> DataFrame:
    """(u, code, inv) of (id, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, inv = coded(rows_of(batch.column(1), float))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes]), pa.array(inv)], names=["u", "code", "inv"])

    return nodes.select("id", "e").mapInArrow(run, "u long, code binary, inv double")


def first_links(base: DataFrame, ordering: int, k: int) -> DataFrame:
    """(u, near): the nearest within blocks of one random ordering."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = rows_of(batch.column(1), CODE).astype(np.float32)
                planes = np.random.default_rng([SEED, ordering]).normal(size=(c.shape[1], PLANES)).astype(np.float32)
                key = ((c @ planes > 0) << np.arange(PLANES)).sum(1)
                gray = key ^ (key >> 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gray.astype(np.int64))], names=["u", "code", "inv", "key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def done(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            u, c, inv = rows.column(0).to_numpy(), rows_of(rows.column(1), CODE).astype(float), rows.column(2).to_numpy()
            s = (c @ c.T) * (inv[:, None] * inv[None, :])
            np.fill_diagonal(s, -9)
            m = min(k, len(u) - 1)
            at = np.argpartition(-s, m - 1, axis=1)[:, :m] if m > 0 else np.empty((len(u), 0), np.int64)
            return pa.RecordBatch.from_arrays([rows.column(0), link_lists(np.take_along_axis(s, at, 1).ravel(), u[at].ravel(), np.full(len(u), m))], names=["u", "near"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == BLOCK:
                    yield done(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield done(pa.Table.from_batches(held))

    at = base.mapInArrow(keyed, "u long, code binary, inv double, key long")
    return at.repartitionByRange("key", F.xxhash64("u")).sortWithinPartitions("key", F.xxhash64("u")).select("u", "code", "inv").mapInArrow(blocks, f"u long, near {_LINK}")


def merged(links: DataFrame, k: int) -> DataFrame:
    """(u, near): the k nearest of all that is told of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            inner = lists.flatten()
            per = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.repeat(np.arange(len(per)), per), inner.value_lengths().to_numpy(zero_copy_only=False))
            flat = inner.flatten()
            s, v = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            keep, counts = best(row, s, v, len(per), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), link_lists(s[keep], v[keep], counts)], names=["u", "near"])

    return links.groupBy("u").agg(F.collect_list("near").alias("told")).mapInArrow(run, f"u long, near {_LINK}")


def gathered(graph: DataFrame, base: DataFrame, reverse: int) -> DataFrame:
    """(p, around): of each node its neighbours and its best reverse neighbours, with their vectors."""
    forth = graph.select(F.col("u").alias("p"), F.explode("near").alias("l")).select("p", F.col("l.v").alias("m"), F.col("l.s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("s"), "m"))
    back = forth.select(F.col("m").alias("p"), F.col("p").alias("m"), "s").withColumn("rank", rank).where(F.col("rank") <= reverse).drop("rank")
    both = forth.select("p", "m").unionByName(back.select("p", "m")).distinct()
    return both.join(base, both["m"] == base["u"]).groupBy("p").agg(F.collect_list(F.struct("m", "code", "inv")).alias("around"))


def told(around: DataFrame) -> DataFrame:
    """(u, near): what the members of each gathering learn of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            if not len(flat):
                continue
            ids, codes, inv = flat.field(0).to_numpy(zero_copy_only=False), rows_of(flat.field(1), CODE).astype(float), flat.field(2).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            out_s, out_v, counts = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                n = b - a
                m = min(TOLD, n - 1)
                counts.append(np.full(n, max(m, 0)))
                if m < 1:
                    continue
                s = (codes[a:b] @ codes[a:b].T) * (inv[a:b, None] * inv[None, a:b])
                s.flat[:: n + 1] = -9
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out_s.append(np.take_along_axis(s, at, 1).ravel())
                out_v.append(ids[a:b][at].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids), link_lists(np.concatenate(out_s or [np.empty(0)]), np.concatenate(out_v or [np.empty(0, np.int64)]), np.concatenate(counts))], names=["u", "near"])

    return around.select("around").mapInArrow(run, f"u long, near {_LINK}")


def build_graph(base: DataFrame, scratch: Scratch, neighbours: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """(u, near: s, v) for each node of base (u, code, inv)."""
    links = first_links(base, 0, neighbours)
    for k in range(1, ORDERINGS):
        links = links.unionByName(first_links(base, k, neighbours))
    graph = scratch.table(merged(links, neighbours), "graph")
    for _ in range(rounds):
        last = graph
        graph = scratch.table(merged(last.unionByName(told(gathered(last, base, reverse))), neighbours), "graph")
        scratch.drop(last)
    return graph


def expand(frontier: DataFrame) -> DataFrame:
    """(q, found): neighbours of the frontier's nodes that are nearer than the beam's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, inv, worst = rows_of(batch.column(1), CODE).astype(float), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            lists = batch.column(4)
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            codes = rows_of(flat.field(1), CODE).astype(float)
            s = np.einsum("ij,ij->i", codes, own[row]) * (inv[row] * flat.field(2).to_numpy(zero_copy_only=False))
            keep = s > worst[row]
            yield pa.RecordBatch.from_arrays([batch.column(0), link_lists(s[keep], flat.field(0).to_numpy(zero_copy_only=False)[keep], np.bincount(row[keep], minlength=batch.num_rows))], names=["q", "found"])

    return frontier.select("q", "code", "inv", "worst", "around").mapInArrow(run, f"q long, found {_LINK}")


_BEAM = "array<struct<s: double, v: long, x: int>>"


def advanced(state: DataFrame, width: int, step: int) -> DataFrame:
    """(q, code, inv, beam) after a step. x: 0 not expanded, 1 to be expanded now, 2 expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            beam, found = batch.column(3), batch.column(4)
            row = np.repeat(np.arange(n), beam.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = beam.flatten()
            s, v, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            per = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            inner = found.flatten()
            more = np.repeat(np.repeat(np.arange(n), per), inner.value_lengths().to_numpy(zero_copy_only=False))
            new = inner.flatten()
            row, s, v = np.concatenate([row, more]), np.concatenate([s, new.field(0).to_numpy(zero_copy_only=False)]), np.concatenate([v, new.field(1).to_numpy(zero_copy_only=False)])
            x = np.concatenate([np.where(x > 0, 2, 0), np.zeros(len(more), np.int64)])
            order = np.lexsort((-x, v, -s, row))  # the beam's own entry comes before the same node found again
            row, s, v, x = row[order], s[order], v[order], x[order]
            keep, counts = best(row, s, v, n, width)
            row, s, v, x = row[keep], s[keep], v[keep], x[keep]
            open_ = np.flatnonzero(x == 0)
            rank = np.arange(len(open_)) - np.searchsorted(row[open_], row[open_], "left")
            x[open_[rank < step]] = 1
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            beams = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(v, pa.int64()), pa.array(x, pa.int32())], names=["s", "v", "x"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], beams], names=["q", "code", "inv", "beam"])

    return state.select("q", "code", "inv", "beam", "found").mapInArrow(run, f"q long, code binary, inv double, beam {_BEAM}")


def search(graph: DataFrame, base: DataFrame, queries: DataFrame, scratch: Scratch, width: int = BEAM, step: int = EXPAND, reverse: int = REVERSE) -> DataFrame:
    """(q, beam) for queries (q), nodes of the graph; each starts from its own node's neighbours."""
    spark = base.sparkSession
    name, path = f"twinfold_graph_{uuid.uuid4().hex}", new_path(spark, "graph-table")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        gathered(graph, base, reverse).repartition(parts, "p").write.bucketBy(parts, "p").option("path", path).saveAsTable(name)
        around = spark.table(name)
        start = queries.join(base, queries["q"] == base["u"]).select("q", "code", "inv", F.array(F.struct(F.lit(9.0).alias("s"), F.col("q").alias("v"), F.lit(1).alias("x"))).alias("beam"))
        state, steps = scratch.table(start, "beam"), 0
        while steps == 0 or open_.get["n"]:
            worst = F.when(F.size("beam") >= width, F.element_at("beam", -1)["s"]).otherwise(F.lit(-9.0))
            frontier = state.select("q", "code", "inv", worst.alias("worst"), F.explode(F.filter("beam", lambda b: b["x"] == 1)).alias("b")).select("q", "code", "inv", "worst", F.col("b.v").alias("p"))
            found = expand(frontier.hint("shuffle_hash").join(around, "p")).groupBy("q").agg(F.collect_list("found").alias("found"))
            last, open_, steps = state, Observation(), steps + 1
            after = advanced(last.join(found, "q", "left"), width, step)
            state = scratch.table(after.observe(open_, F.count_if(F.exists("beam", lambda b: b["x"] == 1)).alias("n")), "beam")
            scratch.drop(last)
        return state
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def exact(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, v, score): the cosine of nodes q and v in double precision."""
    at = pairs.join(nodes.select(F.col("id").alias("v"), F.col("e").alias("ev")), "v").join(nodes.select(F.col("id").alias("q"), F.col("e").alias("eq")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = rows_of(batch.column(2), float), rows_of(batch.column(3), float)
                a, b = (x / np.abs(x).max(1, keepdims=True) if not np.isfinite((x * x).sum()) or (x * x).sum(1).min() < 1e-290 else x for x in (a, b))
                score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["q", "v", "score"])

    return at.select("q", "v", "ev", "eq").mapInArrow(run, "q long, v long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", width: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (a function of the id column) holds."""
    with Scratch(vectors.sparkSession) as scratch:
        rows = usable(vectors, id_col, vector_col, scratch)
        low = Window.partitionBy("e").orderBy("id")
        first = rows.select("id", "e", F.row_number().over(low).alias("rank"))
        named = scratch.table(first.where(F.col("rank") <= k + 1).groupBy("e").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
        asked = scratch.table(rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "e").join(named.select("e", F.col("id").alias("q")), "e").select("query_id", "q"), "queries")
        codes = scratch.table(encode(named), "codes")
        base = scratch.table(codes.groupBy("code").agg(F.min("u").alias("u"), F.min("inv").alias("inv")).select("u", "code", "inv"), "codes")
        members = scratch.table(codes.join(base.select("code", F.col("u").alias("c")), "code").select("c", "u"), "members")
        graph = build_graph(base, scratch)
        own = asked.select(F.col("q").alias("u")).distinct().join(members, "u").select("c", F.col("u").alias("own"))
        beams = search(graph, base, own.select(F.col("c").alias("q")).distinct(), scratch, width)
        near = beams.select(F.col("q").alias("c"), F.explode("beam").alias("b")).select("c", F.col("b.v").alias("near"))
        pairs = near.join(own, "c").select(F.col("own").alias("q"), F.col("near").alias("c")).join(members, "c").select("q", F.col("u").alias("v"))
        scored = scratch.table(exact(pairs, named), "scores").join(named.select(F.col("id").alias("v"), "ids"), "v")
        top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        named_rows = asked.join(scored.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found")), "q").select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("vec_id")).where("query_id <> vec_id")
        ranked = named_rows.withColumn("rank", top).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        return scratch.kept(ranked, "nearest")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


QUERIES = {"op6_nn_descent": op6_nn_descent}
ORACLE_SQL: dict[str, str] = {}
