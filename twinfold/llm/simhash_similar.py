"""SimHash near-duplicates by similarity: classes of texts whose word shingles have a Jaccard similarity of 0.8 or more.

A link is a pair of texts whose sets of shingles (of five words) are that similar, exactly; a class is what links
connect. Texts with one set are one node from the start, sets being told apart by 128 bits. Pairs come from two
sources, and each is checked on the whole sets before it links anything:

1. SimHash, as in simhash.py: fingerprints of the sets, the grid join of their segments' bit counts, two bits or fewer.
   That finds most copies at the least cost. At a similarity of 0.8, however, fingerprints differ in some
   ten bits of 64, out of reach of a grid whose cells must stay selective; so
2. what the grid can't see comes through rare shingles. In any order of all shingles, two sets of similarity 0.8
   share one of the first n - ceil(0.8 n) + 1 of each. The order puts shingles first whose bucket, of a fixed number, counts
   few in the corpus, so hardly any unrelated texts share one. Texts that share such a shingle and are not in one class yet
   are a candidate unless their sizes, the places of the shingle or the number of shared ones rule the
   similarity out. No bound here is an estimate: no pair of the similarity is lost, however large its group.

Large groups first meet at pivots, by which most of a family of copies falls into one class, and then only
pairs across classes are met, in pairs of blocks. Where a large group is met, the parities of the sets (parities.py) bound in how many
shingles two sets differ, and pairs that this rules out go no further. What is left nearly always is a link, so a pair of
blocks at first tells only as many of them as connect its classes, fewer than it has rows; when those have been checked, all
pairs that still lie across classes are told and checked by rounds, the likeliest of each two classes first.

Texts are lower-cased; words are as for the fingerprints of op1; a text of fewer words than a shingle is one shingle. A null or
empty text has no shingle and is alike only to other empty texts. Rows with a null id belong to no class. Repeated rows are copies.
Very long texts are expanded a piece at a time. Ties go to the smaller id. Empty tables give empty results. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, parities, simhash
from . import wordhash as wh
from .common import Scratch, chosen, durable, lean, packed, spread_join, text_slices, tree_sum
from .components import joined

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Shingles are counted in so many buckets (2 ** SKETCH_BITS counts of 32 bits each).
SKETCH_BITS = 21
#: Groups from this size on meet at pivots first.
PIVOT_GROUP, PIVOTS, PIVOT_ROUNDS = 64, 8, 2
#: Rounds in which large groups tell only what connects their classes, before all pairs are told.
FOREST_ROUNDS = 2
#: Pairs between two classes that the first round checks; each round checks so many times more.
FIRST_PAIRS, MORE_PAIRS = 2, 16
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in that order."""
    w = wh.words_of(data, offsets)
    at, hashes = w.windows(shingle)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < shingle))
    if len(short):
        doc = np.concatenate([doc, short.astype(np.int32)])
        hashes = np.concatenate([hashes, wh.spans_hash(w.hashes, w.first[short], w.first[short + 1], 1)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[fresh], hashes[fresh]


def fingerprints(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The SimHash of each of n sets; 0 for an empty one."""
    total = np.zeros((n, 64), np.int64)
    for a in range(0, len(doc), 1 << 15):
        own = doc[a : a + (1 << 15)]
        bits = np.unpackbits(wh.mix(hashes[a : a + (1 << 15)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * total > np.bincount(doc, minlength=n)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def described(texts: DataFrame, shingle: int) -> DataFrame:
    """id, sig (of the set), n (its size), f (its SimHash) of each row of id, text; and for each task a row with the
    counts of its shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["id", "sig", "n", "f", "counts"]
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                doc, h = shingle_sets(data, offsets, shingle)
                sums = np.zeros((b - a, 2), np.uint64)
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
                if len(doc):
                    sums[doc[first], 0] = np.add.reduceat(wh.mix(h), first)
                    sums[doc[first], 1] = np.add.reduceat(wh.mix(h ^ _SECOND), first)
                np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                f = fingerprints(doc, h, b - a).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sums]), pa.array(np.bincount(doc, minlength=b - a).astype(np.int64)), pa.array(f), pa.nulls(b - a, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed(counts)])], names=names)

    return texts.mapInArrow(lean(run), "id long, sig binary, n long, f long, counts binary")


def ranks_of(counts: np.ndarray | None) -> np.ndarray:
    """The place of each bucket in the order: the power of two by which it counts more than the middle one."""
    if counts is None:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    middle, out = max(1.0, float(np.median(counts))), np.empty(len(counts), np.uint8)
    for a in range(0, len(counts), 1 << 16):  # the driver holds no array of floats of all
        part = slice(a, a + (1 << 16))
        out[part] = np.maximum(np.floor(np.log2(np.maximum(counts[part], 1) / middle)), 0)
    return out


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def prefixes(texts: DataFrame, shingle: int, similarity: float, ranks: np.ndarray) -> DataFrame:
    """token, node, n, pos: the first shingles of each text in the common order, and their places."""
    cast = texts.sparkSession.sparkContext.broadcast(ranks)  # 2 ** SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                doc, h = shingle_sets(data, offsets, shingle)
                place = cast.value[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(doc.astype(np.int64) << 8 | place, kind="stable")
                doc, h = doc[order], h[order]
                n = np.bincount(doc, minlength=b - a)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                keep = pos < prefix_size(n, similarity)[doc]
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(n[doc].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["token", "node", "n", "pos"])

    return texts.mapInArrow(lean(run), "token long, node long, n int, pos int")


def sets(texts: DataFrame, shingle: int) -> DataFrame:
    """id, s: the sorted shingles of each text as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                doc, h = shingle_sets(data, offsets, shingle)
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([h[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())], names=["id", "s"])

    return texts.mapInArrow(lean(run), "id long, s binary")


def strings(texts: DataFrame, shingle: int) -> DataFrame:
    """node, bits: the parities of the set of each text of id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                doc, h = shingle_sets(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), parities.strings(doc, h, b - a)], names=["node", "bits"])

    return texts.mapInArrow(lean(run), "node long, bits binary")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; texts: id, text."""
    ids = scratch.table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    held = scratch.table(sets(chosen(texts, ids, "id", ids.count()), shingle), "sets")
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = scratch.table(both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long"), "similar-pairs")
    scratch.drop(ids, held)
    return out


def needed(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles sets of these sizes share at least if they are similar."""
    return np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-9).astype(np.int64)


def possible(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets may still be similar, by their sizes and the places of a shared shingle."""
    return (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9) & (1 + np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb) - 1 >= needed(na, nb, similarity))


def labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """rows with the class of the node in a column, by default the node itself."""
    known = labels.select(F.col("node").alias(column), F.col("root").alias("__tf_root"))
    return rows.join(known, column, "left").withColumn(name, F.coalesce("__tf_root", column)).drop("__tf_root")


def at_pivots(meetings: DataFrame, labels: DataFrame, similarity: float, seed: int) -> DataFrame:
    """(a, b): rows of large groups with the first few of their block in random order, where the classes differ."""
    rows = labelled(meetings.where(F.col("size") >= PIVOT_GROUP), "node", labels, "label").withColumn("block", blocks.block_of("node", F.col("size"))).withColumn("place", F.xxhash64("node", F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in blocks.groups(batches, ["token", "block"]):
            node, n, pos, label = (part.column(c).to_numpy() for c in ("node", "n", "pos", "label"))
            first, size = np.repeat(at[:-1], np.diff(at)), np.repeat(np.diff(at), np.diff(at))
            for k in range(PIVOTS):
                j = np.flatnonzero((np.arange(len(node)) - first > k) & (size > k))
                i = first[j] + k
                ok = (label[i] != label[j]) & possible(n[i], n[j], pos[i], pos[j], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i[ok]], node[j[ok]])), pa.array(np.maximum(node[i[ok]], node[j[ok]]))], names=["a", "b"])

    dealt = rows.select("token", "block", "place", "node", "n", "pos", "label").repartition("token", "block").sortWithinPartitions("token", "block", "place", "node")
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def mixed(meetings: DataFrame, labels: DataFrame) -> DataFrame:
    """meetings with label, the class of the node, of those shingles at which several classes meet."""
    rows = labelled(meetings, "node", labels, "label")
    several = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    return rows.join(several, "token", "left_semi")


def across(rows: DataFrame, bits: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """a, b, na, nb: the pairs of different classes that may be similar, for each shingle at which they meet; with forest, only
    so many of a pair of blocks as connect the same classes. rows: as mixed gives them; bits: node, bits of those in large groups."""
    keys = ["token", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in blocks.groups(batches, keys):
            node, n, pos, label, b, bi, bj = (part.column(c).to_numpy() for c in ("node", "n", "pos", "label", "b", "bi", "bj"))
            n, pos, strings = n.astype(np.int64), pos.astype(np.int64), parities.Parities(part.column("bits"))
            # rows of one class stand together: each row only meets what comes after its class
            new = np.ones(len(node) + 1, bool)
            new[1:-1] = label[1:] != label[:-1]
            new[at] = True
            edges = np.flatnonzero(new)
            after = np.repeat(edges[1:], np.diff(edges))
            own = np.cumsum(new[:-1]) - 1

            def pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                swap = node[i] > node[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(n[i]), pa.array(n[j])], names=["a", "b", "na", "nb"])

            held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)
            for i, j in blocks.index_pairs(at, after):
                ok = ((bi[i] == bj[i]) | (b[i] != b[j])) & possible(n[i], n[j], pos[i], pos[j], similarity)
                i, j = i[ok], j[ok]
                apart = strings.apart(i, j)
                ok = apart <= n[i] + n[j] - 2 * needed(n[i], n[j], similarity)
                i, j, apart = i[ok], j[ok], apart[ok] / (n[i[ok]] + n[j[ok]])
                if forest:
                    held = tuple(np.concatenate(x) for x in zip(held, (i, j, apart), strict=True))
                    stay = blocks.spanning(len(edges) - 1, own[held[0]], own[held[1]], held[2])
                    held = tuple(x[stay] for x in held)
                else:
                    yield pairs(i, j)
            yield pairs(*held[:2])

    met = blocks.met(rows.join(bits, "node", "left"), "node", "size")
    dealt = met.select(*keys, "b", "label", "node", "n", "pos", "bits").repartition(*keys).sortWithinPartitions(*keys, "label", "node")
    return dealt.mapInArrow(lean(run), "a long, b long, na long, nb long")


def candidates(meetings: DataFrame, labels: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """a, b, c (how many first shingles they share): all pairs of different classes that may be similar."""
    told = across(mixed(meetings, labels), bits, similarity, False).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    # beyond the shared first shingles two sets share no more than what follows the prefix of one of them
    rest = lambda c: F.ceil(F.lit(similarity) * F.col(c) - 1e-9) - 1
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9)
    return told.where(F.col("c") + F.greatest(rest("na"), rest("nb")) >= need).select("a", "b", "c")


def by_fingerprint(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of nodes that the grid join of their SimHashes connects."""
    prints = scratch.table(nodes.groupBy("f").agg(F.min("node").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    near = simhash.links(prints.select("f"), scratch)
    low = prints.select("f", "low")
    across = near.join(low.select(F.col("f").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("f").alias("b"), F.col("low").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = spread_join(nodes.select("f", "node"), prints, ["f"], nodes.count()).where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return scratch.table(across.unionByName(same).distinct(), "near-fingerprints")


ROW = "__tf_row"


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a whole number of its own for each row: the id where all ids are there and differ, else one that is
    written with the rows to the shared folder, so that it stays the same."""
    docs = docs.drop(ROW)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.where("id is null").isEmpty() and ids.groupBy("id").count().where("count > 1").isEmpty():
        return docs.withColumn(ROW, F.col(id_col).cast("long"))
    return durable(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def similar_rows(rows: DataFrame, row_col: str = ROW, text_col: str = "text", shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(row, component): the class of each row, named by its smallest row number. Row numbers are whole, unique and not null, and stay the
    same whenever rows is read."""
    with Scratch(rows.sparkSession) as scratch:
        texts = rows.select(F.col(row_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
        told = scratch.table(described(texts, shingle), "sets-described")
        ranks = ranks_of(tree_sum(told.where("counts is not null").select("counts"), np.int32, scratch))
        own = scratch.kept(told.where("counts is null").select("id", "sig", "n", "f"), "rows-described")
        nodes = scratch.table(own.groupBy("sig").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("f").alias("f"), F.max("n").alias("size")), "nodes")
        filled = nodes.where("size > 0")
        links = verified(by_fingerprint(filled.select("node", "f"), scratch), texts, shingle, similarity, scratch)
        nameless = spread_join(own.select("id", "sig"), nodes.select("sig", "node", "size", "n"), ["sig"], own.count()).where("id <> node or size = 0")
        copies = scratch.table(nameless.select("id"), "copies")
        first = scratch.table(prefixes(chosen(texts, copies, "id", copies.count(), but=True), shingle, similarity, ranks), "first-shingles")
        shared = scratch.table(first.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "shared-shingles")
        meetings = scratch.table(spread_join(first.withColumnRenamed("n", "n_own"), shared.withColumn("n", F.col("size")), ["token"], first.count()).withColumnRenamed("n_own", "n"), "meetings")
        scratch.drop(first, shared)
        labels = joined(links, scratch)
        for seed in range(PIVOT_ROUNDS):
            pairs = scratch.table(at_pivots(meetings, labels, similarity, seed), "pivot-pairs")
            if pairs.isEmpty():
                break
            links = links.unionByName(verified(pairs, texts, shingle, similarity, scratch))
            labels = joined(links, scratch)
        large = meetings.where(F.col("size") >= PIVOT_GROUP)
        ids = scratch.table(mixed(large, labels).select(F.col("node").alias("id")).distinct(), "in-large-groups")
        bits = scratch.table(strings(chosen(texts, ids, "id", ids.count()), shingle), "parities")
        for _ in range(FOREST_ROUNDS):
            pairs = scratch.table(across(mixed(large, labels), bits, similarity, True).select("a", "b").distinct(), "forest-pairs")
            if pairs.isEmpty() or (more := verified(pairs, texts, shingle, similarity, scratch)).isEmpty():
                break
            links = links.unionByName(more)
            labels = joined(links, scratch)
        left, most = scratch.table(candidates(meetings, labels, bits, similarity), "candidates"), FIRST_PAIRS
        while True:
            apart = labelled(labelled(left.select("a", "b", "c"), "a", labels, "la"), "b", labels, "lb").where("la <> lb")
            likely = F.row_number().over(Window.partitionBy(F.least("la", "lb"), F.greatest("la", "lb")).orderBy(F.desc("c"), "a", "b"))
            left = scratch.table(apart.withColumn("rank", likely), "open-pairs")
            if left.isEmpty():
                break
            links = links.unionByName(verified(left.where(F.col("rank") <= most).select("a", "b"), texts, shingle, similarity, scratch))
            labels = joined(links, scratch)
            left, most = left.where(F.col("rank") > most), most * MORE_PAIRS
        named = scratch.kept(nodes.join(labels, "node", "left").select("sig", F.coalesce("root", "node").alias("component"), "n"), "named-sets")
        return spread_join(own.select(F.col("id").alias(row_col), "sig"), named, ["sig"], own.count()).select(row_col, "component")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id): the class of each row, named by its smallest id; null ids name none."""
    with Scratch(docs.sparkSession) as scratch:
        rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
        classes = scratch.table(similar_rows(rows, ROW, "text", shingle, similarity), "row-classes")
        own = scratch.kept(rows.select("id", ROW).join(classes, ROW).select("id", "component"), "ids")
        names = scratch.kept(own.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "names")
        return spread_join(own, names, ["component"], own.count()).select(F.col("id").alias(id_col), "component_id")
