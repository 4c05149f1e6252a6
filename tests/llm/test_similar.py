"""Near-duplicates by similarity against all pairs of sets."""

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from twinfold.llm import blocks, components, parities, simhash_similar
from twinfold.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def linked_classes(texts, similarity=0.8, k=5):
    """The smallest id of the class of each id; every pair that shares a shingle is compared."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a, b):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)

    same, holders = {}, {}
    for i in sorted(sets):
        if (first := same.setdefault(sets[i], i)) != i:
            join(first, i)
        else:
            for s in sets[i]:
                holders.setdefault(s, []).append(i)
    shared = {}
    for own in holders.values():
        for x in range(len(own)):
            for y in range(x):
                shared[own[y], own[x]] = shared.get((own[y], own[x]), 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    for a, b in pairs:
        join(a, b)
    return {i: top(i) for i in sets}, pairs


def test_same_classes_as_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    texts = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    want, pairs = linked_classes(texts)
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_classes(docs).collect()}
    assert got == want and pairs


def copies(rng, versions, words, edits):
    """Each a copy of a random earlier one with some words changed: chains in which most pairs are far apart."""
    made = [[f"w{rng.randrange(5000)}" for _ in range(words)]]
    for _ in range(1, versions):
        own = list(rng.choice(made))
        for at in rng.sample(range(words), rng.randrange(*edits)):
            own[at] = f"x{rng.randrange(10**6)}"
        made.append(own)
    return [" ".join(m) for m in made]


@pytest.mark.parametrize(("block", "pivots"), [(1024, 16), (7, 4), (16, 10**9)])
def test_copies_of_copies(spark, monkeypatch, block, pivots):
    """Families of all similarities, in blocks of any size, with pivots and without: always the classes of all pairs."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks.met, "__defaults__", (block,))
    monkeypatch.setattr(blocks.block_of, "__defaults__", (block,))
    monkeypatch.setattr(simhash_similar, "PIVOT_GROUP", pivots)
    rng = random.Random(block)
    texts = copies(rng, 60, 120, (1, 6)) + copies(rng, 30, 60, (0, 2)) + copies(rng, 20, 9, (0, 2)) + [f"alone {k} and {k * k} or {k + 7} then" for k in range(40)]
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [f"{passage} own{k} text{k} of{k} its{k} kind{k} " + " ".join(f"z{k}{j}" for j in range(k % 30)) for k in range(40)]
    rng.shuffle(texts)
    want, _ = linked_classes(dict(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_no_row_goes_without_a_similar_one(spark, sf):
    """The stage keeps one row of each class, and every row that goes has one in its class that is alike."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, pairs = linked_classes(texts)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id").collect()}
    assert kept == set(want.values())
    near = {i for p in pairs for i in p}
    assert all(i in near or any(j != i and shingles(texts[j]) == shingles(texts[i]) for j in texts) for i in texts.keys() - kept)


def test_possible_rules_out_no_similar_pair():
    rng = random.Random(3)
    for _ in range(300):
        a = set(rng.sample(range(60), rng.randrange(1, 50)))
        b = {x if rng.random() > 0.08 else x + 100 for x in a} | set(rng.sample(range(60, 70), rng.randrange(0, 4)))
        if len(a & b) < 0.8 * len(a | b):
            continue
        order = lambda s: sorted(s, key=lambda x: (x * 7919) % 101)
        x, y = order(a), order(b)
        size = lambda s: int(simhash_similar.prefix_size(np.array([len(s)]), 0.8)[0])
        common = [(x.index(t), y.index(t)) for t in set(x[: size(x)]) & set(y[: size(y)])]
        assert common
        for p, q in common:
            assert simhash_similar.possible(*(np.array([v]) for v in (len(x), len(y), p, q)), 0.8)[0]


def test_blocks_meet_every_pair_once(spark):
    rows = spark.createDataFrame([(g, k) for g, n in ((1, 1), (2, 2), (3, 25)) for k in range(n)], "g long, f long")
    sized = rows.join(rows.groupBy("g").count().withColumnRenamed("count", "n"), "g")
    parts = {}
    for r in blocks.met(sized, "f", "n", 4).collect():
        parts.setdefault((r.g, r.bi, r.bj), []).append((r.b, r.f))
    seen = [(g, *sorted((x, y))) for (g, i, j), own in parts.items() for k, (bx, x) in enumerate(own) for by, y in own[:k] if i == j or bx != by]
    assert sorted(seen) == sorted((g, x, y) for g, n in ((1, 1), (2, 2), (3, 25)) for y in range(n) for x in range(y))
    for sizes in ([1], [3, 1, 4], [0, 5]):
        at = np.concatenate([[0], np.cumsum(sizes)])
        got = [(int(i), int(j)) for a, b in blocks.index_pairs(at) for i, j in zip(a, b, strict=True)]
        assert got == [(i, j) for a, b in zip(at[:-1], at[1:], strict=True) for i in range(a, b) for j in range(i + 1, b)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_joined_is_components(spark, most):
    """Classes are those of a search over all edges, whether forests meet in one task or go through the rounds."""
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(-(10**12), 10**12, 800)[rng.integers(0, 800, (600, 2))]] + [(5, 5)]
    near = {}
    for a, b in ((a, b) for a, b in edges if a != b):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = node
                todo += near[n]
    with Scratch(spark) as scratch:
        table = spark.createDataFrame(edges, "a long, b long").repartition(7)
        got = components.joined(table, scratch, most).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_few_links_take_no_star_rounds(spark, monkeypatch):
    """The rounds plan several joins each on the driver; the chain of links of a small table is joined without them."""
    def fail(*_):
        raise AssertionError("a star round")

    monkeypatch.setattr(components, "small_star", fail)
    docs = [(k, " ".join(f"w{k + j}" for j in range(80))) for k in range(30)]
    got = simhash_similar.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 30


def pairs_told(spark, monkeypatch, texts):
    """The class of each text, and how many rows of pairs all shared shingles told."""
    told, plain = spark.sparkContext.accumulator(0), simhash_similar.lean

    def counted(run):
        def counting(batches):
            for batch in run(batches):
                if "na" in batch.schema.names:
                    told.add(batch.num_rows)
                yield batch

        return plain(counting)

    monkeypatch.setattr(simhash_similar, "lean", counted)
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return got, told.value


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Copies of one text that differ from each other too much: hundreds meet at a shingle, few pairs leave it."""
    rng = random.Random(5)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(300):
        own = list(base)
        for at in rng.sample(range(len(own)), 3):
            own[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    got, told = pairs_told(spark, monkeypatch, texts)
    assert got == linked_classes(dict(enumerate(texts)))[0] and len(set(got.values())) > 100
    assert told < 10 * len(texts), told


def test_links_of_a_group_are_told_as_forests(spark, monkeypatch):
    """Copies that are all alike, without pivots: what connects them is told, not each pair at each shingle."""
    monkeypatch.setattr(simhash_similar, "PIVOT_ROUNDS", 0)
    rng = random.Random(6)
    texts = [" ".join(f"x{rng.randrange(10**9)}" if k == at else f"w{k}" for k in range(120)) for at in rng.choices(range(120), k=200)]
    got, told = pairs_told(spark, monkeypatch, texts)
    assert set(got.values()) == {0} and told < 40 * len(texts), told


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_copies_of_copies_without_pivots(spark, monkeypatch, rounds):
    """Classes are those of all pairs, however many links come as forests."""
    monkeypatch.setattr(blocks.met, "__defaults__", (7,))
    monkeypatch.setattr(blocks.block_of, "__defaults__", (7,))
    for name, value in (("PIVOT_GROUP", 2), ("PIVOT_ROUNDS", 0), ("FOREST_ROUNDS", rounds)):
        monkeypatch.setattr(simhash_similar, name, value)
    rng = random.Random(rounds)
    texts = copies(rng, 60, 120, (1, 6)) + copies(rng, 30, 60, (0, 3)) + copies(rng, 20, 9, (0, 2)) + copies(rng, 12, 400, (10, 30)) + copies(rng, 6, 6000, (50, 300))
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == linked_classes(dict(enumerate(texts)))[0]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    made = []
    for n in (1, 3, 31, 33, 64, 65, 90, 300, 520, 3000, 9000):
        own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        made += [np.unique(np.concatenate([own[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (0, 0, n // 20, n // 9, n // 3)]
    doc = np.repeat(np.arange(len(made)), [len(m) for m in made])
    column = parities.strings(doc, np.concatenate(made), len(made) + 1)
    assert [8 * len(s) for s in column.to_pylist()] == [*(min(8192, max(64, 1 << (2 * len(m) - 1).bit_length())) for m in made), 64]
    i, j = (x.ravel() for x in np.indices((len(made), len(made))))
    told = parities.Parities(pa.chunked_array([column[:7], column[7:]])).apart(i, j)
    true = np.array([len(np.setxor1d(made[x], made[y])) for x, y in zip(i, j, strict=True)])
    assert (told <= true).all() and ((true - told) % 2 == 0).all()
    near = (true > 0) & (true <= 40) & (np.array([len(made[x]) for x in i]) >= 90)
    assert near.any() and (told[near] >= 0.8 * true[near]).all()
    unknown = parities.Parities(pa.array([None, b"", column[9].as_py()], pa.binary()))
    assert unknown.apart(np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [0, 0, 0]


def test_spanning_connects_with_the_least():
    rng = np.random.default_rng(9)
    for n, m in ((1, 0), (2, 1), (5, 40), (60, 50), (60, 900)):
        a, b, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 5, m)
        kept = blocks.spanning(n, a, b, w)
        own, total = np.arange(n), 0
        for k in np.lexsort((b, a, w)):  # Kruskal
            if own[a[k]] != own[b[k]]:
                own[own == own[a[k]]] = own[b[k]]
                total += w[k]
        assert (blocks.roots(n, a, b) == blocks.roots(n, a[kept], b[kept])).all()
        assert len(kept) == n - len(set(own.tolist())) and w[kept].sum() == total
