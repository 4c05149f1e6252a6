"""Packing by cutting-stock column generation.

Each document is its token ids and an end id. Whole sequences' worth of ids is cut off long documents;
the rests fall into 256 length classes. Over the histogram of classes a linear program chooses
patterns (how many rests of each class fill a sequence) and cuts (a rest of one class becomes two
of others): a master problem by the revised simplex method, columns priced by a knapsack dynamic program
over its dual prices. Patterns are rounded down, what remains is packed first-fit decreasing by class.
Documents are ranked within their class and ranks are dealt to patterns by ranges. All of the solver's
data has a fixed size: classes and patterns; counts by class and salt are a row for each ROWS_PER_SALT rests.

Whole sequences need no rank: each gets a number of its own where it is read. Rests are ranked by class and a salt; a class has
as many salts as it has ROWS_PER_SALT rests, so that no task ranks more of one common length. Token
ids never leave the task that makes them: for a cut, CRCs at multiples of 128 ids travel along, and
the CRC of the rest follows from them by polynomial arithmetic.

Ids come from a tokenizers file. Its vocabulary also exists as tiktoken ranks; texts whose characters are all
in the ranges where both libraries were found to agree on every code point and that hold no run of
hundreds of characters go through tiktoken, which is several times as fast; all others through tokenizers.

A null text is an empty one: a piece of one end id. Rows with null or repeated ids are packed each by itself.
Ties in rank are between rows that are alike. Empty tables give no piece. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lean, table

LENGTH, END_ID = 2048, 1
STEP = 8  # ids a class
CLASSES = LENGTH // STEP
CUT = 128  # ids; cuts lie at multiples
CUT_COST = 0.002  # sequences
ROWS_PER_SALT = 1_000_000
#: Characters on which both libraries cut and encode alike.
_UNCOMMON = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]")
#: Runs of blanks or of other characters from this length on go to tokenizers as well.
LONG_RUN = 400
_BLANKS = re.compile(r"\s{%d}" % LONG_RUN)
BATCH = 256


class Encoder:
    """Ids of texts by a tokenizers file, faster where that is safe."""

    def __init__(self, path: str, ranks: str | None):
        self.path, self.slow, self.fast = path, None, None
        if ranks:
            import base64
            import json

            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            with open(path, encoding="utf-8") as file:
                special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens=special)

    def safe(self, text: str) -> bool:
        if not text.isascii() and _UNCOMMON.search(text):
            return False
        return max(map(len, text.split()), default=0) < LONG_RUN and not _BLANKS.search(text)

    def exact(self, text: str) -> list[int]:
        if self.slow is None:  # loaded by the first text that needs it
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        return self.fast.encode(text, allowed_special="all") if self.fast is not None and self.safe(text) else self.exact(text)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None) -> Encoder:
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


# CRC-32 of a tail from those of the whole and the head


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
        if not vector:
            break
    return out


_BIT = [0xEDB88320] + [1 << k for k in range(31)]  # appends a zero bit


def crc_of_tail(whole: int, head: int, tail_bytes: int) -> int:
    """crc32(tail) of head + tail: crc32(head + tail) less crc32(head) moved over the tail's length in zeros."""
    matrix, moved, bits = _BIT, head, 8 * tail_bytes
    while bits:
        if bits & 1:
            moved = _times(matrix, moved)
        matrix = [_times(matrix, row) for row in matrix]
        bits >>= 1
    return whole ^ moved


PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("heads", T.ArrayType(T.LongType()))]


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, ranks: str | None, length: int, end_id: int) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, heads (CRCs before each possible cut): full pieces, then the rest of each document."""
    names = [id_col, *(n for n, _ in PIECE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, batch.num_rows, BATCH):
                rows, out = [], []
                for k, text in enumerate(texts.slice(a, BATCH)):
                    ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                    for start in range(0, len(ids), length):
                        raw = ids[start : start + length].tobytes()
                        heads, crc = [], 0
                        if len(raw) < 4 * length:
                            for at in range(0, len(raw) - 1, 4 * CUT):
                                if at:
                                    heads.append(crc)
                                crc = zlib.crc32(raw[at : at + 4 * CUT], crc)
                        else:
                            crc = zlib.crc32(raw)
                        rows.append(a + k)
                        out.append((start, len(raw) // 4, crc, len(ids), heads))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int64()))], names=names)

    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in PIECE)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


# The linear program


def knapsack(prices: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The dearest filling of size by classes 1.. of these prices, each as often as wanted."""
    best, taken = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        values = prices[:c] + best[c - 1 :: -1][:c]
        k = int(np.argmax(values))
        best[c], taken[c] = (values[k], k + 1) if values[k] > best[c - 1] else (best[c - 1], 0)
    pattern: dict[int, int] = {}
    c = size
    while c > 0:
        if taken[c]:
            pattern[int(taken[c])] = pattern.get(int(taken[c]), 0) + 1
            c -= int(taken[c])
        else:
            c -= 1
    return float(best[size]), pattern


def solve(demand: np.ndarray, size: int = CLASSES, cut: int = CUT // STEP, most: int = 5000, cuts: bool = True) -> tuple[list[tuple[dict[int, int], float]], list[tuple[int, int, float]]]:
    """Column generation. demand[c - 1]: rests of class c. Returns patterns and cuts (class, class of the head) with how often, not yet whole numbers."""
    if not (demand > 0).any():
        return [], []
    m = size - 1  # classes 1 .. size - 1; a cut may make rests of classes that nothing had
    d = demand[:m].astype(float)
    # start: each class by itself; a class without demand costs nothing at 0
    columns: list[tuple] = [("p", {c: size // c}) for c in range(1, m + 1)]
    base = list(range(m))
    inverse = np.diag([1.0 / (size // c) for c in range(1, m + 1)])
    costs = np.ones(m)
    x = inverse @ d
    heads = np.arange(cut, m, cut)
    pair = [(int(c), int(h)) for c in range(cut + 1, m + 1) for h in heads if h < c and cuts]
    pc, ph = np.array([p[0] for p in pair], np.int64), np.array([p[1] for p in pair], np.int64)
    for _ in range(most):
        dual = costs @ inverse
        entry = np.zeros(m)
        k = int(np.argmin(dual))
        if dual[k] < -1e-9:
            column, cost = ("s", k + 1), 0.0
            entry[k] = -1
        else:
            gain = dual[pc - 1] - dual[ph - 1] - dual[pc - ph - 1] - CUT_COST if len(pc) else np.zeros(0)
            value, pattern = knapsack(np.maximum(dual, 0), size) if m == size else knapsack(np.append(np.maximum(dual, 0), 0), size)
            best = int(np.argmax(gain)) if len(gain) else -1
            if best >= 0 and gain[best] > max(1e-7, value - 1):
                column, cost = ("c", int(pc[best]), int(ph[best])), CUT_COST
                entry[pc[best] - 1] += 1
                entry[ph[best] - 1] -= 1
                entry[pc[best] - ph[best] - 1] -= 1
            elif value > 1 + 1e-7:
                pattern = {c: n for c, n in pattern.items() if c <= m}
                column, cost = ("p", pattern), 1.0
                for c, n in pattern.items():
                    entry[c - 1] = n
            else:
                break
        move = inverse @ entry
        up = move > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        low = ratio.min()
        ties = np.flatnonzero(ratio <= low + 1e-12)
        out = int(ties[np.argmax(move[ties])])
        inverse[out] /= move[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(move[others], inverse[out])
        x = np.maximum(x - low * move, 0)
        x[out] = low
        columns.append(column)
        base[out] = len(columns) - 1
        costs[out] = cost
    patterns, made = [], []
    for k, n in zip(base, x, strict=True):
        if n > 1e-9 and columns[k][0] == "p":
            patterns.append((columns[k][1], float(n)))
        elif n > 1e-9 and columns[k][0] == "c":
            made.append((columns[k][1], columns[k][2], float(n)))
    return patterns, made


def whole_cuts(cuts: list[tuple[int, int, float]], demand: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """class -> (class of the head, how many) of rests that are there to cut."""
    out: dict[int, list[tuple[int, int]]] = {}
    for c, head, n in sorted(cuts):
        used = sum(k for _, k in out.get(c, []))
        if (k := min(int(n), int(demand[c - 1]) - used)) > 0:
            out.setdefault(c, []).append((head, k))
    return out


def whole_patterns(patterns: list[tuple[dict[int, int], float]], counts: np.ndarray, size: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole numbers that hold every rest exactly once. counts[c - 1]: rests of class c."""
    left, out = counts.astype(np.int64).copy(), []

    def take(pattern: dict[int, int], n: int) -> None:
        n = min([n, *(int(left[c - 1]) // k for c, k in pattern.items())])
        if n > 0:
            out.append((dict(pattern), n))
            for c, k in pattern.items():
                left[c - 1] -= n * k

    for pattern, n in sorted(patterns, key=lambda p: -p[1]):
        if pattern:
            take(pattern, int(n))
    while left.any():  # what rounding left: one greedy sequence at a time, as often as it goes
        room, pattern = size, {}
        for c in range(size, 0, -1):
            k = min(room // c, int(left[c - 1]))
            if k:
                pattern[c] = k
                room -= k * c
        take(pattern, 1 << 62)
    return out


def salt_ranks(df: DataFrame, counts: np.ndarray) -> DataFrame:
    """df with rank: a number from 0 within each class, counted by salt first. counts[c - 1]: rows of class c."""
    from pyspark.sql import Window

    salts = F.array(*(F.lit(int(n) // ROWS_PER_SALT + 1) for n in counts))
    df = df.withColumn("salt", F.pmod(F.xxhash64("piece"), F.element_at(salts, F.col("class"))).cast("int"))
    sizes = df.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("class", "salt").orderBy("piece")) - 1
    ranked = df.withColumn("within", within).join(F.broadcast(before), ["class", "salt"])  # a row for each class and each ROWS_PER_SALT rows
    return ranked.withColumn("rank", F.col("before") + F.col("within")).drop("before", "within", "salt")


def cut_pieces(df: DataFrame, cuts: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """df, ranked, with the first rests of each class cut in two at the place for their rank."""
    spark = df.sparkSession
    rows = []
    for c, parts in cuts.items():
        at = 0
        for head, n in parts:
            rows.append((c, at, at + n, head * STEP))
            at += n
    plan = spark.createDataFrame(rows, "class int, first long, end long, cut int")
    at = df.join(F.broadcast(plan), (df["class"] == plan["class"]) & (df["rank"] >= plan["first"]) & (df["rank"] < plan["end"]), "left").drop(plan["class"]).drop("first", "end", "rank", "class")
    names = at.columns
    spot = {n: k for k, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(spot["cut"])
            rows = np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False))
            yield batch.filter(where.is_null())
            if not len(rows):
                continue
            chosen = batch.take(pa.array(rows))
            get = {n: chosen.column(spot[n]).to_pylist() for n in ("start", "length", "ids_crc32", "heads", "cut")}
            head = [h[c // CUT - 1] for h, c in zip(get["heads"], get["cut"], strict=True)]
            tail = [crc_of_tail(w, h, 4 * (n - c)) for w, h, n, c in zip(get["ids_crc32"], head, get["length"], get["cut"], strict=True)]
            for start, length, crc in ((get["start"], get["cut"], head), ([s + c for s, c in zip(get["start"], get["cut"], strict=True)], [n - c for n, c in zip(get["length"], get["cut"], strict=True)], tail)):
                new = {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(n, chosen.column(k)) for n, k in spot.items()], names=names)

    return at.mapInArrow(lean(run), at.schema).drop("cut")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    from pyspark.sql import Window

    if tokenizer is None:
        tokenizer, ranks = tokenizer_paths()
    with_class = lambda df: df.withColumn("class", F.ceil(F.col("length") / STEP).cast("int"))
    numbered = lambda df: df.withColumn("piece", F.monotonically_increasing_id())
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens"]

    def histogram(df: DataFrame) -> np.ndarray:
        counts = np.zeros(CLASSES, np.int64)
        for row in df.groupBy("class").count().collect():
            counts[row["class"] - 1] = row["count"]
        return counts

    with Scratch(docs.sparkSession) as scratch:
        made = scratch.kept(numbered(pieces(docs, id_col, text_col, tokenizer, ranks, LENGTH, end_id)), "pieces")
        full = made.where(F.col("length") == LENGTH)
        # a rest of class CLASSES is as good as a full piece
        rests = with_class(made.where(F.col("length") < LENGTH))
        demand = histogram(rests)
        patterns, cuts = solve(np.append(demand[:-1], 0))
        chosen = whole_cuts(cuts, demand)
        if chosen:
            rests = with_class(scratch.kept(numbered(cut_pieces(salt_ranks(rests, demand), chosen).drop("piece")), "cut-pieces"))
            demand = histogram(rests)
            patterns, _ = solve(np.append(demand[:-1], 0), cuts=False)  # for the rests as they are now
    rows, at, used = [], 0, np.zeros(CLASSES, np.int64)
    for pattern, n in whole_patterns(patterns, demand):
        for c, k in pattern.items():
            rows.append((c, int(used[c - 1]), int(used[c - 1]) + n * k, k, at))
            used[c - 1] += n * k
        at += n
    plan = docs.sparkSession.createDataFrame(rows, "class int, first long, end long, times long, sequence long")  # patterns x classes: fixed
    ranked = salt_ranks(rests, demand)
    placed = ranked.join(F.broadcast(plan), (ranked["class"] == plan["class"]) & (ranked["rank"] >= plan["first"]) & (ranked["rank"] < plan["end"])).drop(plan["class"])
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("times")).cast("long"))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")) - F.col("length")
    placed = placed.withColumn("offset", before).select(*columns, "sequence_id", "offset")
    alone = full.select(*columns, (F.lit(at) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
