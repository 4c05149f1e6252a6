"""Substring dedup by relative Lempel-Ziv parsing against the corpus itself.

The reference is every document, indexed in blocks. A block is an anchor, an 8-word gram whose hash is the
least among the 28 of some 35-word window, with the 27 words before and after it. Equal windows
choose equal anchors, so a factor of 35 words or more shares an anchor with any place that it equals.

Index: the blocks of each anchor are sorted twice, by the words after it and by the words before it, over range
partitions, so that no popular anchor is one task's. In such an order the longest match to that side is with a
neighbour: comparing each block with a few neighbours gives its matches (how far to the left and to the right) and the
farthest that any block agrees to either side. Anchors whose blocks all agree need no words: they match over the whole block.

Parse: matches with one place on one diagonal join to longer ones. From the left, a text takes the longest match at each
word as a factor (document, start, length, source, offset) and goes on at its end; where none of 35 words
begins, it goes on at the next that does. The longest is that of the matches which the neighbours show: where many blocks of an
anchor differ at both ends, or a text repeats itself, a place that is no neighbour may match longer. Factors and matches of 35 words or more are duplicate spans. At the boundaries
of matches a window may equal one place to its left and another to its right part by part, and whole a third one that no neighbour
showed. Those windows (that the farthest agreements don't rule out) are looked up by hash among all windows of
their anchor, so the spans are exact.

Words are compared by hashes of 64 bits, windows at boundaries by 64 bits together with those of their anchor, equal
texts by MD5. Equal texts are one content from the start, before any text is shuffled: the first of a common one is
chosen where it is read. A content of several rows goes as a whole, if it has a window.

Words are runs of bytes other than space and \\t..\\r, unchanged. A null text is an empty one: no words.
Windows never cross documents. Repeated rows are copies of each other. A very long text is expanded a piece at a time. Ties between
factors go to the smaller source. Empty tables give empty results. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from . import wordhash as wh
from .common import BROADCAST_IDS, COMMON_SHARE, Scratch, spread_join, table, text_slices

WINDOW, GRAM = 35, 8
#: Neighbours to each side that a block is compared with.
NEIGHBOURS = 4
_CONTEXT, _WINDOW = 2, 3  # bases of the hashes


def sliding(values: np.ndarray, k: int, best) -> np.ndarray:
    """best over each k neighbours, by doubling."""
    out, span = values, 1
    while span < k:
        step = min(span, k - span)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        span += step
    return out


class Parsed:
    """The anchors and windows of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.words = w = wh.words_of(data, offsets)
        self.window, self.gram, n = window, gram, len(w.doc)
        grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        at, hashes = w.windows(gram, 1)
        grams[at] = hashes
        self.grams = grams
        #: The least gram of the window at each word; windows that leave the text are not valid.
        self.low = np.zeros(n, np.uint64)
        self.valid = np.zeros(n, bool)
        if n >= window:
            m = n - window + 1
            self.valid[:m] = w.doc[:m] == w.doc[window - 1 :]
            self.low[:m] = sliding(grams[: n - gram + 1], window - gram + 1, np.minimum)[:m]

    def anchors(self) -> np.ndarray:
        """Words where a gram begins that is the least of some window."""
        k = self.window - self.gram + 1
        low = np.where(self.valid, self.low, np.uint64(0))
        top = sliding(np.concatenate([np.zeros(k - 1, np.uint64), low]), k, np.maximum)
        return np.flatnonzero((top == self.grams) & (top > 0)) if len(low) else np.empty(0, np.int64)

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the blocks: the words that windows with the gram can reach, and where it lies among them."""
        reach, w = self.window - self.gram, self.words
        first, end = w.first[w.doc[at]], w.first[w.doc[at] + 1]
        a, b = np.maximum(at - reach, first), np.minimum(at + self.gram + reach, end)
        return wh.mix(wh.spans_hash(w.hashes, a, b, _CONTEXT) + (at - a).astype(np.uint64))

    def window_hash(self, at: np.ndarray) -> np.ndarray:
        return wh.spans_hash(self.words.hashes, at, at + self.window, _WINDOW)


def lists(kind: pa.StructType | pa.DataType, values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def kept_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def index(keyed: DataFrame, id_col: str, window: int, gram: int) -> DataFrame:
    """id, c, n_words, whole (the hash if nothing goes), anchors (h, x, p) of each row of id, text, c."""
    anchor = T.StructType([T.StructField("h", T.LongType()), T.StructField("x", T.LongType()), T.StructField("p", T.IntegerType())])
    schema = T.StructType([keyed.schema[id_col], T.StructField("c", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType()), T.StructField("anchors", T.ArrayType(anchor))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                parsed = Parsed(data, offsets, window, gram)
                w, at, raw = parsed.words, parsed.anchors(), data.tobytes()
                values = pa.StructArray.from_arrays([pa.array(parsed.grams[at].view(np.int64)), pa.array(parsed.contexts(at).view(np.int64)), pa.array((at - w.first[w.doc[at]]).astype(np.int32))], names=["h", "x", "p"])
                whole = [kept_hash(raw[s:e].split()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(w.counts().astype(np.int64)), pa.array(whole), lists(None, values, np.bincount(w.doc[at], minlength=b - a))], names=schema.names)

    return keyed.select(id_col, "text", "c").mapInArrow(run, schema)


def with_lists(texts: DataFrame, lists_: DataFrame) -> DataFrame:
    """(cid, text, at): one text of c, text for each row of c, cid, at; a single shuffle brings both together."""
    kind = dict(lists_.dtypes)["at"]
    rows = lists_.select("c", "cid", "at", F.lit(None).cast("string").alias("text")).unionByName(texts.select("c", F.lit(None).cast("long").alias("cid"), F.lit(None).cast(kind).alias("at"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            c, known = now.column("c").to_pylist(), now.column("cid").is_valid().to_numpy()
            own, picked, last, met = [], [], None, False
            for k in range(len(c)):
                if known[k]:
                    last, met = k, False
                elif last is not None and not met and c[k] == c[last]:
                    own.append(last)
                    picked.append(k)
                    met = True
            held = now.slice(last, 1) if last is not None and not met else None
            take = lambda column, at: now.column(column).take(pa.array(at, pa.int64())).combine_chunks()  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([take("cid", own), take("text", picked), take("at", own)], names=["cid", "text", "at"])

    dealt = rows.repartition("c").sortWithinPartitions("c", F.col("cid").isNull())
    return dealt.mapInArrow(run, f"cid long, text string, at {kind}")


def contexts_of(words: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray, gram: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """[anchor, word]: the words before each anchor (nearest first) and after it; 0 beyond the text."""
    k = np.arange(reach)
    before, after = at[:, None] - 1 - k, at[:, None] + gram + k
    n = max(len(words), 1)
    left = np.where(before >= first[:, None], words[np.clip(before, 0, n - 1)], np.uint64(0)) if len(words) else np.zeros(before.shape, np.uint64)
    right = np.where(after < end[:, None], words[np.clip(after, 0, n - 1)], np.uint64(0)) if len(words) else np.zeros(after.shape, np.uint64)
    return left, right


_OCCURRENCE = "h long, cid long, p int, full boolean, lo int, ro int, left binary, right binary"


def occurrences(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each block of cid, text, at (h, p, full): the words around it (nothing where all blocks of its anchor agree), how many there are."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OCCURRENCE.split(", ")]
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                w = wh.words_of(data, offsets)
                hashes = np.maximum(w.hashes, np.uint64(1))
                at = batch.column(2).slice(a, b - a)
                flat = at.flatten()
                row = np.repeat(np.arange(b - a), at.value_lengths().to_numpy(zero_copy_only=False))
                h, p, full = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                word = p.astype(np.int64) + w.first[row]
                first, end = w.first[row], w.first[row + 1]
                lo, ro = np.minimum(word - first, reach).astype(np.int32), np.minimum(end - word - gram, reach).astype(np.int32)
                cid = batch.column(0).slice(a, b - a)
                for x in range(0, len(h), 4096):
                    part = slice(x, x + 4096)
                    left, right = contexts_of(hashes, first[part], end[part], word[part], gram, reach)
                    whole = full[part].astype(bool)
                    sides = [pa.array([b"" if f else v.tobytes() for f, v in zip(whole, side.astype(">u8"), strict=True)], pa.binary()) for side in (left, right)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[part]), cid.take(pa.array(row[part])), pa.array(p[part]), pa.array(whole), pa.array(lo[part]), pa.array(ro[part]), *sides], names=names)

    return candidates.select("cid", "text", "at").mapInArrow(run, _OCCURRENCE)


_MATCH = "cid long, p int, h long, side int, full boolean, bound int, found array<struct<source: long, q: int, l: int, r: int>>"
_FOUND = pa.list_(pa.struct([("source", pa.int64()), ("q", pa.int32()), ("l", pa.int32()), ("r", pa.int32())]))


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading words two rows of words share."""
    return np.cumprod((x == y) & (x > 0), axis=1, dtype=np.int8).sum(1, dtype=np.int32)


_EDGE = "k1 binary, k2 binary, lo int, ro int, asked boolean"


class Neighbours:
    """Blocks in sorted order, each compared with a few before and after it. What is asked of a row is told once those after it came.

    Those that lack neighbours at the ends of a partition aren't told but handed on (asked), with as many more beside them; of the
    ends of all partitions, in order, edges tells what is asked."""

    names = [x.split()[0] for x in ("cid", "p", "h", "side", "full", "bound", "found")]

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.reach = window, gram, window - gram

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # rows in memory; the first of them are told and only kept as neighbours
        head, gone = None, 0  # the first rows of the partition; how many are no longer held
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]) if held is not None else now
            if not gone:
                head = held.slice(0, 2 * NEIGHBOURS)
            upto = held.num_rows - NEIGHBOURS
            if upto > done:
                a = max(done, NEIGHBOURS - gone)
                if upto > a:
                    yield self.with_edge(self.told(held, a, upto))
                cut = max(0, upto - NEIGHBOURS)
                held, done, gone = held.slice(cut), upto - cut, gone + cut
        if held is not None:
            n = gone + held.num_rows
            tail = min(2 * NEIGHBOURS, n - head.num_rows)
            at = np.concatenate([np.arange(head.num_rows), np.arange(n - tail, n)])
            rows = pa.concat_tables([head, held.slice(held.num_rows - tail)]).combine_chunks()
            one = lambda c: rows.column(c).combine_chunks()
            asked = pa.array((at < NEIGHBOURS) | (at >= n - NEIGHBOURS))
            nothing = [pa.nulls(rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, _FOUND)]
            yield pa.RecordBatch.from_arrays([*map(one, self.names[:5]), *nothing, *map(one, ("k1", "k2", "lo", "ro")), asked], names=[*self.names, "k1", "k2", "lo", "ro", "asked"])

    def with_edge(self, told: pa.RecordBatch) -> pa.RecordBatch:
        n = told.num_rows
        kinds = {"k1": pa.binary(), "k2": pa.binary(), "lo": pa.int32(), "ro": pa.int32(), "asked": pa.bool_()}
        return pa.RecordBatch.from_arrays([*told.columns, *(pa.nulls(n, k) for k in kinds.values())], names=[*self.names, *kinds])

    def edges(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            rows = pa.Table.from_batches(parts).combine_chunks()
            yield self.told(rows, 0, rows.num_rows).filter(rows.column("asked").combine_chunks())

    def words(self, column: pa.ChunkedArray) -> np.ndarray:
        blank = bytes(8 * self.reach)
        raw = b"".join(v or blank for v in column.to_pylist())
        return np.frombuffer(raw, ">u8").reshape(len(column), self.reach).astype(np.uint64)

    def told(self, rows: pa.Table, a: int, b: int) -> pa.RecordBatch:
        n = rows.num_rows
        h, side, cid, p, full, lo, ro = (rows.column(c).to_numpy() for c in ("h", "side", "cid", "p", "full", "lo", "ro"))
        k1, k2 = self.words(rows.column("k1")), self.words(rows.column("k2"))
        bound = np.zeros(n, np.int32)
        best = np.full((3, n), -1, np.int64)  # of the longest match, the one farthest to the left, the one farthest to the right
        value = np.full((3, n), -1, np.int64)
        ls, rs = np.zeros((3, n), np.int32), np.zeros((3, n), np.int32)

        def offer(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            for k, score in enumerate(((left + right) * 64 + left, left * 64 + right, right * 64 + left)):
                # of equal ones the smallest content, so that the anchors of a passage choose the same source
                better = (score > value[k, i]) | ((score == value[k, i]) & (cid[j] < cid[best[k, i]]))
                at = i[better]
                value[k, at], best[k, at], ls[k, at], rs[k, at] = score[better], j[better], left[better], right[better]

        for d in range(1, NEIGHBOURS + 1):
            if d >= n:
                break
            i = np.flatnonzero((h[d:] == h[:-d]) & (side[d:] == side[:-d]))
            j = i + d
            x, y = agreeing(k1[i], k1[j]), agreeing(k2[i], k2[j])
            whole = full[i].astype(bool)
            left, right = np.where(side[i] == 0, y, x), np.where(side[i] == 0, x, y)
            left, right = np.where(whole, lo[i], left), np.where(whole, ro[i], right)
            if d == 1:
                np.maximum.at(bound, i, x)
                np.maximum.at(bound, j, x)
            enough = left + self.gram + right >= self.window
            for u, v in ((i, j), (j, i)):
                offer(u[enough], v[enough], left[enough], right[enough])
        pick = best[:, a:b].T
        keep = pick >= 0
        for k in (1, 2):
            keep[:, k] &= (pick[:, k] != pick[:, 0]) & ((k < 2) | (pick[:, k] != pick[:, 1]))
        chosen = pick[keep]
        offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(cid[chosen]), pa.array(p[chosen].astype(np.int32)), pa.array(ls[:, a:b].T[keep]), pa.array(rs[:, a:b].T[keep])], names=["source", "q", "l", "r"])
        out = rows.slice(a, b - a).combine_chunks()
        one = lambda c: out.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays([one("cid"), one("p"), one("h"), one("side"), one("full"), pa.array(bound[a:b]), pa.ListArray.from_arrays(pa.array(offsets), values)], names=self.names)


def matches(blocks_: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """For each block, by the words after it (side 0) and before it (side 1): its matches, and the farthest that any block agrees to that side.
    The ends of the range partitions, 16 rows of each, meet in one task."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("k1"), F.col("left").alias("k2")), F.struct(F.lit(1).alias("side"), F.col("left").alias("k1"), F.col("right").alias("k2")))
    rows = blocks_.select("h", "cid", "p", "full", "lo", "ro", F.inline(sides)).where("side = 0 or not full")
    order, near = ["h", "side", "k1", "k2", "cid", "p"], Neighbours(window, gram)
    told = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(near.run, f"{_MATCH}, {_EDGE}"), "matches")
    ends = told.where("asked is not null").drop("bound", "found").coalesce(1).sortWithinPartitions(*order)
    return told.where("asked is null").select(*near.names).unionByName(scratch.table(ends.mapInArrow(near.edges, _MATCH), "matches-at-ends"))


_PARSED = "cid long, factors array<struct<start: int, length: int, source: long, offset: int>>, spans array<struct<start: int, end: int>>, open array<struct<h: long, p: int, start: int>>"


def greedy(intervals: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, source, offset) of matches (start, end, source, diagonal), the longest at each word."""
    intervals.sort()
    out, i, k, best = [], 0, 0, None
    while True:
        while k < len(intervals) and intervals[k][0] <= i:
            if best is None or intervals[k][1] > best[1]:
                best = intervals[k]
            k += 1
        if best is not None and best[1] - i >= window:
            out.append((i, best[1] - i, best[2], i + best[3]))
            i = best[1]
        elif k < len(intervals):
            i = intervals[k][0]
        else:
            return out


def parsed(found: DataFrame, window: int, gram: int) -> DataFrame:
    """factors, spans and windows still open of each content, of its matches."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in blocks.groups(batches, ["cid"]):
            cid, p, side, bound, h, full = (part.column(c).to_numpy() for c in ("cid", "p", "side", "bound", "h", "full"))
            lists_ = part.column("found").combine_chunks()
            flat, per = lists_.flatten(), lists_.value_lengths().to_numpy(zero_copy_only=False)
            source, q, left, right = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            row = np.repeat(np.arange(len(p)), per)
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            mine = p[row].astype(np.int64)
            start, end, diagonal, content = mine - left, mine + gram + right, q - mine, group[row]
            # matches with one place on one diagonal that overlap are one match
            order = np.lexsort((end, start, diagonal, source, content))
            start, end, diagonal, source, content = (v[order] for v in (start, end, diagonal, source, content))
            new = np.ones(len(start), bool)
            if len(start):
                same = (content[1:] == content[:-1]) & (source[1:] == source[:-1]) & (diagonal[1:] == diagonal[:-1])
                run_of = np.concatenate([[0], np.cumsum(~same)])
                span = int(end.max()) + 1
                upto = np.maximum.accumulate(end + run_of * span) - run_of * span
                new[1:] = ~same | (start[1:] > upto[:-1])
            first = np.flatnonzero(new)
            start, end, diagonal, source, content = start[first], np.maximum.reduceat(end, first) if len(first) else end[:0], diagonal[first], source[first], content[first]
            edges = np.searchsorted(content, np.arange(len(at)))
            factors, spans, open_ = [], [], []
            for g in range(len(at) - 1):
                own = slice(int(edges[g]), int(edges[g + 1]))
                known = sorted(zip(start[own].tolist(), end[own].tolist(), source[own].tolist(), diagonal[own].tolist(), strict=True))
                factors.append([dict(zip(("start", "length", "source", "offset"), f, strict=True)) for f in greedy(known, window)])
                merged: list[list[int]] = []
                for x, y, _, _ in known:
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                spans.append([{"start": x, "end": y} for x, y in merged])
                rows = range(int(at[g]), int(at[g + 1]))
                limits: dict[int, list[int]] = {}
                for k in rows:
                    if not full[k]:
                        limits.setdefault(int(p[k]), [int(h[k]), 0, 0])[1 + int(side[k])] = int(bound[k])
                more = []
                farthest = np.maximum.accumulate(ends_at(known, limits)) if limits else None
                for place, (gram_hash, most_right, most_left) in limits.items():
                    for s in range(place - most_left, place - (reach - most_right) + 1):
                        if farthest[s] < s + window:
                            more.append({"h": gram_hash, "p": place, "start": s})
                open_.append(more)
            shape = lambda *names: pa.list_(pa.struct([(n, pa.int64() if n in ("source", "h") else pa.int32()) for n in names]))
            yield pa.RecordBatch.from_arrays([pa.array(cid[at[:-1]]), pa.array(factors, shape("start", "length", "source", "offset")), pa.array(spans, shape("start", "end")), pa.array(open_, shape("h", "p", "start"))], names=["cid", "factors", "spans", "open"])

    return found.repartition("cid").sortWithinPartitions("cid", "p", "side").mapInArrow(run, _PARSED)


def ends_at(known: list[tuple[int, int, int, int]], limits: dict[int, list[int]]) -> np.ndarray:
    """For each word up to the last anchor the farthest end of the matches that start there."""
    ends = np.zeros(max(limits) + 2, np.int64)
    for x, y, _, _ in known:
        if x < len(ends):
            ends[x] = max(ends[x], y)
    return ends


def windows_at(candidates: DataFrame, window: int, gram: int, around: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """(h, v, cid, start): windows of cid, text, places (h, p): those that start at p or (around) all that hold the anchor at p. With
    wanted, sorted hashes, only those are told."""
    cast = candidates.sparkSession.sparkContext.broadcast(wanted)
    back = np.arange(window - gram + 1) if around else np.zeros(1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                w = wh.words_of(data, offsets)
                at = batch.column(2).slice(a, b - a)
                flat = at.flatten()
                row = np.repeat(np.arange(b - a), at.value_lengths().to_numpy(zero_copy_only=False))
                word = flat.field(1).to_numpy(zero_copy_only=False) + w.first[row]
                start = (word[:, None] - back).ravel()
                row, h = np.repeat(row, len(back)), np.repeat(flat.field(0).to_numpy(zero_copy_only=False), len(back))
                ok = (start >= w.first[row]) & (start + window <= w.first[row + 1])
                start, row, h = start[ok], row[ok], h[ok]
                order = np.argsort(start, kind="stable")
                start, row, h = start[order], row[order], h[order]
                v = wh.spans_hash(w.hashes, start, start + window, _WINDOW).view(np.int64)
                if cast.value is not None:
                    told = np.isin(v, cast.value)
                    start, row, h, v = start[told], row[told], h[told], v[told]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(v), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array((start - w.first[row]).astype(np.int32))], names=["h", "v", "cid", "start"])

    return candidates.select("cid", "text", "places").mapInArrow(run, "h long, v long, cid long, start int")


def removed(candidates: DataFrame, window: int) -> DataFrame:
    """(cid, n_removed, kept, spans, factors) of cid, text, factors, spans, starts: spans are the words that go, [first, end)."""
    schema = "cid long, n_removed long, kept string, spans array<struct<start: int, end: int>>, factors array<struct<start: int, length: int, source: long, offset: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, starts = batch.column(1), batch.column(3), batch.column(4)
            counts, kept, gone = [], [], []
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or "").encode().split()
                mask = np.zeros(len(words) + 1, bool)
                for s in spans[k].as_py() or []:
                    mask[s["start"] : s["end"]] = True
                for s in starts[k].as_py() or []:
                    mask[s : s + window] = True
                mask = mask[: len(words)]
                counts.append(int(mask.sum()))
                kept.append(kept_hash([words[i] for i in np.flatnonzero(~mask).tolist()]))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                gone.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), batch.column(2)], names=["cid", "n_removed", "kept", "spans", "factors"])

    return candidates.select("cid", "text", "factors", "spans", "starts").mapInArrow(run, schema)


def looked_up(open_: DataFrame, at: DataFrame, texts: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """(cid, starts): the open windows (cid, h, start) that occur elsewhere. at: cid, h, p of all anchors; texts: cid, text. Only
    windows that equal an open one are told of the other texts; their hashes go along up to a size, and in any case by a join."""
    lists_ = open_.groupBy("cid").agg(F.collect_list(F.struct("h", F.col("start").alias("p"))).alias("places"))
    own = scratch.table(windows_at(texts.join(lists_, "cid"), window, gram, False).distinct(), "open-windows")
    wanted = scratch.table(own.groupBy("h", "v").agg(F.count("*").alias("n")), "wanted-windows")
    few = wanted.count() <= BROADCAST_IDS
    hashes = np.unique(np.array([r["v"] for r in wanted.select("v").collect()], np.int64)) if few else None
    places = at.join(wanted.select("h").distinct(), "h", "left_semi").groupBy("cid").agg(F.collect_list(F.struct("h", "p")).alias("places"))
    equal = windows_at(texts.join(places, "cid"), window, gram, True, hashes).join(F.broadcast(wanted) if few else wanted, ["h", "v"], "left_semi")
    place = F.xxhash64("cid", "start")
    twice = equal.groupBy("h", "v").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("h", "v")
    twice = scratch.table(wanted.join(twice, ["h", "v"], "left_semi"), "equal-windows")
    hits = spread_join(own, twice, ["h", "v"], own.count(), "left_semi")
    return scratch.table(hits.groupBy("cid").agg(F.collect_set("start").alias("starts")), "starts")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, spans (of removed words), content (number of the text), factors (start, length, source
    content, offset there): a row for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("c"))
    with Scratch(docs.sparkSession) as scratch:
        indexed = scratch.kept(index(keyed, id_col, window, gram), "reference")
        contents = indexed.groupBy("c").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"))
        contents = scratch.table(contents.withColumn("cid", F.monotonically_increasing_id()), "contents")
        anchors = contents.select("cid", F.inline("anchors"))
        shared = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).where("n > 1")
        shared = scratch.table(shared.select("h", "n", (F.col("low") == F.col("high")).alias("full")), "anchors")
        at = scratch.table(spread_join(anchors.select("cid", "h", "p"), shared, ["h"], anchors.count()), "places")
        lists_ = at.groupBy("cid").agg(F.collect_list(F.struct("h", "p", "full")).alias("at")).join(contents.select("cid", "c"), "cid")
        # of a common content one text is chosen before any is shuffled
        total = indexed.count()
        common = F.broadcast(contents.where(F.col("n") > total // COMMON_SHARE).select("c"))
        texts = keyed.select("c", "text")
        texts = texts.join(common, "c", "left_anti").unionByName(texts.join(common, "c", "left_semi").groupBy("c").agg(F.first("text").alias("text")))
        candidates = scratch.table(with_lists(texts, lists_), "candidates")
        found = matches(scratch.table(occurrences(candidates, window, gram), "blocks"), window, gram, scratch)
        told = scratch.table(parsed(found, window, gram), "parsed")
        open_ = scratch.table(told.select("cid", F.inline("open")), "open")
        starts = looked_up(open_, at, candidates.select("cid", "text"), window, gram, scratch)
        single = contents.where("n = 1").select("cid")
        touched = told.where(F.size("spans") > 0).select("cid", "factors", "spans").join(starts, "cid", "full_outer").join(single, "cid", "left_semi")
        cut = removed(candidates.join(touched, "cid"), window)
        copied = contents.where((F.col("n") > 1) & (F.col("n_words") >= window))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
        itself = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"), F.col("cid").alias("source"), F.lit(0).alias("offset")))
        gone = copied.select("cid", F.col("n_words").alias("n_removed"), F.lit(kept_hash([])).alias("kept"), whole.alias("spans"), itself.alias("factors"))
        found = scratch.kept(cut.unionByName(gone).join(contents.select("cid", "c", "n"), "cid"), "spans")
        out = spread_join(indexed.drop("anchors"), found, ["c"], total, "left")
    none = F.lit(0).cast("long")
    return out.select(id_col, "n_words", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"), "spans", F.col("cid").alias("content"), "factors")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
