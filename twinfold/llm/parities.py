"""Parities of sets: a bound of how many members two sets differ in, from a few bytes of each.

Each member flips one bit, by its hash, of a string of bits. What two sets share flips the same bits of both, so the strings differ
in no more bits than the sets do in members, and in nearly as many while the strings are long against that. A string of
twice the length becomes one of the length by joining its halves with XOR, so strings of all lengths compare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import wordhash as wh

#: A set of n has the power of two from 2 n on bits, within these bounds; beyond some 4,000 members the bound is weaker, never wrong.
LEAST_BITS, MOST_BITS = 64, 8192
#: Bytes of strings that are compared at once.
PIECE = 4 << 20


def widths(n: np.ndarray) -> np.ndarray:
    """The bits of the string of sets of n."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def strings(doc: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
    """The string of each of n sets, given as (set, member)."""
    bits = widths(np.bincount(doc, minlength=n))
    ends = np.cumsum(bits)
    at = (ends - bits)[doc] + (wh.mix(hashes) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=int(ends[-1]) if n else 0) & 1).astype(np.uint8), bitorder="little")
    offsets = np.concatenate([[0], ends // 8]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


class Parities:
    """The strings of rows (null: unknown), to be compared in pairs."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null(b"").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.words = np.frombuffer(data.tobytes(), np.uint64)
        self.start, self.size = (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings of at least so many words, joined to that many, and the place of each row among them."""
        if size not in self.folded:
            place, parts, n = np.zeros(len(self.size), np.int64), [], 0
            for own in np.unique(self.size[self.size >= size]).tolist():
                rows = np.flatnonzero(self.size == own)
                place[rows] = n + np.arange(len(rows))
                parts.append(np.bitwise_xor.reduce(self.words[self.start[rows][:, None] + np.arange(own)].reshape(len(rows), own // size, size), axis=1))
                n += len(rows)
            self.folded[size] = place, np.concatenate(parts)
        return self.folded[size]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many members the sets of rows i and j differ at least; 0 where a string is unknown."""
        least, out = np.minimum(self.size[i], self.size[j]), np.zeros(len(i), np.int64)
        for size in np.unique(least[least > 0]).tolist():
            place, own = self.at(size)
            pairs, step = np.flatnonzero(least == size), max(1, PIECE // (8 * size))
            for a in range(0, len(pairs), step):
                some = pairs[a : a + step]
                out[some] = np.bitwise_count(own[place[i[some]]] ^ own[place[j[some]]]).sum(axis=1, dtype=np.int64)
        return out
