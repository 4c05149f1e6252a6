"""Words, windows and lines of many texts at once, as NumPy arrays of 64-bit hashes.

Words are maximal runs of bytes other than space and \\t..\\r. Hashes are polynomials
modulo 2**64, taken from running sums, then mixed; they are equal for equal words in
every process. A text's words never join those of its neighbours in the slice.

A slice may be one very long text: what is made for each byte is made for PIECE bytes at a time, runs that cross
the border of two pieces are joined, and a span longer than a piece is hashed in parts. What stays
is 20 bytes a word, and 8 for each window's hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
PIECE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
Test = Callable[[np.ndarray], np.ndarray]


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if which not in _powers or len(_powers[which][0]) < n:
        size, out = (n + 65535) >> 16 << 16, []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _powers[which] = (out[0], out[1])
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def long_span(values: np.ndarray, which: int) -> int:
    """The polynomial of all values, a piece at a time."""
    total = 0
    for a in range(0, len(values), PIECE):
        part = values[a : a + PIECE]
        one = int(((part.astype(U) + U(1)) * powers(which, len(part))[0][: len(part)]).sum(dtype=U))
        total += one * pow(BASES[which], a, 1 << 64)
    return total & ((1 << 64) - 1)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A mixed hash of values[start:end] for each span; both starts and ends ascend."""
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        end = int(np.searchsorted(ends, base + PIECE, "right"))
        if end <= k:
            out[k] = long_span(values[base : int(ends[k])], which)
            k += 1
            continue
        part = values[base : int(ends[end - 1])]
        n = len(part)
        pw, inverse = powers(which, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((part.astype(U) + U(1)) * pw[:n], dtype=U, out=total[1:])
        a, b = starts[k:end] - base, ends[k:end] - base
        out[k:end] = (total[b] - total[a]) * inverse[a]
        k = end
    return mix(out + (ends - starts).astype(U) * U(BASES[3]))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # of each word, within the slice
    first: np.ndarray  # first word of each text, and the end
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of all k-word windows inside one text."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, U)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, spans_hash(self.hashes, at, at + k, which)


def space_mask(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_mask(data: np.ndarray) -> np.ndarray:
    return ~space_mask(data)


def runs(test: Test, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that pass the test, broken at the offsets."""
    starts, ends = [], []
    for a in range(0, len(data), PIECE):
        mask = test(data[a : a + PIECE])
        n = len(mask)
        cut = np.zeros(n + 1, bool)
        cut[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + n, "right")] - a] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = mask[:-1]
        before[cut[:-1]] = False
        after[:-1] = mask[1:]
        after[cut[1:]] = False
        starts.append((np.flatnonzero(mask & ~before) + a).astype(np.int32))
        ends.append((np.flatnonzero(mask & ~after) + 1 + a).astype(np.int32))
    if not starts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    start, end = np.concatenate(starts), np.concatenate(ends)
    apart = np.ones(len(start) + 1, bool)
    for a in range(PIECE, len(data), PIECE):  # a run that was only broken by the border of two pieces
        k = int(np.searchsorted(start, a))
        if 0 < k < len(start) and start[k] == a and end[k - 1] == a and offsets[np.searchsorted(offsets, a)] != a:
            apart[k] = False
    return start[apart[:-1]], end[apart[1:]]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends = runs(word_mask, data, offsets)
    first = np.searchsorted(starts, offsets, "left")
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    return Words(starts, ends, doc, first, spans_hash(data, starts, ends, 0))


def per_text(test: Test, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text pass the test."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a in range(0, len(data), PIECE):
        mask = test(data[a : a + PIECE])
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, a + len(mask), "left"))
        at = np.clip(offsets[i : j + 1], a, a + len(mask)) - a
        out[i:j] += total[at[1:]] - total[at[:-1]]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a k-word window that begins at one of starts."""
    edge = np.zeros(n + k + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge, dtype=np.int32)[:n] > 0


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of each \\n-split line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    doc = np.repeat(np.arange(len(offsets) - 1), np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + 1)
    return starts, ends, doc
