"""Statistics of whole texts, made in one pass by the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import wordhash as wh
from .common import lean, text_slices

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_commas", "n_stops", "n_distinct", "n_non_ascii", "n_long_words", "n_short_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: An n-gram that repeats within a text counts from this many words on.
REPEAT_WINDOW = 8


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    w = wh.words_of(data, offsets)
    at, keys = w.windows(REPEAT_WINDOW)
    salt = wh.mix(np.arange(1, n + 1, dtype=np.uint64))
    hit = at[wh.repeated(keys ^ salt[w.doc[at]])]
    repeat = np.bincount(w.doc[wh.covered(hit, REPEAT_WINDOW, len(w.doc))], minlength=n)
    starts, ends, doc = wh.lines_of(data, offsets)
    filled = np.searchsorted(w.starts, starts, "left") < np.searchsorted(w.starts, ends, "left")
    lines = wh.spans_hash(data, starts[filled], ends[filled], 2) ^ salt[doc[filled]]
    kept = np.zeros(len(lines), bool)
    kept[np.unique(lines, return_index=True)[1]] = True
    length = w.ends - w.starts
    distinct = np.unique(w.hashes ^ salt[w.doc], return_index=True)[1]
    return {
        "n_words": w.counts(),
        "word_chars": wh.per_text(lambda b: wh.word_mask(b) & ((b & 0xC0) != 0x80), data, offsets),
        "n_symbols": wh.per_text(lambda b: _SYMBOLS[b], data, offsets),
        "n_lines": np.bincount(doc, minlength=n),
        "n_dup_lines": np.bincount(doc[filled][~kept], minlength=n),
        "n_repeat_words": repeat,
        "n_upper": wh.per_text(lambda b: (b >= 65) & (b <= 90), data, offsets),
        "n_lower": wh.per_text(lambda b: (b >= 97) & (b <= 122), data, offsets),
        "n_digits": wh.per_text(lambda b: (b >= 48) & (b <= 57), data, offsets),
        "n_marks": wh.per_text(lambda b: _MARKS[b], data, offsets),
        "n_commas": wh.per_text(lambda b: b == 44, data, offsets),
        "n_stops": wh.per_text(lambda b: b == 46, data, offsets),
        "n_distinct": np.bincount(w.doc[distinct], minlength=n),
        "n_non_ascii": wh.per_text(lambda b: b >= 0xC0, data, offsets),
        "n_long_words": np.bincount(w.doc[length >= 12], minlength=n),
        "n_short_words": np.bincount(w.doc[length <= 2], minlength=n),
    }


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics as long) of each row; a null text is an empty one. Rows are neither dropped nor merged."""
    schema = T.StructType([docs.schema[id_col]] + [T.StructField(s, T.LongType()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                stats = text_stats(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(stats[s].astype(np.int64)) for s in STATS)], names=[id_col, *STATS])

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def matrix(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {s: batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(float) for s in STATS}
