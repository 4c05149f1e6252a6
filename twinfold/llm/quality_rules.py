"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows.

The forests see a text only through rates of the rule statistics: one forest splits each rate, one
all of them (a joint forest alone hides a rate that is unusual among many that vary). Random
splits isolate unusual rows in few steps; from the mean path length over all trees comes the
anomaly score (near 1: unusual). Each threshold is the lowest score that removes at most its
share of ``max_clean_loss`` of the rows labelled good, so that clean documents stay.

Nulls and empty texts: no words, so the base rule fails and kept is false. Ties: equal statistics
have equal scores. Repeated rows each give a row. No labels: nothing is removed beyond the
base rule. Empty tables give empty results. Very long texts are expanded a piece at a time. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table
from .textstats import STATS, matrix, with_stats

TREES, ROWS_PER_TREE, SEED = 100, 256, 20
#: The forest is fitted on at most this many labelled rows, those with the lowest id hashes.
FOREST_ROWS = 8_000
MAX_CLEAN_LOSS = 0.002
SCORE_BINS = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def rates(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as rates that don't depend on a text's length."""
    words, chars, letters = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_upper"] + s["n_lower"], 1)
    return np.stack([s["n_symbols"] / chars, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words, s["n_upper"] / letters, s["n_marks"] / chars, s["n_digits"] / chars], axis=1)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # [tree, node], -1 at leaves
    split: np.ndarray
    child: np.ndarray  # left child; the right one follows it
    length: np.ndarray  # of the path that ends here
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, s, c, length in zip(self.feature, self.split, self.child, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(64):
                inner = f[node] >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f[node], 0)] >= s[node]
                node = np.where(inner, c[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.norm)


def fit_forest(x: np.ndarray, trees: int = TREES, rows: int = ROWS_PER_TREE, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    deepest = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    size = 2 ** (deepest + 1)
    feature, split = np.full((trees, size), -1), np.zeros((trees, size))
    child, length = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        queue, used = [(0, x[rng.choice(len(x), rows, replace=False)] if rows else x[:0], 0)], 1
        while queue:
            node, part, depth = queue.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(x.shape[1]),) * 2
            open_ = np.flatnonzero(high > low)
            if depth >= deepest or len(part) <= 1 or not len(open_):
                length[t, node] = depth + float(mean_path(len(part)))
                continue
            f = rng.choice(open_)
            at = rng.uniform(low[f], high[f])
            at = at if at > low[f] else high[f]
            feature[t, node], split[t, node], child[t, node] = f, at, used
            right = part[:, f] >= at
            queue += [(used, part[~right], depth + 1), (used + 1, part[right], depth + 1)]
            used += 2
    return Forest(feature, split, child, length, max(float(mean_path(rows)), 1e-9))


def forests(x: np.ndarray) -> list[tuple[list[int], Forest]]:
    """One forest over the random splits of each rate, and one over all of them."""
    groups = [[k] for k in range(x.shape[1])] + [list(range(x.shape[1]))]
    return [(g, fit_forest(x[:, g], TREES if len(g) > 1 else TREES // 2, seed=SEED + k)) for k, g in enumerate(groups)]


def scored(stats: DataFrame, fitted: list[tuple[list[int], Forest]]) -> DataFrame:
    """stats with anomaly, the score of each forest in turn."""
    cast = stats.sparkSession.sparkContext.broadcast(fitted)  # fixed size: trees x nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rates(matrix(batch))
            scores = np.stack([forest.scores(x[:, g]) for g, forest in cast.value], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "anomaly"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("anomaly", T.ArrayType(T.DoubleType()))]))


def thresholds(labelled: DataFrame, n: int, max_clean_loss: float = MAX_CLEAN_LOSS) -> list[float]:
    """For each forest the lowest score above which at most its share of max_clean_loss of the good
    labelled rows lies; from histograms of fixed size. Without good rows nothing exceeds it."""
    good = np.zeros((n, SCORE_BINS + 2))
    at = labelled.where("quality = 1").select(F.posexplode("anomaly").alias("forest", "score"))
    for row in at.groupBy("forest", F.floor(F.col("score") * SCORE_BINS).alias("bin")).count().collect():
        good[row["forest"], int(row["bin"]) + 1] = row["count"]
    above = good.sum(1, keepdims=True) - np.cumsum(good, axis=1)
    return [float(np.flatnonzero(a <= max_clean_loss / n * g.sum())[0] / SCORE_BINS) if g.sum() else 1.0 for a, g in zip(above, good, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_clean_loss: float = MAX_CLEAN_LOSS) -> DataFrame:
    """id, all statistics, base_failed, anomaly, kept: a row for each row of docs. labels: id, quality 0 or 1."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.kept(with_stats(docs, id_col, text_col), "rule-stats").withColumn("base_failed", base)
        own = labels.where("quality is not null").groupBy(id_col).agg(F.min("quality").alias("quality"))
        labelled = scratch.table(stats.where(~F.col("base_failed")).join(own, id_col), "labelled")
        share = min(1.0, 1.2 * FOREST_ROWS / max(1, labelled.count()))  # so that no task sends many more rows than are wanted
        few = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        sample = few.orderBy(F.xxhash64(id_col), *STATS).limit(FOREST_ROWS).select(*STATS).toPandas()
        fitted = forests(rates({s: sample[s].to_numpy(float) for s in STATS}))
        limits = thresholds(scored(labelled.select("quality", *STATS), fitted), len(fitted), max_clean_loss)
    usual = F.forall(F.zip_with("anomaly", F.array(*map(F.lit, limits)), lambda score, limit: score <= limit), lambda x: x)
    return scored(stats, fitted).withColumn("kept", ~F.col("base_failed") & usual)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_max("anomaly").alias("anomaly"))


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE_SQL: dict[str, str] = {}
