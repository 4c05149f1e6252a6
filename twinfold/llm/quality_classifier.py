"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over standardised document statistics. The
normal equations are summed in each partition, then sixteen sums meet in a task, and so on by rounds, so no task and
not the driver receives more than sixteen sums of fixed size. A fifth of the teaching rows (by a hash of the id) takes no part in that:
their ridge scores, in a histogram of fixed size, fit an isotonic map to the probability of label 1. Where either part
is empty all teaching rows serve for both.

Only rows whose ``crc32(id as text) mod 3`` is not 1 teach anything. Labels, language, source and id
are never inputs of a score: equal texts have equal scores. A null text is an empty one, a null
id counts as the empty text for crc32. An id with several labels counts with the lowest. Repeated
rows each give a row, ties have one score. Without labels every score is 0.5 and predicted is 1; an empty table gives an empty
result. Very long texts are expanded a piece at a time. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, lean, packed, table, text_slices, tree_sum
from .textstats import STATS, matrix, text_stats, with_stats

FOURIER, RIDGE, SEED = 256, 1.0, 8
SCORE_BINS = 2_000
#: One in so many teaching rows calibrates.
CALIBRATION = 5


def inputs(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    root = [s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / chars, s["n_commas"] / words, s["n_stops"] / words, s["n_non_ascii"] / chars, s["n_long_words"] / words, s["n_short_words"] / words, s["n_distinct"] / words]
    return np.stack([*(np.sqrt(np.maximum(r, 0)) for r in root), np.log1p(s["n_words"]), np.log1p(chars / words), np.log1p(words / lines)], axis=1)


N_INPUTS = 15


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, the last of the constant
    known: np.ndarray  # ridge scores, ascending
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        directions = rng.normal(size=(N_INPUTS, FOURIER)) * np.sqrt(1.0 / N_INPUTS)
        wave = np.cos(z @ directions + rng.uniform(0, 2 * np.pi, FOURIER)) * np.sqrt(2.0 / FOURIER)
        return np.hstack([wave, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.known, self.calibrated)


def summed(labelled: DataFrame, model: Model, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all labelled rows."""
    size = FOURIER + 1
    cast = labelled.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = cast.value.features(inputs(matrix(batch)))
                y = batch.column(batch.schema.get_field_index("quality")).to_numpy(zero_copy_only=False).astype(float)
                total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)])], names=["sums"])

    total = tree_sum(labelled.select("quality", *STATS).mapInArrow(lean(part), "sums binary"), np.float64, scratch)
    total = np.zeros((size, size + 1)) if total is None else total.reshape(size, size + 1)
    return total[:, :size], total[:, size]


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest ascending values, by pooling neighbours that descend."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def with_scores(stats: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    cast = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = inputs(matrix(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cast.value.raw(x) if raw else np.clip(cast.value.score(x), 0, 1))], names=[*batch.schema.names, "score"])

    return stats.mapInArrow(lean(run), T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def fit(labelled: DataFrame, scratch: Scratch) -> Model:
    """labelled: quality 0 or 1, the statistics, and calibrates, which rows calibrate."""
    blank = Model(np.zeros(N_INPUTS), np.ones(N_INPUTS), np.zeros(FOURIER + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    parts = {r["calibrates"]: r["count"] for r in labelled.groupBy("calibrates").count().collect()}
    teaching = labelled if len(parts) < 2 else labelled.where("not calibrates")
    calibrating = labelled if len(parts) < 2 else labelled.where("calibrates")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b = 0, np.zeros(N_INPUTS), np.zeros(N_INPUTS)
        for batch in batches:
            x = inputs(matrix(batch))
            n, a, b = n + len(x), a + x.sum(0), b + (x**2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (n, *a, *b)], names=names)

    names = ["n", *(f"a{k}" for k in range(N_INPUTS)), *(f"b{k}" for k in range(N_INPUTS))]
    row = teaching.select(*STATS).mapInArrow(lean(moments), ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c).alias(c) for c in names)).first()
    n = row["n"] or 0
    if not n:
        return blank
    mean = np.array([row[f"a{k}"] for k in range(N_INPUTS)]) / n
    std = np.sqrt(np.maximum(np.array([row[f"b{k}"] for k in range(N_INPUTS)]) / n - mean**2, 0))
    model = Model(mean, np.where(std > 1e-9, std, 1.0), blank.weights, blank.known, blank.calibrated)
    zz, zy = summed(teaching, model, scratch)
    penalty = RIDGE * np.eye(len(zz))
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(zz + penalty, zy)
    at = with_scores(calibrating.select("quality", *STATS), model, raw=True)
    bins = F.floor(F.least(F.greatest(F.col("score"), F.lit(-0.5)), F.lit(1.5)) * SCORE_BINS)
    known = sorted(at.groupBy(bins.alias("bin")).agg(F.avg("score").alias("mean"), F.avg("quality").alias("good"), F.count("*").alias("n")).collect(), key=lambda r: r["bin"])
    model.known = np.array([r["mean"] for r in known])
    model.calibrated = isotonic(np.array([r["good"] for r in known]), np.array([float(r["n"]) for r in known]))
    return model


def is_held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learned(stats: DataFrame, labels: DataFrame, id_col: str, scratch: Scratch) -> Model:
    """The model of rows (id, statistics) that have a label and aren't held out. labels: id, quality."""
    own = labels.where("quality is not null").groupBy(id_col).agg(F.min("quality").alias("quality"))
    calibrates = F.pmod(F.xxhash64(id_col), F.lit(CALIBRATION)) == 0
    labelled = scratch.table(stats.where(~is_held_out(id_col)).join(own, id_col).select("quality", *STATS, calibrates.alias("calibrates")), "labelled")
    return fit(labelled, scratch)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted and the statistics: a row for each row of docs. labels: id, quality."""
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.kept(with_stats(docs, id_col, text_col), "classifier-stats")
        model = learned(stats, labels, id_col, scratch)
    return with_scores(stats, model).withColumn("held_out", is_held_out(id_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted to have label 1, each by its own text: scored where they are read, so no text is shuffled."""
    with Scratch(docs.sparkSession) as scratch:
        model = learned(scratch.table(with_stats(docs, id_col, text_col), "classifier-stats"), labels, id_col, scratch)
    cast, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(at)):
                score = cast.value.score(inputs({k: v.astype(float) for k, v in text_stats(data, offsets).items()}))
                yield batch.slice(a, b - a).filter(pa.array(score >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
