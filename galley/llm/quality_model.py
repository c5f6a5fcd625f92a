"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Random cosines approximate a Gaussian kernel over standardised statistics.  Each partition sums its part of the normal
equations, sums are added in rounds of bounded fan-in, and the driver solves a system of fixed size.  Scores of each half of the training
rows by the other half's weights, counted in fixed bins, are calibrated by pooling adjacent violators.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize, tree_sum
from .docstats import NAMES, with_stats

FEATURES, BINS = 192, 1024
LOW, HIGH = -0.5, 1.5


def describe(counts: np.ndarray) -> np.ndarray:
    """Statistics of documents, from a row of counts (``NAMES``) each."""
    c = dict(zip(NAMES, counts.astype(np.float64).T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    mean = chars / words
    share = lambda a, b: np.sqrt(np.minimum(a / b, 4))
    return np.stack([
        np.log1p(c["n_words"]), mean.clip(0, 30), np.sqrt(np.maximum(c["sum_squares"] / words - mean**2, 0)).clip(0, 30), share(c["n_symbols"], words), share(c["n_dup_lines"], lines), share(c["n_distinct"], words),
        share(c["n_repeat_words"], words), share(c["n_upper"], chars), share(c["n_digits"], chars), share(c["n_marks"], words), share(c["n_stops"], words), np.log1p(c["longest"]), share(c["most_frequent"], words), np.log1p(words / lines), share(c["n_wide"], chars),
    ], axis=1)


class Model:
    """A fitted classifier; small, whatever it was fitted on."""

    def __init__(self, mean, scale, weights, phase, ridge, knots):
        self.mean, self.scale, self.weights, self.phase, self.ridge, self.knots = mean, scale, weights, phase, ridge, knots

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        x = (describe(counts) - self.mean) / self.scale
        z = np.cos(x.clip(-6, 6) @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, counts: np.ndarray, fold: int = 2) -> np.ndarray:
        return self.cosines(counts) @ self.ridge[fold]

    def score(self, counts: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(counts), *self.knots).clip(0, 1)


def isotonic(low_to_high: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(centres, means) of the blocks that pooling adjacent violators leaves of (centre, rows, sum of labels)."""
    blocks: list[list[float]] = []
    for at, n, s in low_to_high:
        blocks.append([at * n, n, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([a / n for a, n, _ in blocks]), np.array([s / n for _, n, s in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    at = batch.schema.get_field_index
    return np.stack([batch.column(at(n)).to_numpy(zero_copy_only=False) for n in NAMES], axis=1)


def fit(train: DataFrame, seed: int = 5, penalty: float = 1e-3) -> Model:
    """From rows of counts, ``quality`` (0 or 1) and ``fold`` (0 or 1); all rows are used.

    Without rows the model scores 0.5.
    """
    d, rng = describe(np.zeros((1, len(NAMES)))).shape[1], np.random.default_rng(seed)
    weights, phase = rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
    sums = tree_sum(train, lambda b: [(x := describe(_matrix(b))).sum(0), (x * x).sum(0), np.array([float(len(x))])])
    blank = Model(np.zeros(d), np.ones(d), weights, phase, [np.zeros(FEATURES + 1)] * 3, (np.zeros(1), np.full(1, 0.5)))
    if not sums:
        return blank
    mean = sums[0] / sums[2]
    blank.mean, blank.scale = mean, np.sqrt(np.maximum(sums[1] / sums[2] - mean**2, 1e-6))

    def equations(b: pa.RecordBatch) -> list[np.ndarray]:
        z, y, fold = blank.cosines(_matrix(b)), b.column(b.schema.get_field_index("quality")).to_numpy().astype(float), b.column(b.schema.get_field_index("fold")).to_numpy()
        return [a for f in (0, 1) for a in ((z[fold == f].T @ z[fold == f]).ravel(), z[fold == f].T @ y[fold == f])]

    a0, b0, a1, b1 = tree_sum(train, equations)
    size = FEATURES + 1

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a.reshape(size, size)
        return np.linalg.solve(a + (penalty * max(a[-1, -1], 1) + 1e-6) * np.diag([*[1.0] * FEATURES, 1e-6]), b)

    model = Model(blank.mean, blank.scale, weights, phase, [solve(a1, b1), solve(a0, b0), solve(a0 + a1, b0 + b1)], blank.knots)

    def bins(b: pa.RecordBatch) -> list[np.ndarray]:
        x, y, fold = _matrix(b), b.column(b.schema.get_field_index("quality")).to_numpy().astype(float), b.column(b.schema.get_field_index("fold")).to_numpy()
        at = (((np.where(fold == 0, model.raw(x, 0), model.raw(x, 1)) - LOW) / (HIGH - LOW)).clip(0, 1) * (BINS - 1)).round().astype(int)
        return [np.bincount(at, minlength=BINS).astype(float), np.bincount(at, y, BINS)]

    n, s = tree_sum(train, bins)
    found = [(LOW + (HIGH - LOW) * i / (BINS - 1), n[i], s[i]) for i in np.flatnonzero(n)]
    model.knots = isotonic(found)
    return model


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and labels of the labelled rows that aren't held out: crc32 of the identifier as text, mod 3, is not 1."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("long").alias("quality")).where("quality in (0, 1)")
    chosen = known.where(F.crc32(F.col("__id").cast("string")) % 3 != 1)
    return stats.join(chosen, stats["doc_id"] == chosen["__id"]).select(*NAMES, "quality", (F.crc32(F.concat(F.lit("fold"), F.col("__id").cast("string"))) % 2).cast("long").alias("fold"))


def score(stats: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    source = stats.select(*keep, *NAMES)
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*source.schema.fields[: len(keep)]]).add("score", DoubleType())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(_matrix(batch)) if batch.num_rows else [], pa.float64())], names=[*keep, "score"])

    ship(stats.sparkSession)
    return source.mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Only texts are inputs of a score; null and empty texts have one too.  Labels that are null or neither 0 nor 1 are
    left out, and repeated ones count each.  Without usable labels all scores are 0.5.  A null identifier is not held
    out.  Rows keep their number; an empty table gives no row; the columns ``carry`` follow as they are, others are ignored.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("text"))
    stats = materialize(with_stats(source, ("doc_id", *carry)), "stats")
    model = fit(materialize(training_rows(stats, labels), "train"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(stats, model, ("doc_id", *carry)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry)
