"""Quality classifier by positive-unlabelled learning.

A small network scores the form of a text: its byte frequencies, word statistics and repetition. It is fitted on a
bounded sample by minimising the non-negative unbiased risk from trusted positives, unlabelled web text and a class
prior; the few trusted negatives only serve to estimate that prior and to calibrate the score. All documents are then
scored in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import RollingHash, table, text_bytes
from gridloom.llm.repetition import measure
from gridloom.plans.registry import query

#: Rows of the fitting sample on average: the documented bound on what is collected.
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 256, 3e-3, 1e-4
N_FEATURES = 128 + 10


def features(text: np.ndarray, hashes: RollingHash) -> np.ndarray:
    """Fixed-length description of a text given as UTF-8 bytes; zeros for an empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    n = len(text)
    if not n:
        return out
    out[:128] = np.sqrt(np.bincount(text, minlength=256)[:128] / n)
    n_words, word_chars, symbols, dup_lines, repeat, _, _, d5, d7, d10, dup_chars = measure(text, hashes)
    lines = int((text == 10).sum()) + 1
    words, chars = max(1, n_words), max(1, word_chars)
    out[128:] = (np.log1p(n_words), word_chars / words / 10, (text > 127).mean(), symbols / words, dup_lines / lines,
                 repeat / words, d5 / chars, d10 / chars, dup_chars / chars, np.log1p(n_words / lines))
    return out


def _rows_of(column: pa.Array, hashes: RollingHash) -> np.ndarray:
    data, at = text_bytes(column)
    rows = [features(data[a:b], hashes) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return np.array(rows, np.float32).reshape(len(rows), N_FEATURES)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class PuNetwork:
    """One hidden layer, fitted by the non-negative risk estimator with the sigmoid loss; ``score`` is calibrated."""

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> "PuNetwork":
        rng = np.random.default_rng(13)
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 0.02
        d = both.shape[1]
        self.w = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.slope, self.offset = 1.0, 0.0
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(unlabelled))
            for at in range(0, len(order), BATCH):
                u = self._scaled(unlabelled[order[at:at + BATCH]])
                p = self._scaled(positive[rng.integers(0, len(positive), min(BATCH, len(positive)))])
                z, hidden = self._forward(np.concatenate([p, u]))
                zp, zu = z[:len(p)], z[len(p):]
                # Sigmoid loss: the loss of calling z positive is s(-z), of calling it negative s(z).
                dp, du = _sigmoid(zp) * (1 - _sigmoid(zp)), _sigmoid(zu) * (1 - _sigmoid(zu))
                negative = _sigmoid(zu).mean() - prior * _sigmoid(zp).mean()
                as_negative = np.concatenate([-prior * dp / len(p), du / len(u)])
                if negative >= 0:
                    slope = as_negative + np.concatenate([-prior * dp / len(p), np.zeros(len(u))])
                else:
                    slope = -as_negative  # the estimate has gone below zero: step back
                step += 1
                for i, g in enumerate(self._gradients(np.concatenate([p, u]), hidden, slope)):
                    g = g + DECAY * self.w[i]
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "PuNetwork":
        """Fits slope and offset of the log odds on rows with both labels, by Newton steps with a slight prior."""
        z = self._forward(self._scaled(x))[0]
        t = np.array([1.0, 0.0])
        design = np.stack([z, np.ones(len(z))], axis=1)
        for _ in range(30):
            p = _sigmoid(design @ t)
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + 0.01 * np.eye(2)
            t = t - np.linalg.solve(hessian, design.T @ (p - y) + 0.01 * (t - [1, 0]))
        if np.isfinite(t).all() and t[0] > 0:
            self.slope, self.offset = float(t[0]), float(t[1])
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.w[0] + self.w[1], 0)
        return hidden @ self.w[2] + self.w[3][0], hidden

    def _gradients(self, x, hidden, slope):
        back = slope[:, None] * self.w[2] * (hidden > 0)
        return x.T @ back, back.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self._forward(self._scaled(x))[0] + self.offset)


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> PuNetwork | None:
    """A network from about SAMPLE of the rows of ``docs`` where ``learnable`` holds; None without trusted positives.

    Of several labels of an id the largest counts; null labels are none. Labels of other rows are not read.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    rows = docs.where(learnable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, SAMPLE / max(1, rows.count()))
    place = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash()
        for batch in batches:
            x = _rows_of(batch.column(1), hashes)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], ["id", "x", "y"])

    sample = rows.where(place < int(share * (1 << 30))).join(known, F.col("id") == F.col("k"), "left").select("id", "text", "y")
    found = sorted(((r.id, r.y, r.x) for r in sample.mapInArrow(run, "id long, x array<float>, y int").collect()),
                   key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0))
    x = np.array([r[2] for r in found], np.float64).reshape(-1, N_FEATURES)
    y = np.array([-1 if r[1] is None else r[1] for r in found])
    positive, trusted = x[y == 1], y >= 0
    unlabelled = x[~trusted] if (~trusted).any() else x
    if not len(positive):
        return None
    prior = float(np.clip((y == 1).sum() / max(1, trusted.sum()), 0.05, 0.95))  # among rows chosen for labelling
    return PuNetwork().fit(positive, unlabelled, prior).calibrate(x[trusted], (y[trusted] == 1).astype(float))


def quality_scores(docs: DataFrame, network: PuNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: null and empty texts are scored as empty; without a network every score is 0.5.

    Ids may be null or repeat; other columns are not read; no rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = RollingHash()
        for batch in batches:
            score = network.score(_rows_of(batch.column(1), hashes)) if network is not None else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, score double")


@query("op2_pu_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def held_out(c: str) -> Column:
        return F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))

    network = fit_quality(docs, labels.where(~held_out("doc_id")), ~held_out("doc_id"))
    scored = quality_scores(docs, network).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
