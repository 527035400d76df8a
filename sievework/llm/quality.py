"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives FEATURES statistics; ratios are arcsine-square-root transformed, counts logarithmed, and all are drawn
to their training mean as far as the text is short (by RELIABLE words), since few words tell little. For each class the
moments of all labelled training rows give a mean and a covariance that is shrunk toward the pooled covariance and its
mean variance. The score is the logistic of the difference of the classes' log densities (Mahalanobis distance and log
determinant from Cholesky factors that are computed once) plus the log odds of the classes.

Defined cases: null, empty and wordless texts are scored as the mean text; null labels and ids are
not learned from; repeated label rows count each time; without rows of both classes every score is 0.5; ties (0.5)
predict 1; repeated rows are each returned; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .language_id import held_out
from .textvec import pieces, shingle_hashes, span_hashes, word_spans

SHRINK_POOLED, SHRINK_ROUND = 0.1, 0.02
RELIABLE = 25

_CLASS = np.zeros(256, np.uint8)  # 0 other
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?!'\"-"]] = 4
_CLASS[[ord(c) for c in "#$%&()*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[10] = 6
_CLASS[128:] = 7
FEATURES = 15


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of a piece."""
    n = len(off) - 1
    out = np.zeros((n, FEATURES))
    if not len(data):
        return out
    row = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(row * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    starts, ends, first = word_spans(data, off)
    words = span_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    lead = _CLASS[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    tail = _CLASS[data[ends - 1]] if len(starts) else lead
    turn = lambda a, b: np.arcsin(np.sqrt(np.clip(a / max(b, 1.0), 0, 1)))
    for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        k = e - s
        if not k:
            continue
        size, w, x = kinds[i], words[s:e], length[s:e]
        total = x.sum()
        _, count = np.unique(w, return_counts=True)
        runs = shingle_hashes(w, 3)
        out[i] = (
            np.log1p(k),
            np.log(x.mean()),
            np.log1p(x.std()),
            turn(size[2], size[1] + size[2]),
            turn(size[3], total),
            turn(size[4], total),
            turn(size[5], total),
            turn(size[7], total),
            np.log(len(count)) / np.log(k + 1),
            turn(count.max(), k),
            turn((x <= 3).sum(), k),
            turn((lead[s:e] == 2).sum(), k),
            turn(((tail[s:e] == 5) | (lead[s:e] == 5)).sum(), k),
            np.log1p(100 * size[6] / k),
            turn(len(runs) - len(np.unique(runs)), len(runs)),
        )
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(data, off) for _, _, data, off in pieces(batch.column(1))]
        x = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), vectors], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), FEATURES)


def drawn(x: np.ndarray, mean: np.ndarray | None) -> np.ndarray:
    """Statistics drawn to the mean, the more the fewer words; the first one is the logarithm of 1 + words."""
    if mean is None:
        return x
    words = np.expm1(x[:, :1])
    return mean + (x - mean) * (words / (words + RELIABLE))


def _moments(mean: np.ndarray | None) -> Callable:
    """For each class, the task's 1, x and x x' summed, as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 1))
        for batch in batches:
            x = np.c_[np.ones(batch.num_rows), drawn(_matrix(batch.column(1)), mean)]
            label = batch.column(0).to_numpy()
            for c in (0, 1):
                total[c] += x[label == c].T @ x[label == c]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64()))], ["label", "m"])

    return run


class Discriminant:
    """Means and Cholesky factors of two classes, from their summed moments (2, d + 1, d + 1) of drawn statistics."""

    def __init__(self, moments: np.ndarray, center: np.ndarray | None = None):
        self.center = center
        n = moments[:, 0, 0]
        self.fitted = bool((n > 0).all())
        if not self.fitted:
            return
        mean = moments[:, 0, 1:] / n[:, None]
        scatter = moments[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / n.sum()
        # statistics are brought to one scale before shrinking
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        pooled = pooled / np.outer(self.scale, self.scale)
        self.mean, self.inverse, self.log_det = mean / self.scale, [], []
        for c in (0, 1):
            own = scatter[c] / n[c] / np.outer(self.scale, self.scale)
            cov = (1 - SHRINK_POOLED - SHRINK_ROUND) * own + SHRINK_POOLED * pooled + SHRINK_ROUND * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
            factor = np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov)))
            self.inverse.append(np.linalg.inv(factor))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())
        self.log_odds = float(np.log(n[1] / n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        x = drawn(x, self.center)
        density = [-0.5 * ((((x / self.scale) - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """From all rows of vectors (doc_id, x) that are not held out and have a label."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = vectors.join(known, "doc_id").select("label", "x")

    def moments(mean: np.ndarray | None) -> np.ndarray:
        part = rows.mapInArrow(_moments(mean), "label int, m array<double>")
        sums = part.select("label", F.posexplode("m").alias("at", "m")).groupBy("label", "at").agg(F.sum("m").alias("m")).collect()  # 2 (d + 1)^2 rows
        out = np.zeros((2, (FEATURES + 1) ** 2))
        for row in sums:
            out[row.label, row.at] = row.m
        return out.reshape(2, FEATURES + 1, FEATURES + 1)

    total = moments(None).sum(0)[0]
    mean = total[1:] / max(total[0], 1.0)
    return Discriminant(moments(mean), mean)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    vectors = materialise(docs.select("doc_id", "text").mapInArrow(_statistics, f"doc_id {kind}, x array<double>"), "statistics")
    model = fit(vectors, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], ["doc_id", "score"])

    scored = vectors.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
