"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a shrunken covariance of transformed statistics of the whole text.  A
score compares the two log densities (Mahalanobis distance and log determinant from the Cholesky
factor, which is computed once) and the class shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.backoff_automaton import fold
from trendloom.llm.common import small, tidy, utf8

FOLDS = 5
HELD = 0
CUT = 0.3
SHRINKAGE = 0.1
RIDGE = 1e-3

_UPPER = np.arange(ord("A"), ord("Z") + 1)
_LOWER = np.arange(ord("a"), ord("z") + 1)
_DIGIT = np.arange(ord("0"), ord("9") + 1)
_SPACE = np.array([32, *range(9, 14)])
_STOP = np.frombuffer(b".,;:!?", np.uint8)
_MARK = np.setdiff1d(np.arange(33, 127), np.concatenate((_UPPER, _LOWER, _DIGIT, _STOP)))
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "stop", "exclaim", "mark", "space", "high", "distinct_words",
    "distinct_lines", "line_length", "byte_entropy", "control",
)


def _logit(part: float, whole: float) -> float:
    p = (part + 0.5) / (whole + 1.0)
    return float(np.log(p / (1.0 - p)))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text (UTF-8); defined for the empty text too."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    solid = n - int(counts[_SPACE].sum())
    p = counts[counts > 0] / max(n, 1)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(solid / max(len(words), 1))),
        _logit(counts[_UPPER].sum(), solid), _logit(counts[_DIGIT].sum(), solid), _logit(counts[_STOP].sum(), solid),
        _logit(counts[33], solid), _logit(counts[_MARK].sum(), solid), _logit(counts[_SPACE].sum(), n),
        _logit(counts[128:].sum(), solid), _logit(len(set(words)), len(words)), _logit(len(set(lines)), len(lines)),
        float(np.log1p(n / max(len(lines), 1))), float(-(p * np.log2(p)).sum()), _logit(counts[:9].sum() + counts[14:32].sum(), n),
    ]


def _features(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


@dataclass
class Discriminant:
    """Log share, mean, inverse Cholesky factor and half log determinant of both classes."""

    shares: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            logs.append(self.shares[k] - self.logdets[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def from_moments(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float, ridge: float) -> Discriminant:
    """Class models from counts, sums and sums of products.

    A covariance is drawn towards the pooled one and its diagonal; with few rows of a class the
    pooled one carries it, and a class without rows is never preferred.
    """
    p = sums.shape[1]
    total = max(n.sum(), 1.0)
    means = sums / np.maximum(n, 1.0)[:, None]
    scatter = squares - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / total
    spread = np.diag(np.diag(pooled)) + ridge * np.eye(p)
    factors, logdets = np.zeros((2, p, p)), np.zeros(2)
    for k in (0, 1):
        weight = n[k] / (n[k] + 10.0 * p)
        own = weight * scatter[k] / max(n[k], 1.0) + (1 - weight) * pooled
        lower = np.linalg.cholesky((1 - shrinkage) * own + shrinkage * spread + ridge * np.eye(p))
        factors[k], logdets[k] = np.linalg.inv(lower), np.log(np.diag(lower)).sum()
    return Discriminant(np.log((n + 0.5) / (total + 1.0)), means, factors, logdets)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """Learn from every labelled row whose crc32(key as text) modulo 5 is not 0.

    Moments are summed per batch, then by Spark: the driver gets one small matrix per class.
    Labels other than 0 and 1, and rows without a key or label, are not used.
    """
    size = len(FEATURES)
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def features(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches):
            x = _features(utf8(batch.column(1)))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "x"])

    @tidy
    def moments(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            train = np.array([fold(k, FOLDS) != HELD for k in batch.column("id").to_pylist()], bool)
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, size)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                rows = x[train & (y == k)]
                flat = np.concatenate(([len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                    names=["y", "at", "value"],
                )

    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.col(label).cast("int").alias("y")
    )
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(features, f"id {kind}, x array<double>")
    # the same join at every size: behind a broadcast both functions would run in one task, with a worker each
    found = rows.join(known.hint("merge"), "id").select("id", "x", "y").mapInArrow(moments, "y int, at int, value double")
    flat = np.zeros((2, 1 + size + size * size))
    for y, at, value in found.groupBy("y", "at").agg(F.sum("value")).collect():  # a fixed number of rows
        flat[y, at] = value
    return from_moments(
        flat[:, 0], flat[:, 1:1 + size], flat[:, 1 + size:].reshape(2, size, size), shrinkage, ridge
    )


def score_quality(docs: DataFrame, model: Discriminant, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1.  Null texts count as empty; no other column is read."""
    if score in docs.columns:
        raise ValueError(f"the input has a column named {score}")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches):
            found = pa.array(model.score(_features(utf8(batch.column(text)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields]).add(score, T.DoubleType()))


def keep_good(docs: DataFrame, model: Discriminant, text: str = "text", cut: float = CUT) -> DataFrame:
    """Rows whose score reaches ``cut``, as they are."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches):
            yield batch.filter(pa.array(model.score(_features(utf8(batch.column(text)))) >= cut))

    return docs.mapInArrow(run, docs.schema)
