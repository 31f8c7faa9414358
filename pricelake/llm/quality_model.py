"""Quality classifier: a regularised quadratic discriminant.

A document is a vector of transformed surface statistics. Each class has a mean and a covariance, shrunk towards its
diagonal and towards the pooled variances; its Cholesky factor is computed once. The score is the chance of class 1
that the difference of the two log densities (Mahalanobis distances and log determinants) gives.

The moments are sums that Spark adds up per class over all labelled rows that are not held out; the driver sees two
rows. Null texts count as empty, and get a score too; null or other labels are ignored; a document labelled twice
counts twice; repeated rows are scored each by itself; without both classes, the score is the share of class 1 (0.5
without any label); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, require, text_hash, trimmed
from .statistics import Surface, surfaces

#: Rates are taken over so many words more than a text has, so that a short text doesn't look extreme by one word.
_MORE_WORDS = 20
FEATURES = {
    "symbols": lambda s: math.log1p(20 * s.n_symbols / (s.n_words + _MORE_WORDS)),
    "upper": lambda s: math.log1p(10 * max(0, s.n_upper - s.n_lines) / (s.n_upper + s.n_lower + 5 * _MORE_WORDS)),
    "marks": lambda s: math.log1p(20 * s.n_marks / (s.n_words + _MORE_WORDS)),
    "same_next": lambda s: math.log1p(20 * s.n_same_next / (s.n_words + _MORE_WORDS)),
}


def features(s: Surface) -> list[float]:
    return [f(s) for f in FEATURES.values()]


@dataclass
class Discriminant:
    """Two Gaussians with cached Cholesky factors, and the log odds of the classes."""

    means: np.ndarray
    factors: list[np.ndarray]
    log_dets: list[float]
    log_odds: float

    @staticmethod
    def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.3, floor: float = 0.2) -> Discriminant:
        """``moments``: by class n, sum of x, sum of x x^T. ``shrink``: weight of the diagonal; ``floor``: of the pooled
        variances, so that a statistic that is constant in one class still has a width there."""
        means, covs = [], []
        for n, s, ss in (moments[0], moments[1]):
            mean = s / n
            means.append(mean)
            covs.append(ss / n - np.outer(mean, mean))
        n0, n1 = moments[0][0], moments[1][0]
        pooled = np.diag((n0 * np.diag(covs[0]) + n1 * np.diag(covs[1])) / (n0 + n1) + 1e-6)
        shrunk = [(1 - floor) * ((1 - shrink) * c + shrink * np.diag(np.diag(c))) + floor * pooled for c in covs]
        factors = [np.linalg.cholesky(c) for c in shrunk]
        return Discriminant(np.array(means), factors, [2 * float(np.log(np.diag(f)).sum()) for f in factors], math.log(n1 / n0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * ((z * z).sum(axis=0) + log_det))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.log_odds, -50, 50)))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the vector x of every document."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(s) for s in surfaces(batch.column(1))], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def held_out():
    """crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(text_hash("doc_id") % 4 == 2, F.lit(False))


def fit(x: DataFrame, labels: DataFrame) -> Discriminant | float:
    """From labelled rows that are not held out; a plain share if a class has no rows."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    p = len(FEATURES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(p)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    found = x.where(~held_out()).join(known, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *sums, *products).collect()
    moments = {}
    for r in found:
        ss = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                ss[i, j] = ss[j, i] = r[f"p{i}_{j}"]
        moments[r["quality"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(p)]), ss)
    if set(moments) == {0, 1}:
        return Discriminant.fit(moments)
    total = sum(m[0] for m in moments.values())
    return moments.get(1, (0.0,))[0] / total if total else 0.5


def _scored(model: Discriminant | float, x: np.ndarray) -> np.ndarray:
    return model.scores(x) if isinstance(model, Discriminant) else np.full(len(x), model)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    x = materialise(vectors(docs), "vectors")
    model = fit(x, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scored(model, np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = x.mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model = fit(materialise(vectors(docs), "vectors"), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(s) for s in surfaces(batch.column(batch.schema.get_field_index("text")))], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(_scored(model, x) >= threshold, pa.bool_())).select(names)

    return docs.mapInArrow(trimmed(run), docs.schema)
