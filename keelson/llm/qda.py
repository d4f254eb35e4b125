"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of a text (shares of symbols, capitals, repeats and so on) are
transformed to be closer to normal. Per class, mean and covariance are exact
sums over all labelled training rows; the covariance is shrunk towards the
pooled one and then towards a multiple of the identity, and its Cholesky factor
is computed once and cached. The score is the logistic of the difference of the
log densities, which are Mahalanobis distances plus log determinants.

Defined results: null and empty texts have all-zero statistics and get a score
like any other text. With no training row, all scores are 0.5; with one class
only, that class's share of the prior decides. A training id with several
labels counts once for each labelled row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common as C

FEATURES = ("symbols", "capitals", "digits", "bangs", "stops", "repeats", "dup_lines", "distinct", "word_length", "length")
D = len(FEATURES)


@dataclass(frozen=True)
class QdaParams:
    """Shrinkage towards the pooled covariance, then towards its mean variance."""

    to_pooled: float = 0.9
    to_identity: float = 0.05
    temperature: float = 4.0
    threshold: float = 0.5


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n x D transformed statistics, clipped to a fixed range.

    Shares have a fixed number of neutral words or characters in their
    denominators, so that they mean little in texts of a few words.
    """
    s = {k: v.astype(float) for k, v in C.text_stats(buf, offs).items()}
    words, chars = s["n_words"] + 20, s["n_chars"] + 60
    letters = s["n_upper"] + s["n_lower"] + 60

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.sqrt(np.clip(x / of, 0, 1))

    return np.column_stack(
        [
            share(s["n_symbols"], chars),
            share(s["n_upper"] + 1, letters),
            share(s["n_digits"], chars),
            share(s["n_bangs"], words),
            share(s["n_stops"] + 1.5, chars),
            share(s["n_repeat_words"], words),
            share(s["n_dup_lines"], s["n_lines"] + 4),
            share(s["n_distinct_words"] + 16, words),
            np.clip(np.log1p((s["word_chars"] + 100) / words), 0, 6) / 2,
            np.clip(np.log1p(words), 0, 14) / 5,
        ]
    )


@dataclass(frozen=True)
class QdaModel:
    """Prior log odds and, by class, mean, inverse Cholesky factor and log determinant."""

    log_odds: float
    classes: tuple | None
    params: QdaParams

    def score(self, x: np.ndarray) -> np.ndarray:
        diff = np.full(len(x), self.log_odds)
        if self.classes:
            dens = []
            for mean, inverse, log_det in self.classes:
                z = (x - mean) @ inverse.T
                dens.append(-0.5 * (z * z).sum(1) - 0.5 * log_det)
            diff = diff + dens[1] - dens[0]
        return 1 / (1 + np.exp(-np.clip(diff / self.params.temperature, -500, 500)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], p: QdaParams) -> QdaModel:
    """From count, sum and second moments of each class (0 and 1)."""
    n0, n1 = (sums.get(k, (0,))[0] for k in (0, 1))
    odds = float(np.log((n1 + 1) / (n0 + 1))) if n0 + n1 else 0.0
    if not n0 or not n1:
        return QdaModel(odds * p.temperature, None, p)
    means, covs = [], []
    for k in (0, 1):
        n, s, q = sums[k]
        means.append(s / n)
        covs.append(q / n - np.outer(s / n, s / n))
    pooled = (n0 * covs[0] + n1 * covs[1]) / (n0 + n1)
    classes = []
    for mean, cov in zip(means, covs, strict=True):
        cov = (1 - p.to_pooled) * cov + p.to_pooled * pooled
        cov = (1 - p.to_identity) * cov + p.to_identity * max(1e-6, np.trace(cov) / D) * np.eye(D)
        factor = np.linalg.cholesky(cov)
        classes.append((mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return QdaModel(odds, tuple(classes), p)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(documents: DataFrame, labels: DataFrame, p: QdaParams = QdaParams(), label: str = "quality") -> QdaModel:
    """Fit on every labelled row outside the held-out third.

    Tasks send one row of D * D + D + 1 sums a class, so the driver gets a few
    kilobytes a task; the labels are broadcast only if they are counted to be few.
    """
    docs = C.texts(documents)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where("label in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, 1 + D + D * D))
        for batch, buf, offs in C.slices(batches):
            y = np.asarray(batch.column(2))
            x = features(buf, offs)
            for k in (0, 1):
                part = x[y == k]
                got[k] += np.concatenate(([len(part)], part.sum(0), (part.T @ part).ravel()))
        yield pa.record_batch([pa.array(np.repeat([0, 1], got.shape[1]), pa.int32()), pa.array(np.tile(np.arange(got.shape[1]), 2), pa.int32()), pa.array(got.ravel())], names=["label", "slot", "total"])

    rows = docs.join(C.checked_broadcast(marks), "doc_id").mapInArrow(moments, "label int, slot int, total double").groupBy("label", "slot").agg(F.sum("total").alias("total"))
    got = np.zeros((2, 1 + D + D * D))
    for k, slot, total in rows.collect():  # 2 * (1 + D + D * D) rows at most
        got[k, slot] = total
    # sums of doubles depend on the order of tasks in their last digits only
    got = np.round(got, 6)
    return fit({k: (g[0], g[1 : 1 + D], g[1 + D :].reshape(D, D)) for k, g in enumerate(got)}, p)


def classify(documents: DataFrame, model: QdaModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in C.slices(batches):
            score = np.round(model.score(features(buf, offs)), 9)
            ids = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([held_out(i) if i is not None else False for i in ids]), pa.array(score), pa.array((score >= model.params.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return C.texts(documents).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: QdaModel) -> DataFrame:
    """The rows of ``documents`` that the model accepts, with all their columns; no shuffle."""
    docs, others = C.with_others(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in C.slices(batches):
            yield batch.filter(pa.array(np.round(model.score(features(buf, offs)), 9) >= model.params.threshold))

    kept = docs.mapInArrow(run, docs.schema)
    names = {"doc_id": "doc_id", "text": "text"} | {f.name: f"other_{i}" for i, f in enumerate(others)}
    return kept.select(*(F.col(names[c]).alias(c) for c in documents.columns))
