"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Two multinomials over hashed byte n-grams are counted, one over the trusted
documents and one over all documents. A document's score is the mean log ratio
of its n-grams, so it does not depend on its length, and the verdict is a fixed
comparison with ``threshold``: equal inputs always get equal verdicts.

Defined results: a null text is an empty one; a text with no n-gram scores 0;
with no trusted document the two distributions coincide and all scores are 0.
Rows repeated in the input are counted and returned as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common as C


@dataclass(frozen=True)
class LlrParams:
    """``buckets`` bounds the model: two counts a bucket, whatever the corpus."""

    n: int = 4
    buckets: int = 1 << 16
    smoothing: float = 1.0
    threshold: float = -0.15
    min_words: int = 50
    max_repeat_percent: int = 50


def gram_buckets(buf: np.ndarray, offs: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of each n-gram start, and which starts lie in one document."""
    if len(buf) < n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    m = len(buf) - n + 1
    h = buf[:m].astype(np.uint32)
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h ^= buf[k : k + m]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    ok = np.ones(m, bool)
    for end in offs[1:]:
        ok[max(0, end - n + 1) : end] = False
    return ((h.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64), ok


def count_grams(docs: DataFrame, p: LlrParams) -> np.ndarray:
    """2 x buckets counts (target, raw) of docs (doc_id, text, trusted).

    Tasks pre-aggregate, one row a bucket and task is shuffled, and the result
    that reaches the driver has at most ``buckets`` rows.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, p.buckets), np.int64)
        for batch, buf, offs in C.slices(batches):
            g, ok = gram_buckets(buf, offs, p.n, p.buckets)
            got[1] += np.bincount(g[ok], minlength=p.buckets)
            trusted = np.repeat(np.asarray(batch.column(2).fill_null(False)), np.diff(offs))[: len(g)]
            got[0] += np.bincount(g[ok & trusted], minlength=p.buckets)
        some = np.flatnonzero(got[1])
        yield pa.record_batch([pa.array(some), pa.array(got[0][some]), pa.array(got[1][some])], names=["bucket", "target", "raw"])

    rows = docs.mapInArrow(tally, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw"))
    out = np.zeros((2, p.buckets), np.int64)
    for bucket, target, raw in rows.collect():  # bounded by p.buckets
        out[:, bucket] = target, raw
    return out


def log_ratio(counts: np.ndarray, p: LlrParams) -> np.ndarray:
    target, raw = counts.astype(float)
    if not target.sum():
        return np.zeros(p.buckets, np.float64)
    # the prior is the raw distribution, so unseen buckets give a ratio of one
    prior = (raw + 1) / (raw + 1).sum()
    strength = p.smoothing * p.buckets
    target = (target + strength * prior) / (target.sum() + strength)
    return np.log(target / prior)


def score_rules(docs: DataFrame, ratio: np.ndarray, p: LlrParams) -> DataFrame:
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, llr double"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in C.slices(batches):
            s = C.text_stats(buf, offs)
            g, ok = gram_buckets(buf, offs, p.n, p.buckets)
            total = np.zeros(len(buf) + 1)
            np.cumsum(np.where(ok, ratio[g], 0.0), out=total[1 : len(g) + 1])
            total[len(g) + 1 :] = total[len(g)]
            grams = np.maximum(0, np.diff(offs) - p.n + 1)
            llr = np.round((total[offs[1:]] - total[offs[:-1]]) / np.maximum(1, grams), 9)
            failed = (s["n_words"] < p.min_words) | (100 * s["n_repeat_words"] > p.max_repeat_percent * s["n_words"])
            yield pa.record_batch(
                [batch.column(0), *(C.long_column(s[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & (llr >= p.threshold)), pa.array(llr)],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(score, schema)


def quality_rules(documents: DataFrame, trusted_ids: DataFrame, p: LlrParams = LlrParams()) -> DataFrame:
    """Base counts, log-likelihood ratio and verdict of every document.

    ``trusted_ids`` (doc_id) names the trusted documents; it is broadcast only
    when its counted rows allow that, and then both distributions are counted in
    one pass. Otherwise the raw one is counted without a join, and the target one
    over the trusted documents alone, so that no other text is joined.
    """
    docs = C.texts(documents)
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    if ids.count() <= C.BROADCAST_ROWS:
        counts = count_grams(docs.join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "doc_id", "left"), p)
    else:
        counts = count_grams(docs.withColumn("trusted", F.lit(False)), p)
        counts[0] = count_grams(docs.join(ids, "doc_id").withColumn("trusted", F.lit(True)), p)[0]
    return score_rules(docs, log_ratio(counts, p), p)
