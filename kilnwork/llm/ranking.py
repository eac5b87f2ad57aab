"""Operator 9, quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in hinge features of its statistics. It is learned from preference pairs (a good document
against a bad one) by logistic loss on the difference of their features. The threshold is the quantile of the training scores
at the share of bad documents; a logistic curve through 0.7 at that threshold gives scores between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Hashes, bounded_sample, crc_text, materialize, returning, table
from .stats import FEATURES, describe, labelled_sample, statistics

#: Labelled documents, about, and preference pairs that the ranking is learned from.
SAMPLE, PAIRS = 20_000, 100_000
CUT = 0.7


@dataclass(frozen=True)
class Ranking:
    knots: np.ndarray  # features x hinges
    scale: np.ndarray  # features
    weights: np.ndarray
    slope: float
    threshold: float

    def hinges(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(0, (x[:, :, None] - self.knots[None]) / self.scale[None, :, None]).clip(max=20).reshape(len(x), -1), (x - self.knots[:, 0]) / self.scale], 1).clip(-20, 20)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.hinges(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT exactly at the threshold."""
        return 1 / (1 + np.exp(-(self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT)))))


def fit_ranking(x: np.ndarray, y: np.ndarray, *, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 42) -> Ranking:
    """Newton's method on the pairs' logistic loss. Without both labels every document scores above the cut."""
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        return Ranking(np.zeros((width, 1)), np.ones(width), np.zeros(2 * width), 1.0, -1.0)
    knots = np.quantile(x, [0.1, 0.5, 0.8, 0.95], axis=0).T
    scale = np.maximum(x.std(0), 1e-4)
    model = Ranking(knots, scale, np.zeros(0), 1.0, 0.0)
    z = model.hinges(x)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    d = z[i] - z[j]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-(d @ w)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        size = np.abs(step).max()
        w += step * min(1.0, 5.0 / max(size, 1e-9))
        if size < 1e-4:
            break
    s = z @ w
    threshold = float(np.quantile(s, (y == 0).mean()))
    slope, t = 1.0, s - threshold
    for _ in range(25):  # one slope, by Newton's method, the curve held at CUT
        p = 1 / (1 + np.exp(-(slope * t + np.log(CUT / (1 - CUT)))))
        slope += float(np.clip((t * (y - p)).sum() / max((t * t * p * (1 - p)).sum(), 1e-9), -0.5, 0.5))
        slope = min(max(slope, 0.02), 5.0)
    return Ranking(knots, scale, w, slope, threshold)


def rank_documents(docs: DataFrame, labels: DataFrame, *, where: str = "true", sample: int = SAMPLE, name: str = "rank") -> DataFrame:
    """doc_id, score, predicted of every row of `docs` (doc_id, text); learned from `labels` (doc_id, quality) where `where` holds.

    Null and empty texts are scored as texts without words. Repeated rows score alike; empty tables give no rows; other
    columns are ignored.
    """
    stats = materialize(statistics(docs), f"{name}-stats")
    return scored(stats, fit_ranking(*labelled_sample(stats, labels, where, sample)))


def scored(stats: DataFrame, model: Ranking) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                x = c.column("features").flatten().to_numpy(zero_copy_only=False).reshape(c.num_rows, len(FEATURES))
                s = model.score(x)
                yield pa.record_batch([c.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.select("doc_id", "features").mapInArrow(run, "doc_id long, score double, predicted int")


LEARN = "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=LEARN)
    return found.select("doc_id", (crc_text("doc_id") % 4 == 2).alias("held_out"), "score", "predicted")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, all columns. They are scored where they lie, without a shuffle.

    Null and empty texts are judged as texts without words, repeated rows alike; without labels of both kinds all stay; an
    empty table stays empty."""
    drawn = sample_texts(docs, table(spark, sf_dir, "labels"), LEARN, SAMPLE)
    return accepted(docs, fit_ranking(*labelled_sample(statistics(drawn), drawn.select("doc_id", F.col("y").alias("quality")), "true", SAMPLE)))


def sample_texts(docs: DataFrame, labels: DataFrame, where: str, most: int) -> DataFrame:
    """doc_id, text, y of the documents of about `most` labels, those of least hash; the ids are few enough to broadcast."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(where).groupBy("doc_id").agg(F.min("quality").alias("y"))
    ids = bounded_sample(known, "doc_id", most)
    return materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "rank-stage-sample")


def accepted(docs: DataFrame, model: Ranking) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for b in returning(batches):
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                x = np.array([describe(t, memo)[1] for t in c.column(names.index("text")).to_pylist()])
                yield c.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)
