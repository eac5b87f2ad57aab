"""Operator 4, quality rules: base rules, then boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .base import materialize, table
from .stats import BASE, FEATURES, labelled_sample, statistics

#: Labelled documents that the trees are fitted on, about.
SAMPLE = 20_000
#: More of these never makes a document better.
MONOTONE = {FEATURES.index(f): -1 for f in ("symbol_share", "dup_line_share", "repeat_share", "bang_share", "bar_share", "upper_share", "lone_symbol_share", "control_share")}
THRESHOLD = 0.5


def fit_rules(stats: DataFrame, labels: DataFrame, where: str = "true", most: int = SAMPLE) -> boosting.Trees:
    x, y = labelled_sample(stats, labels, where, most)
    return boosting.fit(x, y, monotone=MONOTONE)


def score(stats: DataFrame, trees: boosting.Trees) -> DataFrame:
    """doc_id, the base counts and the trees' probability of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", *BASE)), pa.array(trees.probability(x))], ["doc_id", *BASE, "probability"])

    return stats.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, probability double")


def quality_rules(docs: DataFrame, labels: DataFrame, *, where: str = "true", threshold: float = THRESHOLD, name: str = "rules") -> DataFrame:
    """doc_id, base counts, base_failed, probability, kept of every row of `docs` (doc_id, text); the trees learn from `labels` (doc_id, quality).

    A null or empty text has no words, so it fails the base rules. Without labels of both kinds the trees are a constant that
    keeps. Repeated rows are judged alike; empty tables give no rows; other columns are ignored.
    """
    stats = materialize(statistics(docs), f"{name}-stats")
    found = score(stats, fit_rules(stats, labels, where))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents whose crc32 leaves 2 stay unseen, so that accuracy can be measured on them
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where="crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
