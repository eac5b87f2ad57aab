"""From raw documents to packed training sequences: five stages, each written as Parquet and read back for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilnwork.llm.base import materialize
from kilnwork.llm.mixing import mix_stage
from kilnwork.llm.packing import pack_stage
from kilnwork.llm.pii import pii_stage
from kilnwork.llm.ranking import classifier_stage
from kilnwork.llm.simhash import near_dup_stage

#: (name, function of (spark, docs, sf_dir)), in the order they run. All but the last return the columns of documents.
STAGES = [
    ("quality classifier", classifier_stage),
    ("SimHash near-dedup", near_dup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Boosting, ranking and tokenization have no SQL form; tests/llm checks the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-stage{i}")
    return docs
