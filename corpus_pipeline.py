"""A training corpus from raw documents: STAGES, each with one operator, written and read again between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import stages
from lodestone.llm.shared import written

STAGES = stages.STAGES
#: Fingerprints, tokens and seeded choices have no SQL. tests/llm holds the operators against brute-force versions; of the pipeline as a whole
#: it checks that stages keep the columns and that reruns agree.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}-{name}")
    return docs
