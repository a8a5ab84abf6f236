"""The stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, neartext, quality, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8 or more; see ``neartext``)."""
    return neartext.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of any benchmark item. (Here one item is enough to lose a document: a leak of one
    question is a leak.)"""
    rows = decontaminate.scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.where(F.size("__scan.items") == 0).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole copies of documents and ranges of their words, with n_chars of the text that each row has."""
    return mixing.taken(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places, lengths and checksums in the written token files."""
    return tokens.documents(tokens.shards(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
