"""Readers of wiki dumps, judgement files and rank tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

_PAGE = "id long, ns int, title string, redirect struct<_title string>, revision struct<text struct<_VALUE string>>"


def index(spark: SparkSession, path: str) -> DataFrame:
    """``offset, page_id, title`` of a dump's index (bz2 text); titles keep their colons."""
    part = lambda k: F.regexp_extract("value", r"^(\d+):(\d+):(.*)$", k)
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\d+:\d+:"))
    return rows.select(part(1).cast("long").alias("offset"), part(2).cast("long").alias("page_id"), part(3).alias("title"))


def blocks(rows: DataFrame) -> DataFrame:
    """``offset, pages``: the index by compressed block (about a hundred pages each)."""
    return rows.groupBy("offset").agg(F.array_sort(F.collect_list(F.struct("page_id", "title"))).alias("pages"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """``id, ns, title, redirect, text`` of every page of a dump (multistream bz2 XML); a missing text is empty."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path)
    return rows.select("id", "ns", "title", F.col("redirect._title").alias("redirect"), F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))


def qrels(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``key, title, rel`` of judgements ``key _ <dbpedia:Title> rel`` whose key starts with ``prefix``."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+", 4).alias("p")).where(F.size("p") == 4)
    rows = parts.select(F.col("p")[0].alias("key"), uri_title(F.col("p")[2]).alias("title"), F.col("p")[3].cast("int").alias("rel"))
    return rows.where(F.col("key").startswith(prefix))


def uri_title(uri: F.Column) -> F.Column:
    return F.translate(F.regexp_replace(uri, r"^<dbpedia:|>$", ""), "_", " ")


def queries(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``key, query`` of a query file whose key starts with ``prefix``."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+", 2).alias("p")).where(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("key"), F.col("p")[1].alias("query")).where(F.col("key").startswith(prefix))


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """Ranks as ``write_ranks`` leaves them; empty fields are null."""
    return spark.read.option("header", True).option("nullValue", "").schema(schema.RANKS_CSV).csv(path)


def write_ranks(rows: DataFrame, path: str) -> None:
    rows.select("id", "rank1", "rank2", "authority").write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
