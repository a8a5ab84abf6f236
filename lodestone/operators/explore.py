"""Reports over the link model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ARTICLE, CATEGORY, DEFAULT

#: Upper bounds and labels of the degree report's buckets.
BUCKETS = ((0, "0"), (4, "1-4"), (9, "5-9"), (49, "10-49"), (99, "50-99"), (499, "100-499"))
LAST_BUCKET = "500+"


def redirect_statistics(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """One row: all pages, articles with content, categories, redirects, and each part's percentage."""
    counts = pages.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ns") == ARTICLE).alias("articles"), F.count_if(F.col("ns") == CATEGORY).alias("categories"))
    both = counts.crossJoin(redirects.agg(F.count(F.lit(1)).alias("redirects")))
    rows = both.select("total", (F.col("articles") - F.col("redirects")).alias("content"), "categories", "redirects")
    share = lambda c: F.when(F.col("total") > 0, 100.0 * F.col(c) / F.col("total")).alias(f"{c}_percent")
    return rows.select("*", share("content"), share("categories"), share("redirects"))


def bucket(degree: Column) -> Column:
    out = None
    for top, label in BUCKETS:
        out = (F if out is None else out).when(degree <= top, label)
    return out.otherwise(LAST_BUCKET)


def degree_distribution(pages: DataFrame) -> DataFrame:
    """``degree_type, bucket, pages`` of articles, buckets in order of degree; empty ones do not appear."""
    degrees = F.explode(F.array(*[F.struct(F.lit(c).alias("degree_type"), F.col(c).alias("d")) for c in ("in_degree", "out_degree")]))
    rows = pages.where(F.col("ns") == ARTICLE).select(degrees.alias("x")).select("x.degree_type", "x.d")
    rows = rows.groupBy("degree_type", bucket(F.col("d")).alias("bucket")).agg(F.count(F.lit(1)).alias("pages"), F.min("d").alias("least"))
    return rows.orderBy("degree_type", "least").drop("least")


def top_pages(pages: DataFrame, ns: int = ARTICLE, limit: int = DEFAULT.limit) -> DataFrame:
    """``rank, title, score``: the pages of the highest rank, ties by id."""
    best = pages.where(F.col("ns") == ns).select("id", "title", F.col("rank1").alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rank"), "title", "score")


def snippet(text: Column, words: int = 64) -> Column:
    """The first words of a text, with an ellipsis where more follow."""
    every = F.split(F.trim(text), r"\s+")
    return F.when(F.size(every) > words, F.concat(F.array_join(F.slice(every, 1, words), " "), F.lit(" ..."))).otherwise(F.array_join(every, " "))


def shortened(url: Column, width: int = 80) -> Column:
    return F.when(F.length(url) > width, F.concat(F.substring(url, 1, width), F.lit("…"))).otherwise(url)


def wiki_url(title: Column, base: str = "https://simple.wikipedia.org/wiki/") -> Column:
    return F.concat(F.lit(base), F.translate(title, " ", "_"))
