"""Authority of cited domains, of top-level domains and of pages, rolled up from PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ARCHIVES, ARTICLE, DEFAULT


def domain_authority(pages: DataFrame, ext_links: DataFrame, ext_pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Per domain cited by articles, archives left out: distinct citing pages, mean and sum of rank over links (a page that cites
    two addresses of a domain counts twice in both)."""
    cited = (
        ext_links.join(pages.where(F.col("ns") == ARTICLE).select(F.col("id").alias("source_id"), "rank1"), "source_id")
        .join(ext_pages.select(F.col("id").alias("target_id"), "domain_id"), "target_id")
        .join(domains.where(~F.col("name").isin(*ARCHIVES)).select(F.col("id").alias("domain_id"), "name", "tld"), "domain_id")
    )
    return cited.groupBy("domain_id", "name", "tld").agg(
        F.countDistinct("source_id").alias("citing_pages"), F.avg("rank1").alias("avg_citing_pagerank"), F.sum("rank1").alias("total_citing_pagerank")
    )


def tld_authority(by_domain: DataFrame) -> DataFrame:
    """Per top-level domain: domains, summed citing pages, mean of the domains' means, summed rank."""
    return by_domain.groupBy("tld").agg(
        F.count(F.lit(1)).alias("domains"), F.sum("citing_pages").alias("citing_pages"),
        F.avg("avg_citing_pagerank").alias("avg_citing_pagerank"), F.sum("total_citing_pagerank").alias("total_citing_pagerank"),
    )


def page_authority(ext_links: DataFrame, ext_pages: DataFrame, by_domain: DataFrame) -> DataFrame:
    """Per citing page: distinct domains cited and their summed authority, once for each link."""
    met = ext_links.join(ext_pages.select(F.col("id").alias("target_id"), "domain_id"), "target_id")
    met = met.join(by_domain.select("domain_id", "total_citing_pagerank"), "domain_id")
    return met.groupBy(F.col("source_id").alias("page_id")).agg(F.countDistinct("domain_id").alias("distinct_domains"), F.sum("total_citing_pagerank").alias("total_citing_pagerank"))


def with_authority(pages: DataFrame, by_page: DataFrame) -> DataFrame:
    """Pages with ``authority`` from the roll-up; null where there is none."""
    new = by_page.select(F.col("page_id").alias("id"), F.col("total_citing_pagerank").alias("authority"))
    return pages.drop("authority").join(new, "id", "left")


def page_profile(pages: DataFrame, ext_links: DataFrame, ext_pages: DataFrame, domains: DataFrame) -> DataFrame:
    """A row for each citation: page, address, domain, and how often the page cites the domain."""
    met = (
        ext_links.join(pages.select(F.col("id").alias("source_id"), "ns", "title"), "source_id")
        .join(ext_pages.select(F.col("id").alias("target_id"), "url", "domain_id"), "target_id")
        .join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"), "tld"), "domain_id")
    )
    count = F.count(F.lit(1)).over(Window.partitionBy("source_id", "domain_id"))
    return met.select(F.col("source_id").alias("page_id"), "ns", "title", "url", "domain", "tld", count.alias("domain_citation_count"))


def top_domains(by_domain: DataFrame, min_citing_pages: int = DEFAULT.min_citing_pages, limit: int = DEFAULT.limit) -> DataFrame:
    kept = by_domain.where(F.col("citing_pages") >= min_citing_pages)
    return kept.orderBy(F.desc("total_citing_pagerank"), "name").limit(limit).drop("domain_id")


def top_tlds(by_tld: DataFrame, min_citing_pages: int = DEFAULT.min_citing_pages_tld) -> DataFrame:
    return by_tld.where(F.col("citing_pages") >= min_citing_pages).orderBy(F.desc("total_citing_pagerank"), "tld")


def page_sources(profile: DataFrame, title: str, min_citations: int = DEFAULT.min_citations) -> DataFrame:
    """What an article cites: address, domain, top-level domain and citations of the domain, most cited domains first."""
    kept = profile.where((F.col("ns") == ARTICLE) & (F.col("title") == title) & (F.col("domain_citation_count") >= min_citations))
    return kept.select("url", "domain", "tld", "domain_citation_count").orderBy(F.desc("domain_citation_count"), "domain", "url")
