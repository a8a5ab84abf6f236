"""The seven tables of the link model from parsed dump pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ARTICLE, CATEGORY
from ..functions.urls import SUFFIXES, with_domain, with_rules
from ..functions.wikitext import namespace_title, read_once
from ..storage import cut
from .graph import fill_redirects


def dedup_texts(rows: DataFrame) -> DataFrame:
    """``id, hash, text, page_id`` of ``rows(page_id, text)``: one id, the least page's, for each distinct text."""
    hashed = rows.select("page_id", "text", F.md5("text").alias("hash"))
    first = hashed.groupBy("hash", "text").agg(F.min("page_id").alias("id"))
    return hashed.join(first, ["hash", "text"]).select("id", "hash", "text", "page_id")


def resolve(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``source_id, target_id`` of ``rows(source_id, ns, title)``: links to pages with this namespace and exact title, once each."""
    named = pages.select("ns", "title", F.col("id").alias("target_id"))
    return rows.join(named, ["ns", "title"]).select("source_id", "target_id").distinct()


def first_pages(rows: DataFrame) -> DataFrame:
    """One page an id, the least by its other columns in order, and of these one a (namespace, title): that of the least id.

    Both are partial minima, so a title or an id that many rows share is met in no single task.
    """
    once = rows
    for keys in (["id"], ["ns", "title"]):
        rest = [c for c in rows.columns if c not in keys]
        rest.sort(key=lambda c: c != "id")
        once = once.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*")
    return once.select(*rows.columns)


def keyed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``id``, a hash of their natural key: the same wherever and however often it is computed."""
    return rows.withColumn("id", F.xxhash64(name))


#: Columns that no two rows of a table have alike (see ``storage.Tables.insert``).
KEYS = {
    "internal_texts": [["id"]], "internal_pages": [["id"], ["ns", "title"]], "internal_links": [["source_id", "target_id"]], "external_domains": [["name"]],
    "external_pages": [["url"]], "external_links": [["source_id", "target_id"]], "redirects": [["source_id"]],
}


def tables(parsed: DataFrame, dedup: bool = True, resolve_redirects: bool = False, suffixes: tuple[str, ...] = SUFFIXES, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """The model's tables from ``parsed(id, ns, title, redirect, text)``; only articles and categories are loaded.

    What the texts hold is read from them once and written to the shared folder, from which all tables come; so a dump is parsed
    once. Domains end before one of ``suffixes``, or before what ``rules`` (see ``urls.split_hosts``) make a public suffix.
    """
    loaded = cut(read_once(first_pages(parsed.where(F.col("ns").isin(ARTICLE, CATEGORY)))))
    content = loaded.where("redirect IS NULL")
    leads = content.where(F.col("ns") == ARTICLE).select(F.col("id").alias("page_id"), F.col("lead").alias("text")).where("text <> ''")
    texts = dedup_texts(leads) if dedup else leads.select(F.col("page_id").alias("id"), F.md5("text").alias("hash"), "text", "page_id")
    owner = texts.select(F.col("page_id").alias("id"), F.col("id").alias("text_id"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("in_degree", "long"), ("out_degree", "long"), ("rank1", "double"), ("rank2", "double"), ("authority", "double"))]
    pages = loaded.select("id", "ns", "title").join(owner, "id", "left").select("id", "ns", "title", "text_id", *none)
    found = content.select(F.col("id").alias("source_id"), F.explode("links").alias("link"))
    found = found.select("source_id", namespace_title(F.col("link")).alias("x")).select("source_id", "x.ns", "x.title")
    turned = loaded.where("redirect IS NOT NULL").select(F.col("id").alias("source_id"), namespace_title(F.col("redirect")).alias("x"))
    redirects = resolve(turned.select("source_id", "x.ns", "x.title"), pages)
    cited = content.select(F.col("id").alias("source_id"), F.explode("urls").alias("url"))
    cited = with_domain(cited, "url", suffixes) if rules is None else with_rules(cited, rules)
    cited = cited.where("name IS NOT NULL")
    ext_pages = keyed(cited.select("url", F.xxhash64("name").alias("domain_id")).distinct(), "url")
    return {
        "internal_texts": texts.select("id", "hash", "text").distinct(),
        "internal_pages": fill_redirects(pages, redirects) if resolve_redirects else pages,
        "internal_links": resolve(found, pages),
        "external_domains": keyed(cited.select("name", "tld").distinct(), "name").select("id", "name", "tld"),
        "external_pages": ext_pages.select("id", "url", "domain_id"),
        "external_links": cited.select("source_id", F.xxhash64("url").alias("target_id")).distinct(),
        "redirects": redirects,
    }
