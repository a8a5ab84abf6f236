"""Search: BM25 streams over titles and texts, fused with PageRank. Any number of queries run in one plan."""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ARTICLE, DEFAULT, EngineConfig
from ..functions.text import query_terms
from ..storage import cut, shared_dir
from . import matchquery, textindex
from .textindex import Looked, TextIndex

#: Characters and words that make a raw query more than a list of words (see ``matchquery``).
_SYNTAX = r"[^\w\s\x{80}-\x{10FFFF}]|(?:^|\s)(?:AND|OR|NOT)(?:\s|$)"


@dataclass(frozen=True)
class SearchIndex:
    """Pages and texts with their four indexes."""

    pages: DataFrame
    texts: DataFrame
    title_unicode: TextIndex
    title_trigram: TextIndex
    text_unicode: TextIndex
    text_trigram: TextIndex


def build(pages: DataFrame, texts: DataFrame) -> SearchIndex:
    """Indexes over all pages' titles (every namespace) and all texts."""
    titles = pages.select(F.col("id").alias("doc_id"), F.col("title").alias("body"))
    bodies = texts.select(F.col("id").alias("doc_id"), F.col("text").alias("body"))
    made = [textindex.build(rows, kind) for rows in (titles, bodies) for kind in ("unicode", "trigram")]
    return SearchIndex(pages, texts, *made)


def stored(index: SearchIndex, folder: str | None = None) -> SearchIndex:
    """The same search index with its four text indexes written once under ``folder`` (or the shared one), for any number of queries."""
    folder = folder or f"{shared_dir(index.pages.sparkSession)}/search-{uuid.uuid4().hex}"
    names = ("title_unicode", "title_trigram", "text_unicode", "text_trigram")
    return replace(index, **{name: getattr(index, name).stored(f"{folder}/{name}") for name in names})


def idfs(index: TextIndex | Looked, queries: DataFrame) -> DataFrame:
    """``key, term, idf`` of the queries' terms, looked up as they stand; a term that no text holds has the largest double."""
    terms, held = textindex.small(queries.select("key", F.explode(query_terms(F.col("query"))).alias("term")))
    vocabulary = index.vocabulary()
    if held is not None and len({row["term"] for row in held}) <= textindex.PUSHED:
        vocabulary = vocabulary.where(F.col("term").isin(sorted({row["term"] for row in held})))
    known = vocabulary.select("term", F.log1p(F.lit(float(index.n)) / F.col("doc")).alias("idf"))
    return terms.join(known, "term", "left").select("key", "term", F.coalesce("idf", F.lit(sys.float_info.max)).alias("idf"))


def kept_terms(weights: DataFrame, threshold: float = DEFAULT.idf_threshold) -> DataFrame:
    """Terms whose IDF reaches the threshold; where a query has none, those of its largest IDF."""
    top = F.max("idf").over(Window.partitionBy("key"))
    rows = weights.select("key", "term", "idf", top.alias("top"))
    return rows.where((F.col("idf") >= threshold) | ((F.col("top") < threshold) & (F.col("idf") == F.col("top")))).select("key", "term", "idf")


def fused(bm25: Column, least: Column, rank: Column, most: Column, alpha: float = DEFAULT.alpha) -> Column:
    """The score, -1 at best: relevance against the best candidate's, and rank against the highest."""
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return alpha * -part(bm25, least) + (1 - alpha) * -part(rank, most)


def _top(found: DataFrame, weight: float, k1: int, stream: int) -> DataFrame:
    """A stream's ``k1`` best pages of each query."""
    rows = found.withColumn("bm25", F.col("bm25") * weight)
    place = F.row_number().over(Window.partitionBy("key").orderBy("bm25", "id"))
    return rows.withColumn("__r", place).where(F.col("__r") <= k1).drop("__r").withColumn("stream", F.lit(stream))


def _parted(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, term`` of the queries that are plain words, and the queries with operators."""
    marked = queries.where(F.col("query").rlike(_SYNTAX))
    return queries.where(~F.coalesce(F.col("query").rlike(_SYNTAX), F.lit(False))).select("key", F.explode(query_terms(F.col("query"))).alias("term")), marked


def _raw(index: TextIndex, queries: DataFrame) -> DataFrame:
    """``key, doc_id, bm25`` of the queries as they were typed: operators are read, words side by side must all be there.

    Plain words may be asked in any number; queries with operators are a query set of ``textindex.SMALL_ROWS`` at most. One that is no query raises ``ValueError``.
    """
    terms, marked = _parted(queries)
    found = textindex.bm25(index, terms, "bare")
    return found if marked.isEmpty() else found.unionByName(matchquery.answered(index, marked))


def _best_raw(index: TextIndex, narrow: TextIndex | Looked, queries: DataFrame, k: int, pages: DataFrame) -> DataFrame:
    """``key, id, bm25`` of the best pages of the queries as ``_raw`` reads them; plain words are looked up in ``narrow``."""
    terms, marked = _parted(queries)
    found = textindex.best(narrow, terms, "bare", k, pages)
    return found if marked.isEmpty() else found.unionByName(matchquery.answered(index, marked).join(pages, "doc_id").select("key", "id", "bm25"))


def _looked(index: SearchIndex, queries: DataFrame, names: list[str]) -> dict[str, TextIndex | Looked]:
    """The words of the queries looked up in the indexes of these names, so that weights and streams share one pass over the texts."""
    terms = cut(queries.select("key", F.explode(query_terms(F.col("query"))).alias("term")))
    return {name: textindex.looked(getattr(index, name), terms) for name in names}


def candidates(index: SearchIndex, queries: DataFrame, interactive: bool = True, config: EngineConfig = DEFAULT) -> DataFrame:
    """The streams' best pages: ``key, stream, id, ns, title, text_id, bm25 (weighted), rank1, authority``."""
    pages = index.pages.where((F.col("ns") == ARTICLE) & F.col("text_id").isNotNull()).select("id", "ns", "title", "text_id", "rank1", "authority")
    by_id, by_text = pages.select(F.col("id").alias("doc_id"), "id"), pages.select(F.col("text_id").alias("doc_id"), "id")
    here = _looked(index, queries, ["title_unicode", "title_trigram"] if interactive else ["title_unicode", "title_trigram", "text_unicode", "text_trigram"])
    titles = cut(kept_terms(idfs(here["title_unicode"], queries), config.idf_threshold).select("key", "term"))
    if interactive:
        streams = [
            (textindex.best(here["title_unicode"], titles, "and", config.k1, by_id), config.title_unicode),
            (textindex.best(here["title_trigram"], titles, "and", config.k1, by_id), config.title_trigram),
        ]
    else:
        texts = cut(kept_terms(idfs(here["text_unicode"], queries), config.idf_threshold).select("key", "term"))
        streams = [
            (textindex.best(here["title_unicode"], titles, "or", config.k1, by_id), config.title_unicode),
            (_best_raw(index.title_trigram, here["title_trigram"], queries, config.k1, by_id), config.title_trigram),
            (textindex.best(here["text_unicode"], texts, "and", config.k1, by_text), config.text_unicode),
            (_best_raw(index.text_trigram, here["text_trigram"], queries, config.k1, by_text), config.text_trigram),
        ]
    found = reduce(DataFrame.unionByName, [_top(rows, weight, config.k1, stream) for stream, (rows, weight) in enumerate(streams)])
    return found.join(pages, "id").select("key", "stream", "id", "ns", "title", "text_id", "bm25", "rank1", "authority")


def ranked(found: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Each query's ``k2`` best pages of its candidates: ``key, position, id, ns, title, text_id, bm25, rank, authority, score``."""
    every = Window.partitionBy("key")
    score = fused(F.col("bm25"), F.min("bm25").over(every), F.coalesce("rank1", F.lit(0.0)), F.max("rank1").over(every), config.alpha)
    scored = found.withColumn("score", score)
    first = F.row_number().over(Window.partitionBy("key", "id").orderBy("score", "stream"))
    once = scored.withColumn("__r", first).where("__r = 1")
    place = F.row_number().over(every.orderBy("score", "id"))
    best = once.withColumn("position", place).where(F.col("position") <= config.k2)
    return best.select("key", "position", "id", "ns", "title", "text_id", "bm25", F.col("rank1").alias("rank"), "authority", "score")


def search(index: SearchIndex, queries: DataFrame, interactive: bool = True, config: EngineConfig = DEFAULT) -> DataFrame:
    """``key, position, page_id, ns, title, text, bm25, rank, authority`` of each of ``queries(key, query)``; blank queries find nothing."""
    best = ranked(candidates(index, queries, interactive, config), config)
    out = best.join(index.texts.select(F.col("id").alias("text_id"), "text"), "text_id")
    return out.select("key", "position", F.col("id").alias("page_id"), "ns", "title", "text", "bm25", "rank", "authority")


def search_query(index: SearchIndex, query: str, interactive: bool = True, config: EngineConfig = DEFAULT) -> DataFrame:
    """The pages for one query, in order. In batch mode it may have operators."""
    queries = index.pages.sparkSession.createDataFrame([("query", query)], "key string, query string")
    return search(index, queries, interactive, config).orderBy("position").drop("key", "position")
