"""nDCG of search results against judgements, for many queries and settings in one plan."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ARTICLE, DEFAULT, EngineConfig
from ..functions.text import unicode_tokens
from . import search


def with_found(qrels: DataFrame, pages: DataFrame) -> DataFrame:
    """``key, title, rel, found``: whether an article has the judged title; of several judgements of a title the highest counts."""
    titles = pages.where(F.col("ns") == ARTICLE).select("title").distinct().withColumn("found", F.lit(True))
    once = qrels.groupBy("key", "title").agg(F.max("rel").alias("rel"))
    return once.join(titles, "title", "left").select("key", "title", "rel", F.coalesce("found", F.lit(False)).alias("found"))


def _gain(rel: Column, position: Column) -> Column:
    return rel / F.log2(position + 1)


def _dcg(rows: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    return rows.where(F.col("position") <= k).groupBy(*by).agg(F.sum(_gain(F.col("rel"), F.col("position"))).alias(name))


def _ideal(qrels: DataFrame, k: int, alike: DataFrame | None = None) -> DataFrame:
    """``key, ideal`` of the found judgements, best first, of the queries where it is above zero."""
    if alike is not None:  # no more than k of them can count
        some = alike.where("n > 0").select("key", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("i"), "first")
        some = some.select("key", F.concat_ws(" ", "first", "i").alias("title"), F.lit(1).alias("rel"), F.lit(True).alias("found"))
        qrels = qrels.select("key", "title", "rel", "found").unionByName(some)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rel"), "title"))
    return _dcg(qrels.where("found").withColumn("position", place), ["key"], k, "ideal").where("ideal > 0")


def _judged(results: DataFrame, qrels: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """Results with ``rel``, null where nothing is judged."""
    rows = results.join(qrels.select("key", "title", "rel"), ["key", "title"], "left")
    if alike is None:
        return rows
    rows = rows.withColumn("first", F.get(unicode_tokens("title"), 0)).join(alike.select("key", "first", F.lit(1).alias("like")), ["key", "first"], "left")
    return rows.withColumn("rel", F.greatest("rel", "like")).drop("first", "like")


def ndcg(results: DataFrame, qrels: DataFrame, k: int = DEFAULT.k2, alike: DataFrame | None = None) -> DataFrame:
    """``key, ndcg_pessimistic, ndcg_optimistic`` of the queries with a found judgement above zero.

    ``results(key, position, title)``, ``qrels(key, title, rel, found)``. Unjudged results count as irrelevant, or (optimistic) are
    left out and the others close up. The ideal is the found judgements, best first. ``alike(key, first, n)`` judges results whose title begins with the
    word ``first`` by 1, too, ``n`` of which are found beside ``qrels``: judgements by the thousand a query, which are never written one by one.
    """
    ideal = _ideal(qrels, k, alike)
    judged = _judged(results, qrels, alike)
    strict = _dcg(judged.withColumn("rel", F.coalesce("rel", F.lit(0))), ["key"], k, "strict")
    closed = judged.where("rel IS NOT NULL").withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy("position")))
    loose = _dcg(closed, ["key"], k, "loose")
    part = lambda c: F.coalesce(F.col(c) / F.col("ideal"), F.lit(0.0))
    met = ideal.join(strict, "key", "left").join(loose, "key", "left")
    return met.select("key", part("strict").alias("ndcg_pessimistic"), part("loose").alias("ndcg_optimistic"))


def means(by_query: DataFrame) -> DataFrame:
    """The two means and the number of queries; null means where there is none."""
    return by_query.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("ndcg_pessimistic").alias("ndcg_pessimistic"), F.avg("ndcg_optimistic").alias("ndcg_optimistic")
    )


def grid(k1=(50, 100, 150), title=(1.0, 2.0, 3.0), text=(1.0, 2.0, 3.0), alpha=(0.7, 0.8, 0.9), base: EngineConfig = DEFAULT) -> list[EngineConfig]:
    return [replace(base, k1=a, title_unicode=b, title_trigram=b, text_unicode=c, text_trigram=c, alpha=d) for a, b, c, d in product(k1, title, text, alpha)]


def _gains(table: pa.Table, settings: list[EngineConfig]) -> pa.Table:
    """``key, setting, strict, loose`` of one query's candidates ``key, stream, id, bm25, rank, rel`` (unweighted), for every setting."""
    stream, ids, bm25, rank, rel = (table.column(c).to_numpy() for c in ("stream", "id", "bm25", "rank", "rel"))
    order = np.lexsort((ids, bm25, stream))
    stream, ids, bm25, rank, rel = stream[order], ids[order], bm25[order], rank[order], rel[order]
    place = np.arange(len(ids)) - np.searchsorted(stream, stream) + 1
    part = lambda a, most: a / most if most else np.zeros(len(a))
    rows = []
    for number, c in enumerate(settings):
        in_k1 = place <= c.k1
        weighted = bm25[in_k1] * np.where(stream[in_k1] < 2, c.title_unicode, c.text_unicode)
        score = -c.alpha * part(weighted, weighted.min()) - (1 - c.alpha) * part(rank[in_k1], rank[in_k1].max())
        near = np.lexsort((ids[in_k1], score))
        once = np.sort(np.unique(ids[in_k1][near], return_index=True)[1])[: settings[0].k2]  # a page counts with its best score
        judged = rel[in_k1][near[once]]
        held = ~np.isnan(judged)
        gain = lambda x, places: float((x / np.log2(places + 1)).sum())
        rows.append((number, gain(judged[held], np.nonzero(held)[0] + 1), gain(judged[held], np.arange(1, held.sum() + 1))))
    number, strict, loose = zip(*rows, strict=True)
    key = pa.array([table.column("key")[0].as_py()] * len(rows), pa.string())
    return pa.table({"key": key, "setting": pa.array(number, pa.int32()), "strict": pa.array(strict, pa.float64()), "loose": pa.array(loose, pa.float64())})


def grid_search(index: search.SearchIndex, queries: DataFrame, qrels: DataFrame, settings: list[EngineConfig], alike: DataFrame | None = None) -> DataFrame:
    """``k1, title_weight, text_weight, alpha, queries`` and both means for each setting.

    The streams are scored once, unweighted, with the largest k1 (a positive weight does not change a stream's order). A query's
    candidates meet in one task with what was judged of them, and every setting is weighed there, so neither they nor the judgements are copied for each setting.
    """
    spark = queries.sparkSession
    widest = replace(settings[0], k1=max(s.k1 for s in settings), title_unicode=1.0, title_trigram=1.0, text_unicode=1.0, text_trigram=1.0)
    found = search.candidates(index, queries, False, widest)
    rows = [(i, s.k1, s.title_unicode, s.text_unicode, s.alpha) for i, s in enumerate(settings)]
    table = spark.createDataFrame(rows, "setting int, k1 int, title_weight double, text_weight double, alpha double")
    judged = _judged(found, qrels, alike).select(
        "key", "stream", "id", "bm25", F.coalesce("rank1", F.lit(0.0)).alias("rank"), F.coalesce(F.col("rel").cast("double"), F.lit(float("nan"))).alias("rel")
    )
    gains = judged.groupBy("key").applyInArrow(lambda t: _gains(t, settings), "key string, setting int, strict double, loose double")
    ideal = _ideal(qrels, settings[0].k2, alike).join(queries.select("key"), "key", "left_semi")
    every = ideal.crossJoin(F.broadcast(table.select("setting"))).join(gains, ["setting", "key"], "left")
    part = lambda c: F.avg(F.coalesce(F.col(c) / F.col("ideal"), F.lit(0.0)))
    out = every.groupBy("setting").agg(F.count(F.lit(1)).alias("queries"), part("strict").alias("ndcg_pessimistic"), part("loose").alias("ndcg_optimistic"))
    return table.join(out, "setting", "left").drop("setting")


def has_title(pages: DataFrame, uri: str) -> bool:
    """Whether an article has the title that a DBpedia URI names."""
    title = uri.removeprefix("<dbpedia:").removesuffix(">").replace("_", " ")
    return not pages.where((F.col("ns") == ARTICLE) & (F.col("title") == title)).isEmpty()


def save_report(results: DataFrame, by_query: DataFrame, folder: str) -> None:
    """Results and each query's scores as JSON lines, to look into a run later."""
    results.write.mode("overwrite").json(f"{folder}/results")
    by_query.write.mode("overwrite").json(f"{folder}/scores")
