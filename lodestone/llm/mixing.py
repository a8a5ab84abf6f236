"""Mixing sources to target weights by Sainte-Laguë apportionment (native: DataFrame functions only).

Sources share a budget of words. Blocks of ``BLOCK_WORDS`` words go to sources by highest quotients, then each
source's blocks go to its shards (bounded groups of documents, dealt by a seeded hash) the same way, which gives each
shard an integer quota. A shard's documents, laid end to end in a seeded order, are cut into blocks, and a seeded
permutation of the blocks decides which of them fill the quota.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK_WORDS = 512
SHARD_ROWS = 2048
#: Sources up to which the table of their shards is broadcast.
SOURCE_ROWS = 100_000
SEED = 20240607

#: Primes above any number of blocks in a shard, so that multiplying by one permutes the blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def source_key(source: Column) -> Column:
    """A key without nulls whose order is by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sources: DataFrame) -> DataFrame:
    """``sources(g, size)`` plus ``target``: weighted shares of the budget, none above ``LIMIT`` times its size.

    Resharing the excess until no source is above its limit ends at a common level per weight: the largest level
    reached when sources are stopped in the order of limit over weight. One row a source passes these windows.
    """
    place = (F.row_number().over(Window.orderBy("g")) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place + 1)
    rows = sources.select("*", weight.alias("w"), (LIMIT * F.col("size")).cast("double").alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "g").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(Window.partitionBy())
    none = F.lit(0.0)
    level = (SHARE * total("size") - F.coalesce(F.sum("cap").over(before), none)) / (total("w") - F.coalesce(F.sum("w").over(before), none))
    leveled = rows.select("*", level.alias("level"))
    return leveled.select(*sources.columns, F.least("cap", F.max("level").over(Window.partitionBy()) * F.col("w")).alias("target"))


def apportioned(rows: DataFrame, by: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """``rows`` plus ``won``: integer quotas of ``seats`` (equal within a group ``by``) by highest quotients weight/(2k+1).

    A divisor a little too large seats nearly all; only the quotients between it and one a little too small, about two
    a row, are ranked. Ties go by ``key``.
    """
    group = Window.partitionBy(*by)
    total, n = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    room = rows.select("*", total.cast("double").alias("__t"), n.alias("__n"), F.col(seats).cast("double").alias("__s"))
    held = lambda house: F.floor(F.col(weight) * house / F.col("__t") + 0.5)
    few = F.when(F.col("__t") > 0, F.greatest(held(F.col("__s") - F.col("__n") / 2), F.lit(0))).otherwise(F.lit(0))
    many = F.when((F.col("__t") > 0) & (F.col("__s") > 0), held(F.col("__s") + F.col("__n") / 2 + 1) + 1).otherwise(F.lit(0))
    ranges = room.select("*", few.cast("long").alias("__a"), many.cast("long").alias("__b"))
    ranges = ranges.select("*", (F.col("__s") - F.sum("__a").over(group)).alias("__rest"))
    spare = ranges.where("__b > __a and __rest > 0").select(
        *by, key, "__rest", F.col(weight).cast("double").alias("__w"), F.explode(F.sequence(F.col("__a"), F.col("__b") - 1)).alias("__k")
    )
    order = Window.partitionBy(*by).orderBy((F.col("__w") / (2 * F.col("__k") + 1)).desc(), key, "__k")
    won = spare.select("*", F.row_number().over(order).alias("__r")).where("__r <= __rest")
    won = won.groupBy(*by, key).agg(F.count(F.lit(1)).alias("__won"))
    out = ranges.join(won, [*by, key], "left")
    return out.select(*rows.columns, (F.col("__a") + F.coalesce("__won", F.lit(0))).alias("won"))


def _quotas(shards: DataFrame, block: int) -> DataFrame:
    """``shards(g, shard, size, rows)`` plus ``target`` and ``quota``, words that each shard gives; they add up to the
    source's target rounded to whole words."""
    sums = shards.groupBy("g").agg(F.sum("size").alias("size"))
    aimed = targets(sums).select("g", F.col("size").alias("source_size"), "target", F.lit(0).alias("all"))
    house = F.floor(F.sum("target").over(Window.partitionBy()) / block)
    sources = cut(apportioned(aimed.select("*", house.alias("house")), ["all"], "g", "target", "house"))
    met = shards.join(sources.select("g", "source_size", "target", F.col("won").alias("blocks")), "g")
    dealt = apportioned(met, ["g"], "shard", "size", "blocks")
    most = LIMIT * F.col("size")
    dealt = dealt.select("*", F.least(F.col("won") * block, most).alias("q"))
    group = Window.partitionBy("g")
    dealt = dealt.select("*", (F.round("target").cast("long") - F.sum("q").over(group)).alias("rest"))
    before = group.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    free, seen = most - F.col("q"), F.col("q")
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    more = F.greatest(F.lit(0), F.least(free, F.col("rest") - upto(free)))
    less = F.greatest(F.lit(0), F.least(seen, -F.col("rest") - upto(seen)))
    return dealt.select("g", "shard", "size", "source_size", "target", (F.col("q") + more - less).alias("quota"))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", doc: str = "doc_id", carry: list[str] | None = None,
          block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` (of its columns, ``carry``; all by default) plus ``__size, __source_size, __target, __full, __ranges, __taken``.

    The mix takes ``__full`` whole copies of a document and, once more, the word ranges ``__ranges``
    (``array<struct<start, n>>``, words from 0); ``__taken`` counts their words. A null text has no words and nothing is
    taken of it; null sources are one source, the last; repeated rows each have a place of their own; an empty table
    gives an empty one. Reruns give the same rows: every order and choice is by seeded hashes of the content.
    """
    names = docs.columns if carry is None else carry
    keep = [F.col(f"`{c}`") for c in names]
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))), F.lit(0))
    size = F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(size).cast("long")
    content = F.xxhash64(F.lit(seed), F.col(f"`{doc}`"), F.col(f"`{text}`"))
    rows = docs.select(*keep, source_key(F.col(f"`{source}`")).alias("__g"), content.alias("__h"), size.alias("__size"))
    if text not in names:  # narrow rows are written, and the texts read once
        rows = written(rows, "mix")
    counts = cut(rows.groupBy("__g").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("__shards")))
    few = counts.count() <= SOURCE_ROWS
    dealt = rows.join(F.broadcast(counts) if few else counts, "__g").withColumn("__shard", F.pmod(F.xxhash64("__h", F.lit(seed)), F.col("__shards"))).drop("__shards")
    shards = cut(dealt.groupBy(F.col("__g").alias("g"), F.col("__shard").alias("shard")).agg(F.sum("__size").alias("size")))
    # The plan of a shard: whole passes, then the words that its blocks still give in their seeded order.
    plan = _quotas(shards, block)
    n = F.greatest(F.ceil(F.col("size") / block), F.lit(1))
    lot = F.xxhash64(F.lit(seed), "g", "shard")
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(lot, F.lit(len(PRIMES))) + 1).cast("int"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("quota") / F.greatest("size", F.lit(1)))).otherwise(F.lit(0))
    plan = plan.select("*", n.alias("n"), F.pmod(prime, n).alias("mul"), F.pmod(F.shiftright(lot, 8), n).alias("add"), whole.alias("full"))
    plan = plan.select("*", (F.col("quota") - F.col("full") * F.col("size")).alias("part"))
    # The stream's last block is short: where the part reaches over it, the blocks after it give its missing words.
    last = F.pmod(F.col("mul") * (F.col("n") - 1) + F.col("add"), F.col("n"))
    gap = F.col("n") * block - F.col("size")
    reach = F.col("part") + F.when(F.col("part") > last * block + block - gap, gap).otherwise(F.lit(0))
    plan = plan.select(
        F.col("g").alias("__g"), F.col("shard").alias("__shard"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("full").alias("__full"), "n", "mul", "add", reach.alias("reach"),
    )
    order = Window.partitionBy("__g", "__shard").orderBy(F.xxhash64(F.lit(seed + 1), "__h"), "__h", "__size")
    start = F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    placed = dealt.select("*", start.alias("__start")).join(cut(plan), ["__g", "__shard"])
    end = F.col("__start") + F.col("__size")

    def given(j: Column) -> Column:
        rank = F.pmod(F.col("mul") * j + F.col("add"), F.col("n"))
        words = F.greatest(F.lit(0), F.least(F.lit(block), F.col("reach") - rank * block))
        begin = F.greatest(j * block, F.col("__start"))
        stop = F.least(j * block + words, end)
        return F.struct((begin - F.col("__start")).alias("start"), (stop - begin).alias("n"))

    blocks = F.sequence(F.floor(F.col("__start") / block), F.floor((end - 1) / block))
    ranges = F.when(F.col("__size") > 0, F.filter(F.transform(blocks, given), lambda r: r["n"] > 0))
    out = placed.select(*[F.col(f"`{c}`") for c in names], "__size", "__source_size", "__target", "__full", ranges.alias("__ranges"))
    part = F.coalesce(F.aggregate("__ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["n"]), F.lit(0))
    return out.select("*", (F.col("__full") * F.col("__size") + part).alias("__taken"))


def taken(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy, and one for each range of words taken.

    A range keeps the white space before each of its words but the first.
    """
    rows = mixed(docs, text=text, **options)
    piece = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
    body = F.col(f"`{text}`")
    words = F.regexp_extract_all(body, F.lit(piece), F.lit(0))
    whole = F.transform(F.sequence(F.lit(1), F.col("__full").cast("int")), lambda i: body)
    whole = F.when((F.col("__full") > 0) & (F.col("__size") > 0), whole).otherwise(F.array().cast("array<string>"))
    full_range = (F.size("__ranges") == 1) & (F.col("__ranges")[0]["n"] == F.col("__size"))
    cutout = F.transform(
        "__ranges",
        lambda r: F.regexp_replace(F.array_join(F.slice(words, (r["start"] + 1).cast("int"), r["n"].cast("int")), ""), r"^[\x20\x09-\x0D]+", ""),
    )
    some = F.when(full_range, F.array(body)).when(F.size("__ranges") > 0, cutout).otherwise(F.array().cast("array<string>"))
    columns = [F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rows.where("__taken > 0").withColumn("__text", F.explode(F.concat(whole, some))).select(*columns)
