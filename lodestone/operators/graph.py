"""Degrees, PageRank and shortest paths over a table of directed links."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ARTICLE, DEFAULT, EngineConfig
from ..storage import cut


def degrees(pages: DataFrame, links: DataFrame, ns: int | None = None) -> DataFrame:
    """``id, in_degree, out_degree``: links to and from other pages of the namespace (any, if ``ns`` is None); self links count."""
    nodes = pages.select("id") if ns is None else pages.where(F.col("ns") == ns).select("id")
    other = nodes.withColumnRenamed("id", "o")
    into = links.join(other, links.source_id == F.col("o"), "left_semi") if ns is not None else links
    out = links.join(other, links.target_id == F.col("o"), "left_semi") if ns is not None else links
    ins = into.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    outs = out.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return nodes.join(ins, "id", "left").join(outs, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def inner_links(pages: DataFrame, links: DataFrame, ns: int) -> DataFrame:
    """Links whose both ends are pages of the namespace."""
    nodes = pages.where(F.col("ns") == ns).select(F.col("id").alias("n"))
    both = links.join(nodes, links.source_id == F.col("n"), "left_semi")
    return both.join(nodes, both.target_id == F.col("n"), "left_semi")


def page_ranks(pages: DataFrame, links: DataFrame, namespaces: list[int] | None = None, config: EngineConfig = DEFAULT, teleport: str = "all", rule: str = "max") -> DataFrame:
    """``id, ns, rank1, rank2, iterations, converged`` of the pages of all namespaces (or of some), each ranked by itself, in one loop.

    Rank does not leave a namespace. What its dangling pages lose is spread evenly over it. The teleport part is divided by the
    number of all pages (``teleport="all"``) or of the namespace's (``"ns"``). A namespace is done, and leaves the loop, once no rank moves by
    ``tolerance`` (``rule="max"``), or once all moves together are below ``tolerance`` a page (``"l1"``); then both ranks are equal, else ``rank2`` is the one before.
    ``rank1`` is the final rank. An empty namespace gives no rows.

    Edges carry 1/out-degree, stay partitioned by source and cached across iterations; one shuffle a round sums by target, whatever the number
    of namespaces. A round is one job that writes what the pages receive and one small sum over it, a row a namespace: the
    largest move follows from the sums' ends, as all pages of a namespace get the same on top. Only the L1 rule takes another sum.
    """
    if rule not in ("max", "l1"):
        raise ValueError(f"no such rule: {rule!r}")
    nodes = pages if namespaces is None else pages.where(F.col("ns").isin(*namespaces))
    nodes = nodes.select("id", "ns").persist(StorageLevel.MEMORY_AND_DISK)
    n_all = pages.count()
    sizes = {r["ns"]: r["n"] for r in nodes.groupBy("ns").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("ns").alias(f"{side}_ns"))
    edges = links.join(of("source"), "source_id").join(of("target"), "target_id").where("source_ns = target_ns").select("source_id", "target_id", F.col("source_ns").alias("ns"))
    outs = edges.groupBy("source_id").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    edges = edges.join(outs, "source_id").select("source_id", "target_id", "ns", "weight").repartition("source_id").persist(StorageLevel.MEMORY_AND_DISK)
    by_ns = lambda values, c="ns": F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in values.items()])
    damping = config.damping
    base = {ns: (1.0 - damping) / max(1, n_all if teleport == "all" else n) for ns, n in sizes.items()}
    active, done, turn = set(sizes), [], 0
    state = nodes.select("id", "ns", by_ns({ns: 1.0 / n for ns, n in sizes.items()}).alias("rank1")) if sizes else None
    while active and turn < config.max_iterations:
        turn += 1
        live = edges.where(F.col("ns").isin(*active)) if len(active) < len(sizes) else edges
        sent = live.join(state.select(F.col("id").alias("source_id"), F.col("rank1").alias("r")), "source_id")
        got = sent.groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("r") * F.col("weight")).alias("c"))
        moved = cut(state.join(got, "id", "left").select("id", "ns", F.col("rank1").alias("old"), F.coalesce("c", F.lit(0.0)).alias("c")))
        x = damping * F.col("c") - F.col("old")
        sums = {r["ns"]: r for r in moved.groupBy("ns").agg(F.sum("c").alias("c"), F.min(x).alias("low"), F.max(x).alias("high")).collect()}
        same = {ns: base[ns] + damping * (1.0 - r["c"]) / sizes[ns] for ns, r in sums.items()}
        state = moved.select("id", "ns", (by_ns(same) + damping * F.col("c")).alias("rank1"), "old")
        if rule == "max":
            ended = {ns for ns, r in sums.items() if max(abs(same[ns] + r["low"]), abs(same[ns] + r["high"])) < config.tolerance}
        else:
            moves = state.groupBy("ns").agg(F.sum(F.abs(F.col("rank1") - F.col("old"))).alias("l1")).collect()
            ended = {r["ns"] for r in moves if r["l1"] < config.tolerance * sizes[r["ns"]]}
        if turn == config.max_iterations or ended:
            out = active if turn == config.max_iterations else ended
            second = F.when(F.col("ns").isin(*ended), F.col("rank1")).otherwise(F.col("old")) if ended else F.col("old")
            last = state.where(F.col("ns").isin(*out))
            done.append(last.select("id", "ns", "rank1", second.alias("rank2"), F.lit(turn).alias("iterations"), F.col("ns").isin(*ended).alias("converged") if ended else F.lit(False).alias("converged")))
            active = active - out
            state = state.where(F.col("ns").isin(*active)) if active else state
        state = state.drop("old")
    if not done:
        start = nodes.select("id", "ns", (by_ns({ns: 1.0 / n for ns, n in sizes.items()}) if sizes else F.lit(None).cast("double")).alias("rank1"), F.lit(None).cast("double").alias("rank2"))
        done = [start.select("*", F.lit(0).alias("iterations"), F.lit(False).alias("converged"))]
    result = cut(reduce(DataFrame.unionByName, done))
    for table in (nodes, edges):
        table.unpersist()
    return result


def page_rank(pages: DataFrame, links: DataFrame, ns: int = ARTICLE, config: EngineConfig = DEFAULT, teleport: str = "all", rule: str = "max") -> DataFrame:
    """``id, rank1, rank2, iterations, converged`` of one namespace's pages (see ``page_ranks``)."""
    return page_ranks(pages, links, [ns], config, teleport, rule).drop("ns")


def with_ranks(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """Pages with the ranks written into ``rank1`` and ``rank2``."""
    return pages.drop("rank1", "rank2").join(ranks.select("id", "rank1", "rank2"), "id", "left")


def rank_sums(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum("rank1").alias("rank1"), F.sum("rank2").alias("rank2"))


#: Sides of a path search: the end of a link that each goes on from, and the one that it goes on to.
_SIDES = {"out": ("source_id", "target_id"), "in": ("target_id", "source_id")}


def shortest_paths(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source_id, target_id, hops, path`` of each distinct row of ``pairs(source_id, target_id)``: the path with the fewest links, of those
    the least by ids; null where there is none. From a page to itself it is that page alone.

    Searches go from both ends, for all pairs at once, and each round goes on at the side with fewer pages to go on from: one job, which writes the pages
    reached as ``(pair, id, met)``, and a count of its rows. Levels are never written again, and a page counts at its first. Once the sides of a pair
    meet, its levels are thinned to pages on shortest paths, each such page points to its least successor, and the path is read off. Null ends have no path.
    """
    asked = pairs.select("source_id", "target_id").distinct()
    tasks = cut(asked.where("source_id IS NOT NULL AND target_id IS NOT NULL").select(F.xxhash64("source_id", "target_id").alias("pair"), "source_id", "target_id"))
    apart = tasks.where("source_id <> target_id")
    links = links.select("source_id", "target_id").persist(StorageLevel.MEMORY_AND_DISK)
    levels = {side: [apart.select("pair", F.col(end).alias("id"))] for side, (end, _) in _SIDES.items()}
    sizes = dict.fromkeys(_SIDES, 1)
    meetings: list[DataFrame] = []
    while True:
        side = min(sizes, key=sizes.get)
        other = levels["in" if side == "out" else "out"][-1]
        begin, end = _SIDES[side]
        front = levels[side][-1].join(other.select("pair").distinct(), "pair", "left_semi")
        if meetings:
            front = front.join(reduce(DataFrame.unionByName, [m.select("pair") for m in meetings]), "pair", "left_anti")
        step = front.join(links, front.id == links[begin]).select("pair", F.col(end).alias("id")).distinct()
        step = step.join(reduce(DataFrame.unionByName, levels[side]), ["pair", "id"], "left_anti")
        # The newest level of one side can only meet the newest of the other: earlier ones would have met before.
        reached = cut(step.join(other.withColumn("met", F.lit(True)), ["pair", "id"], "left"))
        if not (n := reached.count()):
            break
        sizes[side] = n
        levels[side].append(reached.select("pair", "id"))
        at = [F.lit(len(levels[x]) - 1).alias(x) for x in ("out", "in")]
        meetings.append(reached.where("met").select("pair", "id", *at))
    none = tasks.where("source_id = target_id").select("pair", F.col("source_id").alias("id"), F.lit(0).alias("out"), F.lit(0).alias("in"))
    middle = reduce(DataFrame.unionByName, meetings, none)
    hops = cut(middle.select("pair", (F.col("out") + F.col("in")).alias("hops")).distinct())
    # Pages on shortest paths by their distance from the source: from the meeting pages back on either side.
    places = []
    for side, (begin, end) in _SIDES.items():
        later = None
        for level in range(len(levels[side]) - 1, -1, -1):
            here = middle.where(F.col(side) == level).select("pair", "id")
            if later is not None:
                before = later.join(links, later.id == links[end]).select("pair", F.col(begin).alias("id")).distinct()
                here = here.unionByName(before.join(levels[side][level], ["pair", "id"], "left_semi")).distinct()
            later = cut(here)
            places.append(later.join(hops, "pair").select("pair", "id", F.lit(level).alias("at") if side == "out" else (F.col("hops") - level).alias("at")))
    places = cut(reduce(DataFrame.unionByName, places).distinct())
    onward = places.join(links, places.id == links.source_id).select("pair", F.col("id").alias("tip"), (F.col("at") + 1).alias("at"), F.col("target_id").alias("id"))
    onward = cut(onward.join(places, ["pair", "at", "id"], "left_semi").groupBy("pair", "at", "tip").agg(F.min("id").alias("next")))
    links.unpersist()
    path = tasks.join(hops, "pair").select("pair", "source_id", "target_id", "hops", F.array("source_id").alias("path"), F.col("source_id").alias("tip"))
    for k in range(1, (hops.agg(F.max("hops")).first()[0] or 0) + 1):
        path = path.join(onward.where(F.col("at") == k).drop("at"), ["pair", "tip"], "left")
        path = path.select("pair", "source_id", "target_id", "hops", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"), F.coalesce("next", "tip").alias("tip"))
        path = cut(path) if k % 8 == 0 else path
    same = (asked.source_id.eqNullSafe(path.source_id)) & (asked.target_id.eqNullSafe(path.target_id))
    return asked.join(path, same, "left").select(asked.source_id, asked.target_id, F.col("hops").cast("int").alias("hops"), "path")


def shortest_path(pages: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """``path, hops, error``, one row: the least path (by ids) of the fewest links between two articles with these exact titles.

    Links of every namespace are followed (see ``shortest_paths``).
    """
    spark = pages.sparkSession
    found = {r["title"]: r["id"] for r in pages.where((F.col("ns") == ARTICLE) & F.col("title").isin(source, target)).groupBy("title").agg(F.min("id").alias("id")).collect()}
    schema = "path array<string>, hops int, error string"
    for title in (source, target):
        if title not in found:
            return spark.createDataFrame([(None, None, f"no article {title!r}")], schema)
    pair = spark.createDataFrame([(found[source], found[target])], "source_id long, target_id long")
    best = shortest_paths(links, pair).first()
    if best["path"] is None:
        return spark.createDataFrame([(None, None, "no path")], schema)
    steps = spark.createDataFrame(list(enumerate(best["path"])), "i int, id long")
    named = steps.join(pages.select("id", "title"), "id").agg(F.array_sort(F.collect_list(F.struct("i", "title"))).alias("s"))
    return named.select(F.col("s.title").alias("path"), (F.size("s") - 1).cast("int").alias("hops"), F.lit(None).cast("string").alias("error"))


def fill_redirects(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Pages where each redirect has its target's ``text_id``."""
    texts = pages.select(F.col("id").alias("target_id"), F.col("text_id").alias("filled"))
    filled = redirects.join(texts, "target_id").select(F.col("source_id").alias("id"), "filled")
    return pages.join(filled, "id", "left").withColumn("text_id", F.coalesce("filled", "text_id")).drop("filled").select(*pages.columns)
