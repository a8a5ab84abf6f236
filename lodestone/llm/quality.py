"""Quality rules with thresholds that follow the data (native: DataFrame functions only).

Each document gets counts from its whole text. Three ratios of them (symbols to word characters, repeated
lines to lines, characters to words) go into quantile sketches, one per language and source. A sketch is a
table of counts over logarithmic buckets of relative width ``RELATIVE_ERROR`` (the DDSketch rule), so sketches
merge by addition, in any order, with the same result: the sketches of a language and of everything are
sums of the finer ones. A fence is read off the sketch of the document's own language and source where that
has ``min_rows`` rows, else off its language's, else off the whole, and the documents are joined with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
RELATIVE_ERROR = 0.01
MIN_ROWS = 200
#: Hashes of rejected rows up to which they are broadcast.
LOST_ROWS = 2_000_000

#: ratio -> (spreads above the upper quartile, spreads below the lower quartile or None, least spread).
FENCES: dict[str, tuple[float, float | None, float]] = {
    "symbol_ratio": (3.0, None, 0.01),
    "dup_line_ratio": (3.0, None, 0.12),
    "word_length": (6.0, 6.0, 0.5),
}


def _longs(count: Column) -> Column:
    return count.cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a struct column ``__m`` of the counts of each whole text (null: as an empty text).

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines``,
    ``n_repeat_words``: words in a window of eight words that the text holds twice or more.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = docs.select(*keep, F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("__words"))
    # One hash for each window, of its words' hashes in order. (slice() would copy the whole array each time.)
    n = F.size("__words")
    hashed = words.select(*keep, "__words", F.transform("__words", lambda w: F.xxhash64(w)).alias("__w"))
    hashes = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)])),
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    counts = hashed.select(
        *keep,
        _longs(n).alias("__n"),
        _longs(F.length(F.array_join("__words", ""))).alias("__chars"),
        _longs(F.length(body) - F.length(F.regexp_replace(body, SYMBOL, ""))).alias("__symbols"),
        lines.alias("__lines"),
        hashes.alias("__h"),
    )
    # Only texts with a repeated window go on: their windows, sorted by hash, so that equal ones are neighbours.
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = counts.select(
        *keep, "__n", "__chars", "__symbols",
        _longs(F.size("__lines")).alias("__lines"),
        _longs(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("__dups"),
        F.when(repeated, pairs).alias("__p"),
    )
    p = F.col("__p")
    starts = F.sort_array(
        F.transform(
            F.filter(p, lambda e, i: F.get(p, i - 1)["h"].eqNullSafe(e["h"]) | F.get(p, i + 1)["h"].eqNullSafe(e["h"])),
            lambda e: e["i"],
        )
    )
    placed = found.select(*keep, "__n", "__chars", "__symbols", "__lines", "__dups", starts.alias("__s"))
    s = F.col("__s")
    gaps = F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)
    # explode() of one struct keeps a filter on the counts from being pushed into (and repeating) their computation.
    return placed.select(
        *keep,
        F.explode(F.array(F.struct(
            F.col("__n").alias("n_words"),
            F.col("__chars").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            F.col("__lines").alias("n_lines"),
            F.col("__dups").alias("n_dup_lines"),
            _longs(F.coalesce(F.when(s.isNotNull(), covered), F.lit(0))).alias("n_repeat_words"),
        ))).alias("__m"),
    )


def _ratios(m: str = "__m") -> dict[str, Column]:
    c = lambda name: F.col(f"{m}.{name}").cast("double")
    least = lambda x: F.greatest(x, F.lit(1.0))
    return {
        "symbol_ratio": c("n_symbols") / least(c("word_chars")),
        "dup_line_ratio": c("n_dup_lines") / least(c("n_lines")),
        "word_length": c("word_chars") / least(c("n_words")),
    }


def _failed(m: str = "__m") -> Column:
    n, r = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEATED_PERCENT * n)


def sketches(rows: DataFrame, groups: list[str], ratios: list[str], error: float = RELATIVE_ERROR) -> DataFrame:
    """``groups, ratio, bucket, n``: one mergeable quantile sketch for each group and ratio.

    Bucket b > 0 ... holds values in (g^(b-1), g^b], g = (1 + error) / (1 - error); zeros have a bucket of their own,
    below all others (null).
    """
    gamma = math.log((1 + error) / (1 - error))
    named = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in ratios]))
    long = rows.select(*groups, named.alias("x")).select(*groups, "x.ratio", "x.v")
    bucket = F.when(F.col("v") > 0, F.ceil(F.log("v") / gamma).cast("int"))
    return long.groupBy(*groups, "ratio", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups: sums of the finer ones' counts."""
    return sketch.groupBy(*groups, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str], error: float = RELATIVE_ERROR) -> DataFrame:
    """``groups, ratio, rows, q25, q75``: a value within the relative error of each quartile (lower rank)."""
    gamma = (1 + error) / (1 - error)
    by = Window.partitionBy(*groups, "ratio")
    upto = by.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    ranked = sketch.select(
        *groups, "ratio", F.sum("n").over(by).alias("rows"), F.sum("n").over(upto).alias("seen"), value.alias("v")
    )
    at = lambda q: F.min(F.when(F.col("seen") >= F.ceil(F.col("rows") * q), F.col("v")))
    return ranked.groupBy(*groups, "ratio").agg(F.max("rows").alias("rows"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def fences(rows: DataFrame, min_rows: int = MIN_ROWS, error: float = RELATIVE_ERROR) -> DataFrame:
    """``g_lang, g_source`` and a struct ``(low, high)`` for each ratio, from ``rows(g_lang, g_source, ratios)``."""
    fine = sketches(rows, ["g_lang", "g_source"], list(FENCES), error)
    lang = merged(fine, ["g_lang"])
    q_all = quartiles(merged(lang, []), [], error)
    q_lang, q_fine = quartiles(lang, ["g_lang"], error), quartiles(fine, ["g_lang", "g_source"], error)
    named = lambda q, tag, by: q.select(*by, "ratio", F.struct("rows", "q25", "q75").alias(tag))
    met = (
        named(q_fine, "s", ["g_lang", "g_source"]).alias("f")
        .join(named(q_lang, "l", ["g_lang"]).alias("l"), F.expr("f.g_lang <=> l.g_lang AND f.ratio = l.ratio"))
        .join(named(q_all, "a", []).alias("a"), F.expr("f.ratio = a.ratio"))
        .select("f.g_lang", "f.g_source", "f.ratio", "s", "l", "a")
    )
    used = F.when(F.col("s.rows") >= min_rows, F.col("s")).when(F.col("l.rows") >= min_rows, F.col("l")).otherwise(F.col("a"))
    met = met.withColumn("u", used)
    columns = []
    for ratio, (above, below, least) in FENCES.items():
        spread = F.greatest(F.col("u.q75") - F.col("u.q25"), F.lit(least))
        low = F.lit(float("-inf")) if below is None else F.col("u.q25") - below * spread
        pair = F.struct(low.alias("low"), (F.col("u.q75") + above * spread).alias("high"))
        columns.append(F.max(F.when(F.col("ratio") == ratio, pair)).alias(ratio))
    return met.groupBy("g_lang", "g_source").agg(*columns)


def _verdicts(rows: DataFrame, min_rows: int) -> DataFrame:
    """``rows(lang, source, __m, ...)`` plus ``__base_failed`` and ``__kept``."""
    ratios = _ratios()
    rows = rows.select("*", _failed().alias("__base_failed"), F.struct(*[v.alias(k) for k, v in ratios.items()]).alias("__r"))
    sampled = rows.where("not __base_failed").select(
        F.col("__lang").alias("g_lang"), F.col("__source").alias("g_source"), *[F.col(f"__r.{k}").alias(k) for k in ratios]
    )
    fence = fences(sampled, min_rows).select(F.col("g_lang").alias("__fl"), F.col("g_source").alias("__fs"), F.struct(*FENCES).alias("__f"))
    met = rows.join(fence, F.col("__lang").eqNullSafe(F.col("__fl")) & F.col("__source").eqNullSafe(F.col("__fs")), "left")
    within = F.lit(True)
    for k in ratios:
        within = within & F.coalesce(F.col(f"__r.{k}").between(F.col(f"__f.{k}.low"), F.col(f"__f.{k}.high")), F.lit(True))
    return met.select(*[c for c in rows.columns if c != "__r"], (~F.col("__base_failed") & within).alias("__kept"))


def judged(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_rows: int = MIN_ROWS, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all but the text) with ``__m`` (see ``measured``), ``__base_failed`` and ``__kept``.

    A document is kept if it passes the base rules and each of its ratios lies within its group's fence.
    Null languages and sources are groups like any other; a null or empty text has no words and fails the base rules;
    repeated rows are judged alike; an empty table gives an empty one. Only documents that pass the base rules are
    sketched, so that junk that is certain does not widen the fences. Other columns pass unchanged.
    The texts are read once: counts and carried columns are written to the shared folder, and sketches and
    verdicts read them from there.
    """
    names = [c for c in docs.columns if c != text] if carry is None else carry
    keep = [F.col(f"`{c}`") for c in names]
    groups = [F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source")]
    rows = measured(docs, text).select(*keep, *groups, "__m")
    return _verdicts(written(rows, "quality"), min_rows).select(*keep, "__m", "__base_failed", "__kept")


def kept(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with the columns of ``docs``.

    Texts are not written again: rows are known by a hash of what their verdict depends on, and the rejected ones
    (broadcast if they are few) are taken out of the table itself.
    """
    mark = F.xxhash64(F.col(f"`{text}`"), F.col(f"`{lang}`"), F.col(f"`{source}`"))
    again = F.xxhash64(F.lit(1), F.col(f"`{source}`"), F.col(f"`{text}`"), F.col(f"`{lang}`"))
    marked = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([lang, source, text])], mark.alias("__mark"), again.alias("__again"))
    lost = cut(judged(marked, lang, source, text, min_rows, carry=["__mark", "__again"]).where("not __kept").select("__mark", "__again").distinct())
    few = lost.count() <= LOST_ROWS
    out = docs.select("*", mark.alias("__mark"), again.alias("__again"))
    return out.join(F.broadcast(lost) if few else lost, ["__mark", "__again"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
