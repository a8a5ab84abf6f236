"""Quotation linking for chats and mails (native: DataFrame functions only).

A message's lines have quote levels (leading ``>`` marks, nested and spaced as mailers write them). Lines in a row at one level are a
passage. Quoted passages and their lines are normalised and hashed, and joined to the first earlier message of the conversation
that wrote that passage or line itself; lines link quotes that are trimmed or answered in between, passages those wrapped anew. Messages become replies to what they quote, conversations are put in reply order, and
the quotes are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, written

_MARKS = r"^(?:[ \t]*>)+"
_SEPARATOR = "\u001e"
#: Words of a line that links by itself; shorter ones ("yes", "thanks a lot") are written by anybody.
LINE_WORDS = 3


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` plus ``__own`` (the text without quoted lines), ``__quotes`` (``array<struct<level, hash, lines>>`` of quoted passages,
    ``lines``: hashes of their lines of ``LINE_WORDS`` or more) and ``__wrote`` (hashes of the passages and such lines at level 0)."""
    body = F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _SEPARATOR, " ")
    keep = [F.col(f"`{c}`") for c in messages.columns]
    marked = F.transform(
        F.split(body, "\n"), lambda x: F.struct(_level(x).cast("int").alias("level"), F.regexp_replace(x, _MARKS + r" ?", "").alias("line"))
    )
    rows = messages.select(*keep, marked.alias("__lines"))
    # A separator before each line whose level differs from the line's before; then a split gives the passages.
    number = F.transform(
        "__lines",
        lambda x, i: F.concat(
            F.when((i > 0) & (F.get(F.col("__lines"), i - 1)["level"] == x["level"]), F.lit("\n")).otherwise(F.concat(F.lit(_SEPARATOR), x["level"].cast("string"), F.lit("\n"))),
            x["line"],
        ),
    )
    rows = rows.select(*keep, "__lines", F.slice(F.split(F.array_join(number, ""), _SEPARATOR), 2, 1_000_000_000).alias("__parts"))
    part = F.transform(
        "__parts",
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).cast("int").alias("level"),
            _normal(F.regexp_replace(p, r"^\d+\n", "")).alias("words"),
            F.transform(F.split(F.regexp_replace(p, r"^\d+\n", ""), "\n"), _normal).alias("lines"),
        ),
    )
    rows = rows.select(*keep, "__lines", part.alias("__p"))
    long_enough = lambda x: F.size(F.split(x, " ")) >= LINE_WORDS
    hashes = F.transform(
        F.filter("__p", lambda p: p["words"] != ""),
        lambda p: F.struct(
            p["level"].alias("level"),
            F.xxhash64(p["words"]).alias("hash"),
            F.transform(F.filter(p["lines"], long_enough), lambda x: F.xxhash64(x)).alias("lines"),
        ),
    )
    rows = rows.select(*keep, "__lines", hashes.alias("__h"))
    own = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return rows.select(
        *keep,
        F.when(F.col(f"`{text}`").isNotNull(), own).alias("__own"),
        F.filter("__h", lambda p: p["level"] > 0).alias("__quotes"),
        F.array_distinct(F.flatten(F.transform(F.filter("__h", lambda p: p["level"] == 0), lambda p: F.concat(F.array(p["hash"]), p["lines"])))).alias("__wrote"),
    )


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, reply_to, reply_root, reply_depth, n_quotes, n_linked`` of every message.

    ``text`` has no quoted lines. ``reply_to`` is the earlier turn from which the message quotes most at level 1 (a whole passage counts
    one more than its lines; of equals the latest), else at the least deep level linked; null where it quotes none: it then follows its conversation. ``reply_root`` and ``reply_depth``
    follow the replies up; a conversation in reply order is ``(conv_id, reply_root, reply_depth, turn)``. A passage
    belongs to the first turn that wrote it. Null conversations are one conversation of their own, null turns neither quote nor are
    quoted, null texts stay null; repeated rows each have a row; an empty table gives an empty one.
    """
    rows = messages.select(
        F.coalesce(F.concat(F.lit("0"), F.col(f"`{conv}`").cast("string")), F.lit("1")).alias("c"),
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"),
    )
    rows = written(parsed(rows), "messages")
    # The original of a passage: its first turn, a partial minimum; so every join below has one row a key on its right.
    wrote = rows.where("turn is not null").select("c", "turn", F.explode("__wrote").alias("hash"))
    first = wrote.groupBy("c", "hash").agg(F.min("turn").alias("origin"))
    quotes = rows.where("turn is not null").select("c", "turn", F.explode("__quotes").alias("q")).select("c", "turn", "q.level", F.col("q.hash").alias("passage"), "q.lines").distinct()
    units = F.concat(F.array(F.struct(F.col("passage").alias("hash"), (F.size("lines") + 1).alias("weight"))), F.transform("lines", lambda x: F.struct(x.alias("hash"), F.lit(1).alias("weight"))))
    units = quotes.select("c", "turn", "level", "passage", F.explode(units).alias("u")).select("c", "turn", "level", "passage", "u.hash", "u.weight")
    met = units.join(first, ["c", "hash"]).where("origin < turn")
    # Sums by passage first, so that links of passages can be counted, then by origin.
    met = cut(met.groupBy("c", "turn", "level", "passage", "origin").agg(F.sum("weight").alias("weight")))
    most = met.groupBy("c", "turn", "level", "origin").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "weight", "origin"))
    n_linked = met.select("c", "turn", "level", "passage").distinct().groupBy("c", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    parents = cut(most.groupBy("c", "turn").agg(best["origin"].alias("reply_to")).join(n_linked, ["c", "turn"]))
    # Roots and depths by doubling: after k rounds each message knows its ancestor 2**k replies up.
    at = parents.select("c", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = at.select("c", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        joined = at.join(above, ["c", "up"], "left")
        moved = cut(joined.select("c", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("on")))
        going = not moved.where("on").isEmpty()
        at = moved.drop("on")
        if not going:
            break
    known = parents.join(at, ["c", "turn"]).select("c", "turn", "reply_to", "n_linked", F.col("up").alias("root"), "depth")
    out = rows.join(known, ["c", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("__own").alias("text"), "reply_to",
        F.coalesce("root", "turn").alias("reply_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("reply_depth"),
        F.size("__quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
