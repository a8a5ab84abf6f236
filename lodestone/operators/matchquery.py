"""Search queries with operators: what may be typed is a small tree, and its answer is set algebra over the matches of its phrases.

``a b`` and ``a AND b`` need both, ``a OR b`` either, ``a NOT b`` the first without the second; ``( )`` groups, ``"two words"`` is a phrase, ``one + two`` too, ``wor*`` any
word that begins so, ``^word`` one at a text's beginning, ``NEAR(a b, 5)`` phrases with at most 5 (by default 10) words between them. Words side by side bind more
tightly than NOT, that more than AND, that more than OR. A phrase without tokens in the index is left out beside others and matches nothing by itself.

Phrases of all queries are matched together; a query is then the list of ways to satisfy it, each a set of phrases that must be there and
one of phrases that must not, held against the phrases that a text has. So any number of queries is one plan, however they are built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKENIZERS
from ..storage import cut
from . import textindex
from .textindex import TextIndex

#: Ways to satisfy one query; more are refused.
MOST_WAYS = 1000
_NEAR = 10
_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()+*^,])|([\w\x1a\u0080-\U0010ffff]+))')


@dataclass(frozen=True)
class Phrase:
    """Words one after another; the last may be only a beginning, the first may have to open the text."""

    text: str
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Unit:
    """A phrase, or phrases near each other."""

    phrases: tuple[Phrase, ...]
    near: int | None = None


@dataclass(frozen=True)
class Node:
    """``kind``: "unit", "all" (side by side), "and", "or" or "not"."""

    kind: str
    parts: tuple = ()
    unit: Unit | None = None


class _Reader:
    """One query from left to right."""

    def __init__(self, query: str):
        self.query, self.tokens, at = query, [], 0
        while query[at:].strip():
            m = _TOKEN.match(query, at)
            if not m:
                raise ValueError(f"unexpected {query[at:].strip()[0]!r} in query {query!r}")
            kind = "string" if m[1] is not None else "mark" if m[2] is not None else "word"
            value = m[1][1:-1].replace('""', '"') if m[1] is not None else m[2] or m[3]
            self.tokens.append((value if kind == "word" and value in ("AND", "OR", "NOT") else kind, value))
            at = m.end()
        self.at = 0

    def peek(self, kind: str, value: str | None = None) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == kind and value in (None, self.tokens[self.at][1])

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.peek(kind, value):
            found = repr(self.tokens[self.at][1]) if self.at < len(self.tokens) else "the end"
            raise ValueError(f"{value or kind} expected instead of {found} in query {self.query!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def chain(self, word: str, below) -> Node:
        parts = [below()]
        while self.peek(word):
            self.take(word)
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(word.lower(), tuple(parts))

    def whole(self) -> Node:
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.side)))

    def side(self) -> Node:
        if self.peek("mark", "("):
            self.take("mark", "(")
            inner = self.whole()
            self.take("mark", ")")
            return inner
        units = [self.unit()]
        while self.peek("string") or self.peek("word") or self.peek("mark", "^"):
            units.append(self.unit())
        return Node("all", tuple(Node("unit", unit=u) for u in units))

    def unit(self) -> Unit:
        if self.peek("word", "NEAR") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("mark", "("):
            self.take("word")
            self.take("mark", "(")
            phrases = [self.phrase()]
            while self.peek("string") or self.peek("word") or self.peek("mark", "^"):
                phrases.append(self.phrase())
            near = _NEAR
            if self.peek("mark", ","):
                self.take("mark", ",")
                near = self.take("word")
                if not near.isdigit():
                    raise ValueError(f"a number expected instead of {near!r} in query {self.query!r}")
            self.take("mark", ")")
            return Unit(tuple(phrases), int(near)) if len(phrases) > 1 else Unit(tuple(phrases))
        return Unit((self.phrase(),))

    def phrase(self) -> Phrase:
        first = self.peek("mark", "^")
        if first:
            self.take("mark", "^")
        texts = [self.take("string" if self.peek("string") else "word")]
        while self.peek("mark", "+"):
            self.take("mark", "+")
            texts.append(self.take("string" if self.peek("string") else "word"))
        prefix = self.peek("mark", "*")
        if prefix:
            self.take("mark", "*")
        return Phrase(" ".join(texts), prefix, first)


def parse(query: str) -> Node:
    """The tree of a query; ``ValueError`` says what is wrong with one that has none."""
    reader = _Reader(query)
    tree = reader.whole()
    if reader.at < len(reader.tokens):
        reader.take("the end")
    return tree


@dataclass
class _Compiled:
    """A query's units, and the ways to satisfy it: units that must match, and units that must not."""

    units: list[Unit] = field(default_factory=list)
    ways: set[tuple[frozenset, frozenset]] = field(default_factory=set)


def _units(node: Node) -> list[Unit]:
    return [node.unit] if node.kind == "unit" else [u for p in node.parts for u in _units(p)]


def _ways(node: Node, wanted: bool, number: dict[Unit, int], void: set[int]) -> set[tuple[frozenset, frozenset]]:
    """Ways in which a node holds, or (not ``wanted``) does not; ``void`` units have no tokens."""
    if node.kind == "unit":
        i = number[node.unit]
        if i in void:
            return set() if wanted else {(frozenset(), frozenset())}
        return {(frozenset([i]), frozenset())} if wanted else {(frozenset(), frozenset([i]))}
    if node.kind == "all":
        parts = [(p, True) for p in node.parts if number[p.unit] not in void]
        if not parts:
            return set() if wanted else {(frozenset(), frozenset())}
        every = True
    elif node.kind == "not":
        parts = [(node.parts[0], True), *((p, False) for p in node.parts[1:])]
        every = True
    else:
        parts, every = [(p, True) for p in node.parts], node.kind == "and"
    each = [_ways(p, sign == wanted, number, void) for p, sign in parts]
    if every != wanted:  # any of them
        out = set().union(*each)
    else:
        out = {(frozenset(), frozenset())}
        for ways in each:
            out = {(a | c, b | d) for a, b in out for c, d in ways if not (a | c) & (b | d)}
            if len(out) > MOST_WAYS:
                raise ValueError(f"a query with more than {MOST_WAYS} ways to match")
    return out


def _leaves(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """``textindex.phrases`` of ``wanted``, with what tells them apart as their keys."""
    rows = wanted.withColumn("tag", F.concat_ws("|", "unit", "part", F.col("prefix").cast("int"), F.col("first").cast("int"), "key"))
    return textindex.phrases(rows.select(F.col("tag").alias("key"), F.col("text").alias("term")), index.kind)


def _narrowed(index: TextIndex, wanted: DataFrame) -> TextIndex:
    leaves = _leaves(index, wanted)
    return textindex.narrowed(index, leaves.where(~_by_beginning(index)), leaves.where(_by_beginning(index)))


def _found(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """``key, unit, part, doc_id, size, tokens, starts`` of the phrases ``wanted(key, unit, part, text, prefix, first)``."""
    leaves = _leaves(index, wanted)
    plain = textindex.sought(index, leaves.where(~_by_beginning(index)))
    columns = ["key", "tokens", "doc_id", "size", "place", "places"]
    met = plain.select(*columns)
    begun, held = textindex.small(leaves.where(_by_beginning(index)))
    if held is None or held:
        met = met.unionByName(index.postings.join(begun, F.col("term").startswith(F.col("token"))).select(*columns))
    # A token that is a beginning may meet many words of a text: their places together are its places.
    each = met.groupBy("key", "tokens", "doc_id", "place").agg(F.first("size").alias("size"), F.flatten(F.collect_list("places")).alias("places"))
    whole = each.groupBy("key", "tokens", "doc_id").agg(F.count(F.lit(1)).alias("hits"), F.first("size").alias("size"), F.collect_list(F.struct("place", "places")).alias("found"))
    whole = whole.where("hits = tokens").withColumn("starts", textindex.starts(F.col("found")))
    tag = F.split("key", r"\|", 5)
    whole = whole.select(tag[4].alias("key"), tag[0].cast("int").alias("unit"), tag[1].cast("int").alias("part"), (tag[3] == "1").alias("first"), "tokens", "doc_id", "size", "starts")
    whole = whole.withColumn("starts", F.when(F.col("first"), F.filter("starts", lambda s: s == 0)).otherwise(F.col("starts")))
    return whole.where(F.size("starts") > 0).drop("first")


def _by_beginning(index: TextIndex) -> F.Column:
    """Whether a phrase's token is looked up by how it begins: the last of a prefix phrase (all trigrams are of one length)."""
    if index.kind != "unicode":
        return F.lit(False)
    return (F.substring_index(F.substring_index("key", "|", 3), "|", -1) == "1") & (F.col("place") == F.col("tokens") - 1)


def answered(index: TextIndex, queries: DataFrame) -> DataFrame:
    """``key, doc_id, bm25`` (lower is better) of the texts that match each of ``queries(key, query)``; blank queries match nothing.

    A score counts the phrases that match and are not only excluded; near ones count where they are near. Raises ``ValueError`` for a query that is none.
    """
    spark = queries.sparkSession
    _, held = textindex.small(queries.select("key", "query"))
    if held is None:
        raise ValueError(f"more than {textindex.SMALL_ROWS} queries at once")
    trees = {r["key"]: parse(r["query"]) for r in held if (r["query"] or "").strip()}
    numbers = {k: {u: i for i, u in enumerate(dict.fromkeys(_units(t)))} for k, t in trees.items()}
    rows = [(k, i, j, p.text, p.prefix, p.first, u.near) for k, units in numbers.items() for u, i in units.items() for j, p in enumerate(u.phrases)]
    schema = "key string, unit int, part int, text string, prefix boolean, first boolean, near int"
    wanted = spark.createDataFrame(rows, schema)
    counts = wanted.select("key", "unit", F.size(TOKENIZERS[index.kind](F.col("text"))).alias("n")).groupBy("key", "unit").agg(F.min("n").alias("n"))
    void: dict[str, set[int]] = {}
    for r in counts.where("n = 0").collect():
        void.setdefault(r["key"], set()).add(r["unit"])
    ways = [(k, [(sorted(a), sorted(b)) for a, b in _ways(t, True, numbers[k], void.get(k, set()))]) for k, t in trees.items()]
    table = F.broadcast(spark.createDataFrame(ways, "key string, ways array<struct<need: array<int>, shun: array<int>>>"))
    sizes = F.broadcast(wanted.groupBy("key", "unit").agg(F.max("near").alias("near"), F.count(F.lit(1)).alias("parts")))
    index = _narrowed(index, wanted)
    found = cut(_found(index, F.broadcast(wanted)))
    holders = found.groupBy("key", "unit", "part").agg(F.count(F.lit(1)).alias("n"))
    units = found.groupBy("key", "unit", "doc_id").agg(F.first("size").alias("size"), F.collect_list(F.struct("part", "tokens", "starts")).alias("p")).join(sizes, ["key", "unit"])
    units = units.where(F.size("p") == F.col("parts"))
    # Near: some start is the last of all, and every phrase has one that ends at most so many tokens before it.
    within = lambda x, m: F.filter(x["starts"], lambda s: (s <= m) & (s >= m - x["tokens"] - F.col("near")))
    ends = F.filter(F.array_distinct(F.flatten(F.transform("p", lambda x: x["starts"]))), lambda m: F.forall("p", lambda x: F.size(within(x, m)) > 0))
    units = units.withColumn("ends", F.when(F.col("near").isNotNull(), ends)).where("near IS NULL OR size(ends) > 0")
    close = lambda x: F.array_distinct(F.flatten(F.transform("ends", lambda m: within(x, m))))
    parts = F.transform("p", lambda x: F.struct(x["part"].alias("part"), F.size(F.when(F.col("near").isNull(), x["starts"]).otherwise(close(x))).alias("f")))
    scored = units.select("key", "unit", "doc_id", "size", F.explode(parts).alias("x")).select("key", "unit", "doc_id", "size", "x.part", "x.f").join(holders, ["key", "unit", "part"])
    scored = scored.groupBy("key", "unit", "doc_id").agg(F.sum(textindex.score(F.col("f"), F.col("size"), F.col("n"), index)).alias("s"))
    has = scored.groupBy("key", "doc_id").agg(F.collect_list(F.struct("unit", "s")).alias("u")).join(table, "key").withColumn("have", F.transform("u", lambda x: x["unit"]))
    met = F.filter("ways", lambda w: (F.size(F.array_except(w["need"], F.col("have"))) == 0) & ~F.arrays_overlap(w["shun"], F.col("have")))
    needed = F.flatten(F.transform("met", lambda w: w["need"]))
    has = has.withColumn("met", met).where("size(met) > 0").withColumn("needed", needed)
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + F.when(F.array_contains(F.col("needed"), x["unit"]), x["s"]).otherwise(0.0))
    return has.select("key", "doc_id", total.alias("bm25"))
