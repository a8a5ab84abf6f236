"""Inverted indexes and BM25.

An index is a table of postings: a row for each term of each text, with the text's size, the term's count and its places. A phrase matches where
all its tokens stand one after another, so the places of its tokens, shifted by their own places in the phrase, have a start in common; of a
phrase's trigrams every third and the last are enough, as they cover its characters. Many queries run in one plan; every table of matches is keyed
by query. Scores need nothing but postings and two numbers. A stored index is sorted by term, so that the tokens of a few
queries, pushed to the scan, leave most row groups unread. An index that is not stored is made only for the tokens that are asked
(``narrowed``), in one pass over the texts that shuffles nothing; for the best pages of many queries the same pass counts their phrases (``looked``),
a row a text, so no places are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKENIZERS, lowered, unicode_tokens
from ..storage import cut

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Rows of a query set that are gathered and broadcast; larger sets are joined by shuffles.
SMALL_ROWS = 50_000
#: Distinct tokens that become a filter on the scan of the postings.
PUSHED = 500
#: Tokens of texts that are grouped at a time when postings are made.
_CHUNK_TOKENS = 1 << 20
POSTINGS = "term string, doc_id long, size int, n int, places array<int>"
_ARROW = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("places", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class TextIndex:
    """``postings`` (``POSTINGS``) of every text, and ``texts(doc_id, body)`` or what was ``counted`` in them: their number and all their tokens."""

    kind: str
    postings: DataFrame
    texts: DataFrame | None = None
    terms: DataFrame | None = None
    counted: tuple[int, int] | None = None

    @cached_property
    def _stats(self) -> tuple[int, int]:
        if self.counted is not None:
            return self.counted
        row = self.texts.agg(F.count(F.lit(1)).alias("n"), F.sum(_size(self.kind, F.coalesce("body", F.lit("")))).alias("t")).first()
        return row["n"], row["t"] or 0

    @property
    def n(self) -> int:
        return self._stats[0]

    @property
    def total(self) -> int:
        return self._stats[1]

    def vocabulary(self) -> DataFrame:
        """``term, doc, cnt``: texts that hold a term and its occurrences."""
        if self.terms is not None:
            return self.terms
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc"), F.sum("n").alias("cnt"))

    def save(self, folder: str) -> None:
        """Write the index; postings are sorted over ranges of (term, text), so a query reads few row groups and a common term fills many files."""
        spark = self.postings.sparkSession
        write_sorted(self.postings, f"{folder}/postings")
        stored = spark.read.parquet(f"{folder}/postings")
        n = self.counted[0] if self.counted else self.texts.count()
        total = stored.agg(F.sum("n")).first()[0] or 0
        TextIndex(self.kind, stored).vocabulary().repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
        spark.createDataFrame([(n, total)], "n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")

    def stored(self, folder: str) -> TextIndex:
        """The same index, written under ``folder`` and read from there."""
        self.save(folder)
        return load(self.postings.sparkSession, folder, self.kind)


def write_sorted(postings: DataFrame, path: str) -> None:
    rows = postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _size(kind: str, body: Column) -> Column:
    """Tokens of a text."""
    return F.size(unicode_tokens(body)) if kind == "unicode" else F.greatest(F.length(lowered(body)) - 2, F.lit(0))


def small(rows: DataFrame) -> tuple[DataFrame, list | None]:
    """Rows of a query set: gathered and marked for broadcast, with a list of them, if at most ``SMALL_ROWS``; else as they are, and None."""
    held = rows.limit(SMALL_ROWS + 1).collect()
    if len(held) > SMALL_ROWS:
        return rows, None
    return F.broadcast(rows.sparkSession.createDataFrame(held, rows.schema)), held


def _grouped(ids: pa.Array, lengths: np.ndarray, doc: np.ndarray, place: np.ndarray, codes: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Postings of a few texts from their tokens, each given by its text, place and code."""
    key = doc * max(1, len(names)) + codes
    order = np.argsort(key, kind="stable")
    key, place, doc = key[order], place[order], doc[order]
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    counts = np.diff(first, append=len(key))
    offsets = pa.array(np.append(first, len(key)).astype(np.int32))
    columns = [
        names.take(pa.array(key[first] % max(1, len(names)))), ids.take(pa.array(doc[first])), pa.array(lengths[doc[first]], pa.int32()),
        pa.array(counts, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_ARROW)


def _sizes(ids: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    """A row without a term for each text, with its size."""
    n = len(ids)
    none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), ids, pa.array(lengths, pa.int32()), pa.array(np.zeros(n, np.int32)), none], schema=_ARROW)


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place of each token of texts with so many."""
    return np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with some ``_CHUNK_TOKENS`` each, at least one."""
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > _CHUNK_TOKENS:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _words(batches: Iterable[pa.RecordBatch], tokens: list[str] | None = None, beginnings: Iterable[str] = ()) -> Iterator[pa.RecordBatch]:
    """Postings of ``doc_id, tokens``; of the given ``tokens`` and those with such ``beginnings`` alone, and sizes, if these are given."""
    for batch in batches:
        each = batch.column(1)
        for a, b in _pieces(pc.list_value_length(each).to_numpy()):
            part, ids = each.slice(a, b - a), batch.column(0).slice(a, b - a)
            kinds = part.flatten().dictionary_encode()
            lengths, codes = pc.list_value_length(part).to_numpy().astype(np.int64), kinds.indices.to_numpy().astype(np.int64)
            doc, place = _places(lengths)
            if tokens is not None:
                keep = pc.is_in(kinds.dictionary, value_set=pa.array(tokens, pa.string()))
                for start in beginnings:
                    keep = pc.or_(keep, pc.starts_with(kinds.dictionary, start))
                at = np.nonzero(keep.to_numpy(zero_copy_only=False)[codes])[0] if len(codes) else codes
                doc, place, codes = doc[at], place[at], codes[at]
                yield _sizes(ids, lengths)
            yield _grouped(ids, lengths, doc, place, codes, kinds.dictionary)


_HASHED = np.uint64(0x9E3779B97F4A7C15)


def _spots(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``codes`` that are among the sorted ``wanted``: a table of hashes leaves few to look up."""
    short = lambda x: (x.astype(np.uint64) * _HASHED) >> np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[short(wanted)] = True
    at = np.nonzero(table[short(codes)])[0]
    near = np.minimum(np.searchsorted(wanted, codes[at]), max(0, len(wanted) - 1))
    return at[wanted[near] == codes[at]] if len(wanted) else at[:0]


def _threes(batches: Iterable[pa.RecordBatch], tokens: list[str] | None = None, beginnings: Iterable[str] = ()) -> Iterator[pa.RecordBatch]:
    """Postings of the trigrams of ``doc_id, text``; of the given ``tokens`` alone, and sizes, if these are given."""
    coded = lambda c: c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    letters = lambda text: np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wanted = None if tokens is None else np.array(sorted(int(coded(letters(t))[0]) for t in set(tokens)), np.int64)
    for batch in batches:
        texts = batch.column(1)
        for a, b in _pieces(pc.utf8_length(texts).to_numpy()):
            part, ids = texts.slice(a, b - a), batch.column(0).slice(a, b - a)
            lengths = pc.utf8_length(part).to_numpy().astype(np.int64)
            chars = letters("".join(part.to_pylist()))
            n, ends = np.maximum(lengths - 2, 0), np.cumsum(lengths)
            every = coded(chars) if len(chars) > 2 else chars[:0]
            if wanted is None:
                doc, place = _places(n)
                every = every[np.repeat(ends - lengths, n) + place]
            else:
                at = _spots(every, wanted)
                doc = np.searchsorted(ends, at, side="right")
                whole = at + 2 < ends[doc]  # not over the end of a text
                at, doc = at[whole], doc[whole]
                place, every = at - (ends - lengths)[doc], every[at]
                yield _sizes(ids, n)
            found, codes = np.unique(every, return_inverse=True)
            split = np.column_stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF]).astype("<u4")
            names = split.tobytes().decode("utf-32-le", "surrogatepass")
            yield _grouped(ids, n, doc, place, codes.astype(np.int64), pa.array([names[i : i + 3] for i in range(0, len(names), 3)], pa.string()))


def postings(texts: DataFrame, kind: str, tokens: list[str] | None = None, beginnings: Iterable[str] = ()) -> DataFrame:
    """``POSTINGS`` of ``texts(doc_id, body)``: at most a row for each distinct term of a text.

    With ``tokens`` only theirs and those of words with such ``beginnings``, and beside them a row for each text with its size and no term.
    """
    body = F.coalesce("body", F.lit(""))
    made, each = (unicode_tokens(body), _words) if kind == "unicode" else (lowered(body), _threes)
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("made"))
    return rows.mapInArrow(lambda batches: each(batches, tokens, beginnings), POSTINGS)


def build(texts: DataFrame, kind: str) -> TextIndex:
    """The index of ``texts(doc_id, body)``; a null body counts as an empty one."""
    return TextIndex(kind, postings(texts, kind), texts)


def narrowed(index: TextIndex, tokens: DataFrame, beginnings: DataFrame | None = None) -> TextIndex:
    """An index of all texts that holds what is asked: postings of these ``token`` rows, and of words with such beginnings.

    A stored index is as it is. The texts are read once; a row of each with its size gives the statistics, which are those of the whole index.
    """
    if index.texts is None:
        return index
    asked = [None if rows is None else small(rows.select("token").distinct())[1] for rows in (tokens, beginnings)]
    if asked[0] is None or (beginnings is not None and asked[1] is None):
        return index
    names, starts = (sorted({r["token"] for r in rows or []}) for rows in asked)
    rows = cut(postings(index.texts, index.kind, names, starts))
    row = rows.where("term IS NULL").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).first()
    return TextIndex(index.kind, rows.where("term IS NOT NULL"), None, None, (row["n"], row["t"] or 0))


def load(spark, folder: str, kind: str) -> TextIndex:
    row = spark.read.parquet(f"{folder}/stats").first()
    return TextIndex(kind, spark.read.parquet(f"{folder}/postings"), None, spark.read.parquet(f"{folder}/terms"), (row["n"], row["total"]))


def phrases(terms: DataFrame, kind: str) -> DataFrame:
    """``key, phrase, tokens, place, token`` of each term ``key, term``: what is looked up for it in an index of this kind."""
    rows = terms.select("key", F.col("term").alias("phrase"), TOKENIZERS[kind](F.col("term")).alias("t"))
    every = F.transform("t", lambda t, i: F.struct(i.alias("place"), t.alias("token")))
    if kind == "trigram":
        every = F.filter(every, lambda x: (x["place"] % 3 == 0) | (x["place"] == F.size("t") - 1))
    rows = rows.select("key", "phrase", every.alias("e"))
    return rows.select("key", "phrase", F.size("e").alias("tokens"), F.explode("e").alias("x")).select("key", "phrase", "tokens", "x.place", "x.token")


def sought(index: TextIndex, phrases: DataFrame) -> DataFrame:
    """Postings of ``phrases``' tokens beside them; a few tokens become a filter on the scan."""
    wanted, held = small(phrases)
    rows = index.postings
    tokens = None if held is None else {row["token"] for row in held}
    if tokens is not None and len(tokens) <= PUSHED:
        rows = rows.where(F.col("term").isin(sorted(tokens)))
    return rows.join(wanted, F.col("term") == F.col("token"))


def starts(found: Column) -> Column:
    """The starts that tokens ``array<struct<place, places>>`` of a phrase have in common."""
    shifted = lambda x: F.transform(x["places"], lambda p: p - x["place"])
    rest = F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))
    return F.aggregate(rest, shifted(F.element_at(found, 1)), lambda a, x: F.array_intersect(a, shifted(x)))


def matches(index: TextIndex, terms: DataFrame) -> DataFrame:
    """``key, phrase, doc_id, f, size``: how often each text holds each term of ``terms(key, term)`` as a phrase, and its tokens."""
    return matched(index, phrases(terms, index.kind))


def matched(index: TextIndex, tokens: DataFrame) -> DataFrame:
    """``matches`` of the terms whose ``phrases`` are given."""
    met = sought(index, tokens)
    alone = met.where("tokens = 1").select("key", "phrase", "doc_id", F.col("n").cast("long").alias("f"), "size")
    several = met.where("tokens > 1").groupBy("key", "phrase", "tokens", "doc_id").agg(
        F.count(F.lit(1)).alias("hits"), F.first("size").alias("size"), F.collect_list(F.struct("place", "places")).alias("found")
    )
    several = several.where("hits = tokens").select("key", "phrase", "doc_id", F.size(starts(F.col("found"))).cast("long").alias("f"), "size")
    return alone.unionByName(several.where("f > 0"))


def _mean(index: TextIndex | Looked) -> float:
    return index.total / index.n if index.n and index.total else 1.0


def score(f: Column, size: Column, n: Column, index: TextIndex) -> Column:
    """A phrase's part of a text's BM25 (negative), with ``n`` texts that hold it."""
    raw = F.log((F.lit(float(index.n)) - n + 0.5) / (n + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
    return -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.lit(_mean(index))))


def bm25(index: TextIndex, terms: DataFrame, mode: str) -> DataFrame:
    """``key, doc_id, bm25`` (lower is better) of the texts that match.

    ``mode``: "and" needs every term, and one without tokens matches nothing; "or" needs any; "bare" needs every term that has tokens.
    Statistics are over all texts of the index.
    """
    terms, _ = small(terms)
    index = narrowed(index, phrases(terms, index.kind))
    found = cut(matches(index, terms))
    counts = found.groupBy("key", "phrase").agg(F.count(F.lit(1)).alias("n"))
    scored = found.join(counts, ["key", "phrase"])
    scored = scored.select("key", "doc_id", score(F.col("f"), F.col("size"), F.col("n"), index).alias("s"))
    totals = scored.groupBy("key", "doc_id").agg(F.sum("s").alias("bm25"), F.count(F.lit(1)).alias("met"))
    if mode == "or":
        return totals.drop("met")
    has_tokens = F.size(TOKENIZERS[index.kind](F.col("term"))) > 0
    counted = terms.where(has_tokens) if mode == "bare" else terms
    needed = counted.groupBy("key").agg(F.count(F.lit(1)).alias("needed"))
    return totals.join(needed, "key").where(F.col("met") == F.col("needed")).select("key", "doc_id", "bm25")


def _best_here(batches: Iterable[pa.RecordBatch], groups: list[list[int]], idf: np.ndarray, mean: float, every: bool, k: int) -> Iterator[pa.RecordBatch]:
    """``group, id, bm25``: each group's best pages of a batch ``id, size, held``, ``held`` being the phrases of the page's text and their counts."""
    for batch in batches:
        ids, size, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        phrase, f = (x.to_numpy() for x in held.flatten().flatten())
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(held).to_numpy())
        s = -idf[phrase] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[row] / mean))
        order = np.argsort(phrase, kind="stable")
        row, s = row[order], s[order]
        bounds = np.searchsorted(phrase[order], np.arange(len(idf) + 1)).tolist()
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for group, members in enumerate(groups):
            ranges = [slice(bounds[m], bounds[m + 1]) for m in members if bounds[m] < bounds[m + 1]]
            if not ranges or (every and len(ranges) < len(members)):
                continue
            if len(ranges) == 1:
                at, total = row[ranges[0]], s[ranges[0]]
            else:
                total, met = np.zeros(len(ids)), np.zeros(len(ids), np.int32)
                for part in ranges:
                    total[row[part]] += s[part]
                    met[row[part]] += 1
                at = np.nonzero(met == len(members) if every else met)[0]
                total = total[at]
            if len(at) > k:
                near = total <= np.partition(total, k - 1)[k - 1]
                at, total = at[near], total[near]
                first = np.lexsort((ids[at], total))[:k]
                at, total = at[first], total[first]
            if len(at):
                out.append((group, ids[at], total))
        if out:
            number = np.repeat([g for g, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([x for _, x, _ in out])), pa.array(np.concatenate([t for _, _, t in out]))], names=["group", "id", "bm25"])


_SPACES = " \t\n\v\f\r"


def _patterns(kind: str, term: Column) -> Column:
    """The tokens in a row that a term stands for; of a trigram index the term itself, which its trigrams cover. None for a term without tokens."""
    if kind == "unicode":
        return unicode_tokens(term)
    return F.when(F.length(lowered(term)) > 2, F.array(lowered(term))).otherwise(F.array().cast("array<string>"))


class _InWords:
    """The patterns inside words, and how often (they may overlap); what is known of a word is kept for the next batch."""

    MOST = 1 << 18

    def __init__(self, patterns: dict[str, int]):
        self.patterns, self.known = patterns, {}
        self.lengths: dict[str, list[int]] = {}
        for start, n in sorted({(p[:3], len(p)) for p in patterns}):
            self.lengths.setdefault(start, []).append(n)

    def __getitem__(self, word: str) -> list[tuple[int, int]]:
        found = self.known.get(word)
        if found is None:
            counts: dict[int, int] = {}
            for i in range(len(word) - 2):
                for n in self.lengths.get(word[i : i + 3], ()):
                    number = self.patterns.get(word[i : i + n]) if i + n <= len(word) else None
                    if number is not None:
                        counts[number] = counts.get(number, 0) + 1
            found = list(counts.items())
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[word] = found
        return found


def _summed(doc: np.ndarray, phrase: np.ndarray, f: np.ndarray, phrases: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's phrases once, with all their counts, by text."""
    key = doc * max(1, phrases) + phrase
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    key, f = key[first], np.add.reduceat(f[order], first) if len(first) else f[:0]
    return key // max(1, phrases), key % max(1, phrases), f


def _in_row(doc: np.ndarray, codes: np.ndarray, number: dict[str, int], rows: dict[tuple[str, ...], int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``doc, phrase, f`` of the phrases of several tokens that stand in a row."""
    for tokens, phrase in rows.items():
        wanted = [number.get(t, -1) for t in tokens]
        if min(wanted) < 0 or len(codes) < len(wanted):
            continue
        n = len(codes) - len(wanted) + 1
        at = np.nonzero(codes[:n] == wanted[0])[0]
        for i, code in enumerate(wanted[1:], 1):
            at = at[codes[at + i] == code]
        at = at[doc[at] == doc[at + len(wanted) - 1]]
        yield doc[at], np.full(len(at), phrase), np.ones(len(at), np.int64)


_HELD = pa.list_(pa.struct([("phrase", pa.int32()), ("f", pa.int64())]))


def _looked(batches: Iterable[pa.RecordBatch], kind: str, patterns: list[tuple[str, ...]]) -> Iterator[pa.RecordBatch]:
    """``doc_id, size, held`` of each of ``doc_id, made`` (tokens, or a lower-case text): the phrases in it and how often."""
    single = {p[0]: i for i, p in enumerate(patterns) if len(p) == 1}
    rows = {p: i for i, p in enumerate(patterns) if len(p) > 1}
    spaced = {p: i for p, i in single.items() if any(c in p for c in _SPACES)} if kind == "trigram" else {}
    inside = _InWords({p: i for p, i in single.items() if p not in spaced})
    for batch in batches:
        made = batch.column(1)
        lengths = (pc.list_value_length(made) if kind == "unicode" else pc.utf8_length(made)).to_numpy().astype(np.int64)
        for a, b in _pieces(lengths):
            part, ids = made.slice(a, b - a), batch.column(0).slice(a, b - a)
            words = part if kind == "unicode" else pc.ascii_split_whitespace(part)
            coded = words.flatten().dictionary_encode()
            doc, _ = _places(pc.list_value_length(words).to_numpy().astype(np.int64))
            codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            holds = [inside[w] for w in names] if kind == "trigram" else [[(single[w], 1)] if w in single else [] for w in names]
            many = np.array([len(h) for h in holds], np.int64)
            flat = np.array([x for h in holds for x in h], np.int64).reshape(-1, 2)
            some = np.nonzero(many[codes])[0] if len(codes) else codes
            at, code, f = _summed(doc[some], codes[some], np.ones(len(some), np.int64), len(names))
            row, place = _places(many[code])
            place += (np.cumsum(many) - many)[code][row]
            found = [(at[row], flat[place, 0], flat[place, 1] * f[row])]
            if rows:
                found.extend(_in_row(doc, codes, {w: i for i, w in enumerate(names)}, rows))
            for p, number in spaced.items():
                often = np.array([sum(text.startswith(p, i) for i in range(len(text))) if p in text else 0 for text in part.to_pylist()], np.int64)
                found.append((np.nonzero(often)[0], np.full(np.count_nonzero(often), number), often[often > 0]))
            at, phrase, f = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)), len(patterns))
            ends = np.searchsorted(at, np.arange(b - a + 1)).astype(np.int32)
            held = pa.StructArray.from_arrays([pa.array(phrase, pa.int32()), pa.array(f, pa.int64())], fields=list(_HELD.value_type))
            size = lengths[a:b] if kind == "unicode" else np.maximum(lengths[a:b] - 2, 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), held, type=_HELD)], names=["doc_id", "size", "held"])


@dataclass(frozen=True)
class Looked:
    """Terms looked up in an index: ``rows(doc_id, size, held)`` of the texts, ``held`` being the numbers of the phrases in a text and how often. ``number`` of a term,
    None for one without tokens; ``stands``, of one that is a token as it stands; ``counts``, the texts that hold each."""

    rows: DataFrame
    number: dict[str, int | None]
    stands: dict[str, int]
    counts: np.ndarray
    n: int
    total: int

    def vocabulary(self) -> DataFrame:
        """``term, doc`` of the terms that are tokens of some text as they stand."""
        known = [(t, int(self.counts[i])) for t, i in self.stands.items() if self.counts[i]]
        return self.rows.sparkSession.createDataFrame(known, "term string, doc long")


def looked(index: TextIndex | Looked, terms: DataFrame) -> Looked | TextIndex:
    """What an index holds of the ``term`` rows, in one pass over the texts or the stored postings; the index as it is, if terms are more than ``SMALL_ROWS``."""
    if isinstance(index, Looked):
        return index
    _, held = small(terms.select("term").distinct())
    if held is None:
        return index
    spark = terms.sparkSession
    asked = spark.createDataFrame(held, "term string").select("term", _patterns(index.kind, F.col("term")).alias("p")).collect()
    numbers: dict[tuple[str, ...], int] = {}
    number = {r["term"]: numbers.setdefault(tuple(r["p"]), len(numbers)) if r["p"] else None for r in asked}
    stands = {t: numbers.setdefault((t,), len(numbers)) for t in number} if index.kind == "unicode" else {}
    patterns = list(numbers)
    if index.texts is None:
        parts = [(str(i), " ".join(p), _tokens_of(index.kind, p)) for i, p in enumerate(patterns)]
        tokens = [(key, phrase, len(each), *x) for key, phrase, each in parts for x in each]
        tokens = spark.createDataFrame(tokens, "key string, phrase string, tokens int, place int, token string")
        found = matched(index, tokens).select(F.col("key").cast("int").alias("phrase"), "f", "doc_id", "size")
        rows = cut(found.groupBy("doc_id").agg(F.first("size").alias("size"), F.collect_list(F.struct("phrase", "f")).alias("held")))
        n, total = index.n, index.total
    else:
        body = F.coalesce("body", F.lit(""))
        made = unicode_tokens(body) if index.kind == "unicode" else lowered(body)
        kind = index.kind
        texts = index.texts.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("made"))
        rows = cut(texts.mapInArrow(lambda batches: _looked(batches, kind, patterns), "doc_id long, size int, held array<struct<phrase: int, f: bigint>>"))
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).first()
        n, total = row["n"], row["t"] or 0
        rows = rows.where(F.size("held") > 0)
    counts = np.zeros(len(patterns))
    for r in rows.select(F.explode("held.phrase").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["phrase"]] = r["n"]
    return Looked(rows, number, stands, counts, n, total)


def _tokens_of(kind: str, pattern: tuple[str, ...]) -> list[tuple[int, str]]:
    """``place, token`` of what is looked up for a pattern in stored postings (see ``phrases``)."""
    if kind == "unicode":
        return list(enumerate(pattern))
    last = len(pattern[0]) - 3
    return [(i, pattern[0][i : i + 3]) for i in range(last + 1) if i % 3 == 0 or i == last]


def best(index: TextIndex | Looked, terms: DataFrame, mode: str, k: int, pages: DataFrame) -> DataFrame:
    """``key, id, bm25``: for each key the ``k`` best (then least) of ``pages(doc_id, id)`` whose texts match, as ``bm25`` has them.

    Each term is looked up once, however many keys have it, and keys with the same terms are one group. The phrases of a text come together in one row, and a task
    scores all groups over its texts and leaves each group's best, so what is shuffled grows with texts and with groups, not with their product.
    """
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("bm25", "id"))
    first = lambda rows, by: rows.withColumn("__r", place(by)).where(F.col("__r") <= k).drop("__r")
    _, held = small(terms.select("key", "term").distinct())
    index = index if held is None else looked(index, terms)
    if held is None or isinstance(index, TextIndex):
        return first(bm25(index, terms, mode).join(pages, "doc_id").select("key", "id", "bm25"), "key")
    by_key: dict[str, set[int | None]] = {}
    for r in held:
        by_key.setdefault(r["key"], set()).add(index.number[r["term"]])
    asked: dict[tuple[int, ...], int] = {}
    keys = []
    for key, members in by_key.items():
        found = tuple(sorted(members - {None}))
        if found and (mode != "and" or None not in members):
            keys.append((key, asked.setdefault(found, len(asked))))
    raw = np.log(np.maximum(index.n - index.counts + 0.5, 0.5) / (index.counts + 0.5))
    idf, groups, mean, every = np.where(raw > 0, raw, LEAST_IDF), [list(g) for g in asked], _mean(index), mode != "or"
    here = index.rows.join(pages.select("doc_id", "id"), "doc_id").select("id", "size", "held")
    here = here.mapInArrow(lambda batches: _best_here(batches, groups, idf, mean, every, k), "group int, id long, bm25 double")
    grouped = terms.sparkSession.createDataFrame(keys, "key string, group int")
    return first(here, "group").join(F.broadcast(grouped), "group").select("key", "id", "bm25")
