"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

A text is normalised to its words, lower-cased (A-Z) and joined by single spaces, with one at either end; so is each
window of a benchmark item, which makes a match of the automaton a match of whole words. A text is scanned once; the
ends of matches become word numbers by a search among the words' ends, and words become offsets in the original text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 8
MIN_ITEMS = 2
#: Windows in one automaton (about 1 GB of memory at most); a larger benchmark is scanned with several, one after another.
MAX_WINDOWS = 1_000_000

#: Bytes to lower-case words and spaces: A-Z to a-z, other ASCII but digits and letters to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text (null: none) as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows_of(words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    """An item's windows: each run of ``WINDOW`` words; a shorter item, but for an empty one, is a window itself."""
    for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
        yield tuple(words[i : i + WINDOW])


class Scanner:
    """One automaton over the windows of some items, and what it finds in a text."""

    def __init__(self, items: Iterable[tuple[str, str | None]]):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for window in windows_of(words_of(text)):
                owners[window].add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word((b" " + b" ".join(window) + b" ").decode("latin-1"), (len(window), tuple(sorted(ids))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, merged ranges of hit words, ids of the items found."""
        words = words_of(text)
        if not words or self.empty:
            return len(words), [], set()
        matches = list(self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
        if not matches:
            return len(words), [], set()
        ends = list(accumulate(len(w) + 1 for w in words))
        ranges, found = [], set()
        for end, (length, ids) in matches:
            last = bisect.bisect_left(ends, end)
            ranges.append((last - length + 1, last + 1))
            found.update(ids)
        return len(words), merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges as sorted disjoint ones."""
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of its words."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    chars = lambda n: len(raw[:n].decode("utf-8", "surrogatepass"))
    return [(chars(places[a][0]), chars(places[b - 1][1])) for a, b in ranges]


def _parts(benchmark: DataFrame, item: str, text: str) -> list[list[tuple[str, str | None]]]:
    """The benchmark's items in parts of at most ``MAX_WINDOWS`` windows (a longer item is a part of its own)."""
    parts, count = [[]], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")), F.col(f"`{text}`"))
    for key, body in rows.toLocalIterator():
        n = len(words_of(body))
        if parts[-1] and count + n > MAX_WINDOWS:
            parts.append([])
            count = 0
        parts[-1].append((key, body))
        count += n
    return parts


_scanners: dict[str, Scanner] = {}


def _scanner(name: str, items) -> Scanner:
    """This worker's automaton for a broadcast; only the latest is kept."""
    if name not in _scanners:
        _scanners.clear()
        _scanners[name] = Scanner(items.value)
    return _scanners[name]


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` plus ``__scan``: ``n_words``, ``n_hit`` (words in any occurrence of a window), ``items`` (sorted ids of the
    items with occurring windows) and ``spans`` (character ranges of hit words in the original text).

    Null and empty texts have no words and no hits, in documents and in items; an item without words is never found; a
    null item id reads "null"; repeated items count once; each document row is judged by itself; other columns pass
    unchanged. The driver reads the benchmark, a fixed test suite, and sends it out in parts of bounded size.
    """
    spark = docs.sparkSession
    names = docs.columns
    out = docs
    for part in _parts(benchmark, item, item_text):
        key = hashlib.sha256(repr(part).encode("utf-8", "surrogatepass")).hexdigest()
        sent = spark.sparkContext.broadcast(part)
        schema = T.StructType([*docs.schema.fields, T.StructField("__scan", RESULT)])
        arrow = pa.struct(
            [
                ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ]
        )
        at = names.index(text)

        def scan(batches: Iterable[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(key, sent)
            for batch in batches:
                found = []
                earlier = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * batch.num_rows
                for row, old in zip(batch.column(at), earlier, strict=True):
                    body = row.as_py()
                    n, ranges, items = scanner.scan(body)
                    spans = offsets(body, ranges) if ranges else []
                    hit = sum(b - a for a, b in ranges)
                    if old and old["spans"]:
                        spans = merged([*spans, *[(s["start"], s["stop"]) for s in old["spans"]]])
                        hit = sum(len(words_of(body[a:b])) for a, b in spans)
                        items = items | set(old["items"])
                    found.append({"n_words": n, "n_hit": hit, "items": sorted(items), "spans": [{"start": a, "stop": b} for a, b in spans]})
                columns = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow)], names=[*names, "__scan"])

        out = out.mapInArrow(scan, schema)
    return out


def contaminated() -> F.Column:
    """Whether a scanned row holds windows of ``MIN_ITEMS`` items or more."""
    return F.size("__scan.items") >= MIN_ITEMS
