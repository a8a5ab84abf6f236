"""Licence scans with a generalised suffix automaton of licence tokens.

Templates, phrases and names (``licence_texts``) are sequences of words. The automaton holds every run of words of every one of them; streaming a text
through it gives its matching statistics: at each word, the longest run ending there that some template holds. Long runs
that are not part of longer ones are chained, for the templates that hold all of such a run, into spans, and a template's share of words
covered by its best span, of its own words and those put in between, is its coverage. A name inside a longer name is part of that one (CC BY-NC of
CC BY-NC-SA), and so is a clause or text inside a longer text; the phrases that are counted keep their labels wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .licence_texts import CLAUSES, PHRASES, TELLING, TEMPLATES, names

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

NAMES = names()
#: Words of the shortest match that is chained, words of text or template between chained matches, least coverage of a label.
MIN_MATCH = 3
MAX_GAP = 8
MIN_COVERAGE = 0.5

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("stop", T.LongType()),
                        T.StructField("coverage", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())]))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text (null: none) as UTF-8, A-Z lower-cased, cut at ASCII characters other than letters and digits."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


@dataclass
class Automaton:
    """A suffix automaton of several sequences of numbers, with the places of each state's runs."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Of each state, (sequence, end) of the prefixes that it was made for.
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the runs of ``q`` that are no longer than those reached from ``p``."""
        new = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _grow(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, number: int, sequence: list[int]) -> None:
        state = 0
        for i, c in enumerate(sequence):
            state = self._grow(state, c)
            self.ends[state].append((number, i + 1))

    def finish(self) -> None:
        """Give every state the ends of the states that extend its runs to the left, so that it knows all its runs' places."""
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])

    def statistics(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """At each element, the state and the length of the longest run of any sequence that ends there."""
        state, n = 0, 0
        for c in sequence:
            while state and c not in self.step[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.step[state]:
                state, n = self.step[state][c], n + 1
            else:
                state, n = 0, 0
            yield state, n


def _outermost(spans: list[dict]) -> list[dict]:
    """``spans`` without those that lie inside a longer one."""
    out: list[dict] = []
    last, end = None, -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["stop"] > end or (s["start"], s["stop"]) == last:
            out.append(s)
            last, end = (s["start"], s["stop"]), s["stop"]
    return out


class Scanner:
    """Phrases, names, templates and clauses in one automaton, and what it finds in a text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], names: dict[str, str] | None = None, telling: str = TELLING, clauses: dict[str, Iterable[str]] | None = None):
        self.numbers: dict[bytes, int] = {}
        self.n_base, self.telling = len(phrases), set(words_of(telling))
        phrases = {**phrases, **(names or {})}
        number = lambda text: [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
        self.phrases = [(number(p), label) for p, label in phrases.items()]
        texts = [*templates.items(), *[(label, c) for label, some in (clauses or {}).items() for c in some]]
        self.templates = [(number(t), label) for label, t in texts]
        self.automaton = Automaton()
        for i, (sequence, _) in enumerate([*self.phrases, *self.templates]):
            self.automaton.add(i, sequence)
        self.automaton.finish()
        k = len(self.phrases)
        #: Of each state, the templates' ends where its runs end, and the phrases that its runs, where long enough, end with:
        #: a phrase is known at the state that reading it leads to and at all states of which that one is a suffix.
        self.inside = [[(i - k, end) for i, end in e if i >= k] for e in self.automaton.ends]
        self.whole: list[list[int]] = [[] for _ in self.automaton.ends]
        for i, (sequence, _) in enumerate(self.phrases):
            *_, (state, _) = self.automaton.statistics(sequence)
            self.whole[state].append(i)
        for state in sorted(range(1, len(self.whole)), key=self.automaton.length.__getitem__):
            self.whole[state] = sorted({*self.whole[state], *self.whole[self.automaton.link[state]]})
        #: Of each template, the telling words that it has.
        self.told = [self.telling & set(words_of(t)) for _, t in texts]
        self.shortest = min([MIN_MATCH, *[len(s) for s, _ in self.phrases]])

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        get = self.numbers.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        turns = np.nonzero(np.diff(known))[0]
        base: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a >= self.shortest:  # no run of words leads over a word that no template has
                self._run(a, ids[a:b].tolist(), base, matches)
        score = 0.0
        chained = self._chained(matches, words)
        if chained:
            score = max(s["coverage"] for s in chained)
        place = lambda s, i: {"label": self.phrases[i][1], "start": s, "stop": s + len(self.phrases[i][0]), "coverage": 1.0}
        named = _outermost([place(s, i) for s, i in base if i >= self.n_base])
        base = [(s, i) for s, i in base if i < self.n_base]
        spans = _outermost([s for s in chained if s["coverage"] >= MIN_COVERAGE]) + named + [place(s, i) for s, i in base]
        spans.sort(key=lambda s: (s["start"], s["stop"], s["label"]))
        base_labels = sorted({self.phrases[i][1] for _, i in base})
        labels = sorted({s["label"] for s in spans})
        starts = [s for s, _ in base]
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": base_labels, "labels": labels, "spans": spans,
            "score": 1.0 if named or base else score,
        }

    def _run(self, at: int, ids: list[int], base: list, matches: list) -> None:
        found = list(self.automaton.statistics(ids))
        for i, (state, n) in enumerate(found):
            for p in self.whole[state]:
                size = len(self.phrases[p][0])
                if size <= n:
                    base.append((at + i + 1 - size, p))
            # A run is as long as it gets where the next word does not extend it.
            if n >= MIN_MATCH and (i + 1 == len(found) or found[i + 1][1] <= n):
                for t, end in self.inside[state]:
                    matches.append((t, at + i + 1 - n, end - n, n))

    def _chained(self, matches: list[tuple[int, int, int, int]], words: list[bytes]) -> list[dict]:
        """Spans of text that templates cover: matches of one template, in order in both, with small gaps between."""
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, place, origin, n in matches:
            by.setdefault(t, []).append((place, origin, n))
        for t, rows in by.items():
            size = len(self.templates[t][0])
            open_: list[list[int]] = []  # start, stop in the text, stop in the template, words covered
            best: list[list[int]] = []
            for place, origin, n in sorted(rows):
                open_ = [c for c in open_ if place - c[1] <= MAX_GAP]
                chain = None
                for c in open_:
                    if place + n > c[1] and origin + n > c[2] and -n < origin - c[2] <= MAX_GAP and (chain is None or c[3] > chain[3]):
                        chain = c
                if chain is None:
                    open_.append([place, place + n, origin + n, n])
                    best.append(open_[-1])
                else:
                    lost = max(0, chain[1] - place, chain[2] - origin)
                    chain[1], chain[2], chain[3] = place + n, origin + n, chain[3] + n - min(lost, n)
            for start, stop, _, n in best:
                # Words put in between count against the span; a telling word of a sibling, or one too few, ends it.
                if self.telling & set(words[start:stop]) == self.told[t]:
                    out.append({"label": self.templates[t][1], "start": start, "stop": stop, "coverage": min(1.0, n / (size + max(0, stop - start - n)))})
        return out


def scanned(
    docs: DataFrame,
    text: str = "text",
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    names: dict[str, str] | None = None,
    clauses: dict[str, Iterable[str]] | None = None,
) -> DataFrame:
    """``docs`` plus ``__licence``: ``n_words``, places of the phrases (``n_base, first_word, last_word, base_labels``), ``spans`` of phrases
    and names and of templates covered for half or more, ``labels`` of all, and ``score``, the largest coverage of any (a phrase's or name's is 1).

    Null and empty texts have no words and no labels; each row is scanned by itself; other columns pass unchanged. Names, templates and
    clauses are parameters, few and short; each task builds the automaton.
    """
    columns = docs.columns
    at = columns.index(text)
    given = lambda x, default: default if x is None else x
    chosen = (given(phrases, PHRASES), given(templates, TEMPLATES), given(names, NAMES), TELLING, given(clauses, CLAUSES))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*chosen)
        for batch in batches:
            found = pa.array([scanner.scan(x.as_py()) for x in batch.column(at)], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*columns, "__licence"])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("__licence", RESULT)]))
