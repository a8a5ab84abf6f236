"""Quality and toxicity by hierarchical empirical Bayes.

A classifier, fitted on a bounded sample of labelled documents, gives each document's evidence as log odds. Hosts and their paths have
posteriors of their own: expected counts of good (or toxic) documents, from all documents, shrunk towards the level above by
beta priors whose strength comes from how much the groups of a level differ. Evidence and the posterior of the
document's path, both levels without the document itself, together give its probability.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, written

#: Labelled documents that the classifier is fitted on at most, those of the least seeded hash.
SAMPLE = 8_000
SEED = 7
FEATURES = 1 << 18
#: Standard deviations from chance and sampled documents that make a feature count.
MIN_Z, MIN_SEEN = 4.0, 4
ROUNDS = 80
RATE = 0.15
DECAY = 1e-6
#: Bounds on a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 10_000.0
HEADS = ("quality", "toxic")
#: Rows up to which labels are broadcast.
LABEL_ROWS = 100_000

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SYMBOLS = b"#*$%&|<>"
_STEPS = np.array([0.0, 0.002, 0.01, 0.03, 0.08, 0.2, 0.5, 1.0])


def features(text: str | None) -> np.ndarray:
    """Numbers of the features of a text (null: as an empty one): its words, and levels of some shares of it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_NORMAL).split()
    distinct = set(words)
    crc = zlib.crc32
    numbers = [crc(w) % (FEATURES - 64) for w in distinct]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = (
        sum(map(raw.count, (bytes([c]) for c in _SYMBOLS))) / max(1, len(raw)),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(distinct) / max(1, len(words)),
    )
    for k, share in enumerate(shares):
        numbers.append(FEATURES - 64 + 10 * k + int(np.searchsorted(_STEPS, share)))
    numbers.append(FEATURES - 64 + 40 + min(15, int(math.log2(len(words) + 1))))
    return np.unique(np.array(numbers, np.int32))


@dataclass
class Linear:
    """Logistic weights by head, and each head's share of positives among the rows fitted on."""

    weights: np.ndarray
    bias: np.ndarray
    share: np.ndarray

    def evidence(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log odds that the text's features add to the share (two rows)."""
        if not rows:
            return np.zeros((len(HEADS), 0))
        flat, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])])
        sums = np.add.reduceat(self.weights[:, flat], starts, axis=1)
        return sums + (self.bias - np.log(self.share / (1 - self.share)))[:, None]


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Linear:
    """Logistic regression of both heads by full-batch steps with per-weight rates; deterministic."""
    share = np.clip(labels.mean(axis=1) if rows else np.full(len(HEADS), 0.5), 1e-3, 1 - 1e-3)
    weights, bias = np.zeros((len(HEADS), FEATURES)), np.log(share / (1 - share))
    if not rows:
        return Linear(weights, bias, share)
    flat, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
    starts, whose = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(rows)), lengths)
    seen = np.bincount(flat, minlength=FEATURES)
    for h in range(len(HEADS)):
        # Only features that go with the label beyond chance take part; a rare word that does so by chance would be learnt by heart.
        met = np.bincount(flat, labels[h][whose], FEATURES)
        chance = seen * share[h] * (1 - share[h]) * (1 - seen / (len(rows) + 1))
        used = (np.abs(met - seen * share[h]) >= MIN_Z * np.sqrt(np.maximum(chance, 0.5))) & (seen >= MIN_SEEN)
        m, v = np.zeros(FEATURES), np.zeros(FEATURES)
        for t in range(1, ROUNDS + 1):
            odds = np.add.reduceat(weights[h][flat], starts) + bias[h]
            error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[h]
            slope = np.where(used, np.bincount(flat, error[whose], FEATURES) / len(rows) + DECAY * weights[h], 0.0)
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
            weights[h] -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            bias[h] -= RATE * error.mean()
    return Linear(weights.astype(np.float32), bias, share)


def trained(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = SEED) -> Linear:
    """A classifier fitted on at most ``sample`` labelled documents; labels that are null or of repeated ids count as their maximum."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"))
    marks = marks.agg(*[F.coalesce(F.max(h), F.lit(0)).cast("int").alias(h) for h in HEADS])
    order = F.xxhash64(F.lit(seed), "__id")
    marks = cut(marks)
    n = marks.count()
    if n > 4 * sample:  # the least hashes lie below this bound, so that no partition sorts or sends all of its rows
        low = marks.where(order < int((2 * sample / n - 0.5) * 2.0**64))
        marks = low if low.count() >= sample else marks
    marks = cut(marks.orderBy(order, "__id").limit(sample))
    rows = docs.select(F.col(f"`{doc}`").alias("__id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(marks), "__id").select("t", *HEADS)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([features(x.as_py()).tobytes() for x in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=["f", *HEADS])

    found = rows.mapInArrow(read, "f binary, " + ", ".join(f"{h} int" for h in HEADS)).collect()
    found.sort(key=lambda r: bytes(r["f"]))
    return fit([np.frombuffer(r["f"], np.int32) for r in found], np.array([[r[h] for r in found] for h in HEADS], float).reshape(len(HEADS), -1))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))))


def _strength(groups: DataFrame, mean: Column, head: str) -> Column:
    """Of a beta prior, by moments: how far the groups' shares spread around their means beyond what their sizes explain."""
    share = F.col(f"k_{head}") / F.col("n")
    noise = mean * (1 - mean) / F.col("n")
    spread = F.sum(F.col("n") * ((share - mean) * (share - mean) - noise)) / F.sum("n")
    whole = F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")
    value = F.when(spread > 0, whole / spread - 1).otherwise(F.lit(STRONGEST))
    return F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(value, F.lit(STRONGEST)))).alias(f"strength_{head}")


def _shrunk(k: Column, n: Column, strength: float, mean: Column) -> Column:
    """The posterior mean of a group with ``k`` of ``n`` under a beta prior."""
    return (k + strength * mean) / (n + strength)


def judged(docs: DataFrame, model: Linear, host: Column, path: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all but the text) plus ``p_quality, p_toxic, host_quality, path_quality, kept``.

    ``kept``: good rather than not, and not toxic rather than toxic. Null hosts and paths are groups like any other; null and
    empty texts have the evidence of an empty text; repeated rows are judged alike; an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != text] if carry is None else carry
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keys = {"__host": host, "__path": path}
    shaped = docs.select(*[F.col(f"`{c}`") for c in names], *[F.coalesce(F.concat(F.lit("0"), v.cast("string")), F.lit("1")).alias(k) for k, v in keys.items()], F.col(f"`{text}`").alias("__t"))
    schema = shaped.drop("__t").schema
    for h in HEADS:
        schema = schema.add(f"__e_{h}", "double")
    every = schema.names

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 256):
                parts.append(sent.value.evidence([features(x.as_py()) for x in batch.column(batch.num_columns - 1).slice(at, 256)]))
            found = np.concatenate(parts, axis=1) if parts else np.zeros((len(HEADS), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(e, pa.float64()) for e in found]], names=every)

    rows = written(shaped.mapInArrow(read, schema), "evidence")
    base = dict(zip(HEADS, model.share.tolist(), strict=True))
    soft = rows.select("__host", "__path", *[_probability(F.col(f"__e_{h}") + _logit(F.lit(base[h]))).alias(f"r_{h}") for h in HEADS])
    paths = soft.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"r_{h}").alias(f"k_{h}") for h in HEADS])
    paths = cut(paths)
    hosts = cut(paths.groupBy("__host").agg(F.sum("n").alias("n"), *[F.sum(f"k_{h}").alias(f"k_{h}") for h in HEADS]))
    total = hosts.agg(*[(F.sum(f"k_{h}") / F.sum("n")).alias(h) for h in HEADS]).first()
    mean = {h: F.lit(base[h] if total[h] is None else float(total[h])) for h in HEADS}
    strength = hosts.agg(*[_strength(hosts, mean[h], h) for h in HEADS]).first()
    of_hosts = {h: float(strength[f"strength_{h}"]) for h in HEADS}
    shrunk = [_shrunk(F.col(f"k_{h}"), F.col("n"), of_hosts[h], mean[h]).alias(f"t_{h}") for h in HEADS]
    hosts = cut(hosts.select("__host", F.col("n").alias("nh"), *[F.col(f"k_{h}").alias(f"kh_{h}") for h in HEADS], *shrunk))
    within = paths.join(hosts, "__host")
    strength = within.agg(*[_strength(within, F.col(f"t_{h}"), h) for h in HEADS]).first()
    of_paths = {h: float(strength[f"strength_{h}"]) for h in HEADS}
    shrunk = [_shrunk(F.col(f"k_{h}"), F.col("n"), of_paths[h], F.col(f"t_{h}")).alias(f"u_{h}") for h in HEADS]
    counts = ["n", "nh", *[f"k_{h}" for h in HEADS], *[f"kh_{h}" for h in HEADS]]
    sites = cut(within.select("__host", "__path", *counts, *[f"t_{h}" for h in HEADS], *shrunk))
    few = sites.count() <= LABEL_ROWS
    met = rows.join(F.broadcast(sites) if few else sites, ["__host", "__path"])
    p = {}
    for h in HEADS:
        # The document's own share is taken out of its host and path, or its evidence would count twice.
        own = _probability(F.col(f"__e_{h}") + _logit(F.lit(base[h])))
        above = _shrunk(F.col(f"kh_{h}") - own, F.col("nh") - 1, of_hosts[h], mean[h])
        p[h] = _probability(F.col(f"__e_{h}") + _logit(_shrunk(F.col(f"k_{h}") - own, F.col("n") - 1, of_paths[h], above)))
    return met.select(
        *[F.col(f"`{c}`") for c in names], p["quality"].alias("p_quality"), p["toxic"].alias("p_toxic"),
        F.col("t_quality").alias("host_quality"), F.col("u_quality").alias("path_quality"),
        ((p["quality"] >= 0.5) & (p["toxic"] < 0.5)).alias("kept"),
    )
