"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits), each padded to a word of the perfect binary Golay code
of length 23: every word lies within ``RADIUS`` = 3 of exactly one of its 4,096 codewords. Of two fingerprints that differ in
at most four bits, some two segments differ in at most two bits together, so anchors are pairs of codewords, one for each of two
segments. A fingerprint has one home anchor for each pair of segments and is replicated to every anchor within the radius plus
the threshold (3 + e and 3 + f for each split e + f <= 2); whatever links to it has its home among these. Fingerprints
are compared only at anchors that are the home of some fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import connected, cut

SHINGLE = 4
THRESHOLD = 4
SEED = 42
RADIUS = 3
#: Home fingerprints compared at one anchor in one task; an anchor with more is dealt to several.
HOMES = 4096
#: Rows up to which the table of crowded anchors is broadcast.
CROWDED_ROWS = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Generator polynomial of the Golay code, and the shift and width of each segment.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
SPLITS = ((0, 0), (0, 1), (1, 0), (0, 2), (2, 0), (1, 1))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text (null: none) as UTF-8, A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``k`` words, repeats included; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    spans = zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where over half the hashes have it; zero without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row (``fp``: the fingerprint as a signed long)."""

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(words_of(x.as_py()), shingle)) for x in batch.column(1)]
            fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(prints, "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - 11), 0)
    return out


def _cosets() -> list[np.ndarray]:
    """For excess e = 0, 1, 2 a table by syndrome of the error patterns of weight <= 3 (e = 0) or = 3 + e; -1 pads."""
    every = np.arange(1 << 23, dtype=np.int64)
    weight = np.bitwise_count(every)
    tables = []
    for e in range(3):
        errors = every[weight <= RADIUS] if e == 0 else every[weight == RADIUS + e]
        syndromes = _syndrome(errors)
        order = np.argsort(syndromes, kind="stable")
        errors, syndromes = errors[order], syndromes[order]
        first = np.searchsorted(syndromes, np.arange(2048))
        place = np.arange(len(errors)) - first[syndromes]
        table = np.full((2048, place.max() + 1), -1, np.int64)
        table[syndromes, place] = errors
        tables.append(table)
    return tables


_tables: list[np.ndarray] = []


def anchors(fps: np.ndarray, replicas: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(anchor, place)``: the anchors of fingerprints (their homes, or else every other within reach) and whose they are.

    An anchor's number holds the pair of segments and the 12 message bits of either codeword: below 3 * 2**24.
    """
    if not _tables:
        _tables.extend(_cosets())
    words = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = []
    for word in words:
        syndrome = _syndrome(word)
        near.append([np.where((e := t[syndrome]) >= 0, (word[:, None] ^ e) >> 11, -1) for t in _tables])
    out, whose = [], []
    for pair, (x, y) in enumerate(PAIRS):
        for e, f in SPLITS:
            if replicas == (e + f == 0):
                continue
            a, b = near[x][e][:, :, None], near[y][f][:, None, :]
            both = np.where((a >= 0) & (b >= 0), (pair << 24) | (a << 12) | b, -1).reshape(len(fps), -1)
            row, col = np.nonzero(both >= 0)
            out.append(both[row, col])
            whose.append(row)
    return np.concatenate(out), np.concatenate(whose)


def _spread(used) -> Callable:
    """A mapInArrow function from ``fp`` to ``anchor, fp, home``; replicas only at anchors whose bit in ``used`` is set."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if used is None else np.frombuffer(used.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                fps = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for home in [True] if bits is None else [True, False]:
                    anchor, whose = anchors(fps, not home)
                    if not home:
                        hit = np.nonzero((bits[anchor >> 3] >> (anchor & 7)) & 1)[0]
                        anchor, whose = anchor[hit], whose[hit]
                    columns = [pa.array(anchor), pa.array(fps[whose].view(np.int64)), pa.array(np.full(len(anchor), home))]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "fp", "home"])

    return rows


def _used(homes: DataFrame) -> bytes:
    """One bit for each of the 3 * 2**24 anchors, set where it is a home: 6 MB, whatever the input."""
    n = F.col("anchor") + 1  # these functions number bits from one, buckets too
    parts = homes.groupBy(F.bitmap_bucket_number(n).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))
    out = bytearray((len(PAIRS) << 24) // 8)
    for row in parts.toLocalIterator():
        at = (row["k"] - 1) * 4096
        out[at : at + 4096] = row["bits"][: len(out) - at]
    return bytes(out)


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` among sorted ``anchor, part, home (first), fp``: a spanning forest of each anchor's links, not all pairs.

    At most ``HOMES`` home fingerprints of an anchor are held; its other fingerprints pass by in batches.
    """
    state: dict = {"key": None}

    def start(key) -> None:
        state.update(key=key, homes=np.zeros(0, np.uint64), label=np.zeros(0, np.int64))

    def meet(fps: np.ndarray, are_homes: bool, out: list) -> None:
        """Compare homes with ``fps`` (which join them if they are homes)."""
        homes, label = state["homes"], state["label"]
        if are_homes:
            homes = np.concatenate((homes, fps))
            label = np.concatenate((label, np.arange(len(label), len(homes))))
            every, labels = homes, label
        else:
            every = np.concatenate((homes, fps))
            labels = np.concatenate((label, np.arange(len(homes), len(every))))
        if len(every) > 1:
            for i in range(len(homes)):
                near = np.nonzero(np.bitwise_count(every ^ homes[i]) <= THRESHOLD)[0]
                near = near[labels[near] != labels[i]]
                if len(near):
                    found, first = np.unique(labels[near], return_index=True)
                    for j in near[first]:
                        out.append((homes[i], every[j]))
                    labels[np.isin(labels, found)] = labels[i]
        state["homes"], state["label"] = homes, labels[: len(homes)].copy()
        # Labels of passing fingerprints may have been taken over by homes: number them anew.
        if len(homes):
            state["label"] = np.unique(state["label"], return_inverse=True)[1]

    start(None)
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        home = batch.column(2).to_numpy(zero_copy_only=False)
        fp = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        change = np.nonzero((np.diff(anchor) != 0) | (np.diff(part) != 0))[0] + 1
        edges = np.concatenate(([0], change, [len(fp)]))
        out: list = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = (anchor[a], part[a])
            if key != state["key"]:
                start(key)
                if b - a == 1 and b < len(fp):
                    continue
            k = a + int(np.count_nonzero(home[a:b]))
            if k > a:
                meet(fp[a:k], True, out)
            for at in range(k, b, 1 << 16):
                meet(fp[at : min(b, at + (1 << 16))], False, out)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` enough to connect all distinct fingerprints ``fp`` that differ in ``THRESHOLD`` bits or fewer."""
    spark = fps.sparkSession
    schema = "anchor long, fp long, home boolean"
    homes = fps.mapInArrow(_spread(None), schema)
    used = spark.sparkContext.broadcast(_used(homes))
    rows = fps.mapInArrow(_spread(used), schema)
    crowded = cut(homes.groupBy("anchor").count().where(F.col("count") > HOMES).select("anchor", F.ceil(F.col("count") / HOMES).alias("parts")))
    n = crowded.count()
    if n:
        rows = rows.join(F.broadcast(crowded) if n <= CROWDED_ROWS else crowded, "anchor", "left")
        own = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")))
        every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        # Homes of a crowded anchor are dealt to its parts; its replicas, and homes as what they are compared with, go to each.
        parts = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(every)
        rows = rows.withColumn("part", F.explode(parts)).withColumn(
            "home", F.col("home") & (F.col("parts").isNull() | F.array_contains(own, F.col("part")))
        )
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    rows = rows.select("anchor", "part", "home", "fp").repartition("anchor", "part")
    rows = rows.sortWithinPartitions("anchor", "part", F.col("home").desc(), "fp")
    return rows.mapInArrow(_forest, "a long, b long").distinct()


def components(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: rows with fingerprints within ``THRESHOLD`` bits, however indirectly, share
    the smallest doc_id among them.

    Null and empty texts have fingerprint zero and are linked like any other; null ids never name a component (null only
    where all are null); repeated rows each have a row; an empty table gives an empty one.
    """
    rows = cut(fingerprinted(docs, doc, text, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected(links(fps.select("fp")))
    rooted = fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: F.Column) -> F.Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
