"""Near-copies by similarity of word shingles: SimHash anchors and min-wise signatures propose, exact sets decide.

Four bits of 64 are a tight rule: most pairs whose sets of five-word shingles are 0.8 alike differ in 5 to 17 bits. So, besides the
fingerprints that ``simhash.links`` joins, texts meet in buckets of equal bands of a min-wise signature, and of one component of those
links. Within a bucket, a text is first proposed to those most like it by signature and along a spanning forest of the best such links.
Every proposed pair is then decided by its sets of shingles, and groups are the connected components of the pairs that hold. Texts of a
bucket that are left apart meet once more, with their sets: every pair with an estimate above the bound is decided where it
meets, and only links that join two groups leave the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import connected, cut, dropped, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
HASHES = 128
#: How far an estimate from ``HASHES`` values may lie below the similarity of a pair (about three standard errors).
SLACK = 0.11
#: Texts that each is proposed to at first, before all that are left apart meet.
NEIGHBOURS = 3
#: Texts of one bucket compared in one task, two parts of this many; a larger bucket is dealt to several tasks.
PART = 2048
#: Shingles of one part, where texts are long.
SHINGLES = 1 << 20
#: Dropped rows up to which their ids are broadcast (16 MB).
DROPPED_ROWS = 500_000

_PRINTS = "doc_id long, row_hash long, content binary, fp long, signature binary, short binary"
_random = np.random.default_rng(20240607)
_FLIP = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least value of each of ``HASHES`` orders over a set of shingle hashes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048][None, :] ^ _FLIP[:, None]) * _MUL[:, None]).min(axis=1))
    return (least & np.uint64(0xFFFF)).astype("<u2")


def _prints(docs: DataFrame, doc: str, text: str, shingle: int) -> DataFrame:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                contents, fps, signatures, shorts = [], [], [], []
                for body in part.column(2):
                    words = simhash.words_of(body.as_py())
                    hashes = simhash.shingle_hashes(words, shingle)
                    contents.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    fps.append(simhash.fingerprint(hashes))
                    least = signature(hashes)
                    signatures.append(least.tobytes())
                    shorts.append(least.astype(np.uint8).tobytes())
                columns = [
                    part.column(0), part.column(1), pa.array(contents, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(signatures, pa.binary()), pa.array(shorts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _PRINTS.split(", ")])

    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc}`").cast("long").alias("d"), F.xxhash64(body).alias("h"), body.alias("t")).mapInArrow(rows, _PRINTS)


def _sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``content, s``: the set of a text's shingles, 32 bits of each hash."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                contents, sets = [], []
                for body in batch.column(0).slice(at, 512):
                    words = simhash.words_of(body.as_py())
                    contents.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sets.append(np.unique((simhash.shingle_hashes(words, shingle) >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                columns = [pa.array(contents, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))]
                yield pa.RecordBatch.from_arrays(columns, names=["content", "s"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(rows, "content binary, s array<int>")


def _bands(contents: DataFrame) -> DataFrame:
    """``band, content``: a key for each band of each signature."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, whose = [], []
                for content, sig in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for b in range(BANDS):
                        keys.append(xxhash.xxh64_intdigest(sig[2 * ROWS * b : 2 * ROWS * (b + 1)], b))
                        whose.append(content)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(whose, pa.binary())], names=["band", "content"])

    return contents.select("content", "signature").mapInArrow(rows, "band long, content binary")


def _proposals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b`` worth a look among rows sorted by ``band, p, q``; a task holds one bucket's part, ``2 * PART`` rows or so."""
    held: dict = {"key": None, "contents": [], "signatures": []}

    def pairs() -> list:
        contents = held["contents"]
        n = len(contents)
        if n < 2:
            return []
        s = np.frombuffer(b"".join(held["signatures"]), np.uint8).reshape(n, HASHES)
        need = int(np.floor((SIMILARITY - SLACK) * HASHES))
        best, parent = np.full(n, -1), np.full(n, -1)
        open_ = np.ones(n, bool)
        out = set()
        at = 0
        for _ in range(n):
            open_[at] = False
            alike = (s == s[at]).sum(axis=1, dtype=np.int16)
            alike[at] = -1
            for j in np.argpartition(-alike, min(NEIGHBOURS, n - 1) - 1)[:NEIGHBOURS].tolist():
                if alike[j] >= need:
                    out.add((min(at, j), max(at, j)))
            closer = open_ & (alike > best)
            best[closer], parent[closer] = alike[closer], at
            if not open_.any():
                break
            at = int(np.argmax(np.where(open_, best, -2)))
            if best[at] >= need:
                out.add((min(at, int(parent[at])), max(at, int(parent[at]))))
        return [(contents[i], contents[j]) for i, j in out]

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        found: list = []
        for key, content, sig in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if key != held["key"]:
                found += pairs()
                held = {"key": key, "contents": [], "signatures": []}
            held["contents"].append(content)
            held["signatures"].append(sig)
        yield batch_of(found)
    yield batch_of(pairs())


def _links(similarity: float):
    """A mapInArrow function from rows ``band, p, q, content, short, label, s`` sorted by the first three to links ``a, b`` that hold and
    join labels: all pairs of a bucket's part with different labels and an estimate above the bound are decided, and a forest is put out."""
    need = int(np.floor((similarity - SLACK) * HASHES))

    def links(contents: list, shorts: list, labels: list, sets: list) -> tuple[list, list]:
        left, right = [], []
        if len(set(labels)) < 2:
            return left, right
        signs = np.frombuffer(b"".join(shorts), np.uint8).reshape(len(contents), HASHES)
        label = np.unique(np.array(labels, object), return_inverse=True)[1]
        sizes = np.array([len(x) for x in sets], np.int64)
        starts = np.cumsum(sizes) - sizes
        shingles = np.unique(np.concatenate(sets), return_inverse=True)[1]
        own = np.zeros(len(shingles) + 1, bool)
        for i in np.nonzero(sizes)[0].tolist():
            after = i + 1 + np.nonzero((label[i + 1 :] != label[i]) & (sizes[i + 1 :] > 0))[0]
            after = after[(signs[after] == signs[i]).sum(axis=1, dtype=np.int16) >= need]
            if not len(after):
                continue
            mine = shingles[starts[i] : starts[i] + sizes[i]]
            own[mine] = True
            for at in range(0, len(after), 256):
                near = after[at : at + 256]
                begins = np.cumsum(sizes[near]) - sizes[near]
                which = np.repeat(starts[near] - begins, sizes[near]) + np.arange(sizes[near].sum())
                both = np.add.reduceat(own[shingles[which]], begins, dtype=np.int64)
                for j in near[both >= similarity * (sizes[i] + sizes[near] - both)].tolist():
                    if label[j] != label[i]:
                        left.append(contents[i])
                        right.append(contents[j])
                        label[label == label[j]] = label[i]
            own[mine] = False
        return left, right

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links(*held)], names=["a", "b"])

        key, held = None, ([], [], [], [])
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            values, ends = batch.column(6).flatten().to_numpy(), np.cumsum(batch.column(6).value_lengths().to_numpy())
            sets = np.split(values, ends[:-1])
            for now, *row in zip(keys, *(batch.column(c).to_pylist() for c in range(3, 6)), sets, strict=True):
                if now != key:
                    if key is not None:
                        yield closed()
                    key, held = now, ([], [], [], [])
                for kept_, value in zip(held, row, strict=True):
                    kept_.append(value)
        if key is not None:
            yield closed()

    return rows


def _dealt(members: DataFrame) -> DataFrame:
    """Rows of buckets with the ``parts`` of theirs, dealt to ``p, q``: a crowded bucket is cut into parts, and each pair of parts is a task
    of its own: whole, with no task above two parts."""
    own = F.pmod(F.xxhash64("content"), F.col("parts"))
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    return rows.drop("own", "other", "parts")


def _sorted(signed: DataFrame) -> DataFrame:
    return signed.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "content")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members``: ``band, content, parts`` of buckets of two texts or more, and the first pairs ``a, b`` of contents, proposed by bucket
    and by fingerprint."""
    first = cut(contents.groupBy("fp").agg(F.min("content").alias("first")))
    near = cut(simhash.links(first.select("fp")))
    # Fingerprints of one component of links, and so all within the threshold, share a bucket.
    linked = connected(near).select(F.col("node").alias("fp"), "root")
    prints = contents.select("content", "fp").join(linked, "fp", "left")
    prints = prints.select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("band"), "content")
    bands = _bands(contents).unionAll(prints)
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(bands.join(full, "band").select("band", "content", F.ceil(F.col("n") / PART).alias("parts")))
    # Buckets are compared by the low byte of each value: it is half as long, and estimates grow by a 256th at most.
    signed = _dealt(members).join(contents.select("content", "short"), "content").select("band", "p", "q", "content", "short")
    by_band = _sorted(signed).mapInArrow(_proposals, "a binary, b binary")
    # Texts of one fingerprint are proposed to its first, and firsts of linked fingerprints to each other.
    same = contents.join(first, "fp").select(F.col("first").alias("a"), F.col("content").alias("b"))
    ends = first.select(F.col("fp").alias("a"), F.col("first").alias("x")), first.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    linked = near.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return members, cut(_ordered(by_band.unionAll(same).unionAll(linked)))


def _held(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs ``a, b`` of contents, those whose sets are alike."""
    met = pairs.join(sets.select(F.col("content").alias("a"), F.col("s").alias("sa")), "a")
    met = met.join(sets.select(F.col("content").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    met = met.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("all"))
    return met.where(F.col("both") >= similarity * (F.col("all") - F.col("both"))).select("a", "b")


def _connected(contents: DataFrame, members: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of the groups: decides ``pairs``, then all that buckets hold among texts still apart."""
    held = written(_held(pairs, sets, similarity), "held")
    nodes = connected(held)
    # Only texts of some pair have a partner above the bound, and only they have sets.
    tagged = members.select("band", "content").join(sets.select("content", F.size("s").alias("size")), "content")
    tagged = tagged.join(nodes.withColumnRenamed("node", "content"), "content", "left")
    tagged = cut(tagged.select("band", "content", "size", F.coalesce("root", "content").alias("label")))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("size") / SHINGLES)).alias("parts")
    apart = tagged.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), parts).where("x <> y").select("band", "parts")
    signed = _dealt(tagged.drop("size").join(apart, "band")).join(contents.select("content", "short"), "content").join(sets, "content")
    signed = _sorted(signed.select("band", "p", "q", "content", "short", "label", "s"))
    found = written(signed.mapInArrow(_links(similarity), "a binary, b binary"), "links")
    dropped(tagged)
    return nodes if found.isEmpty() else connected(held.unionAll(found))


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, row_hash, component_id`` of every row; near-copies share the smallest doc_id among them.

    Texts with the same words, null and empty ones included, are copies. ``row_hash`` is xxhash64 of the text, so that a row is
    known again where ids repeat. Null ids never name a group (null only where all are null); an empty table gives an empty one.
    """
    return _grouped(docs, doc, text, shingle, similarity).select("doc_id", "row_hash", "component_id")


def _grouped(docs: DataFrame, doc: str, text: str, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``groups`` plus ``root``, which names the group whatever its ids."""
    prints = written(_prints(docs, doc, text, shingle), "prints")
    one = prints.groupBy("content").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("signature").alias("signature"), F.min("short").alias("short"))
    contents = written(one, "contents")
    members, pairs = _candidates(contents)
    ends = pairs.select(F.col("a").alias("content")).unionAll(pairs.select(F.col("b").alias("content"))).distinct()
    # Only texts in some pair are read again for their sets, one row of each: the one of the least row hash.
    rows = prints.join(ends, "content", "left_semi").groupBy("content").agg(F.min(F.struct("row_hash", "doc_id")).alias("r"))
    rows = cut(rows.select(F.col("r.row_hash").alias("__h"), F.col("r.doc_id").alias("__d")))
    few = rows.count() <= DROPPED_ROWS
    body = docs.select("*", F.xxhash64(F.col(f"`{text}`").cast("string")).alias("__t"))
    same = (F.col("__t") == F.col("__h")) & F.col(f"`{doc}`").cast("long").eqNullSafe(F.col("__d"))
    wanted = body.join(F.broadcast(rows) if few else rows, same, "left_semi")
    sets = cut(_sets(wanted, text, shingle).groupBy("content").agg(F.min("s").alias("s")))
    nodes = _connected(contents, members, pairs, sets, similarity)
    rooted = contents.select("content", "least").join(nodes.withColumnRenamed("node", "content"), "content", "left")
    rooted = rooted.select("content", "least", F.coalesce("root", "content").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").select("content", "component_id", "root")
    return prints.select("doc_id", "row_hash", "content").join(known, "content").select("doc_id", "row_hash", "component_id", "root")


def kept(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of near-copies: that of its smallest doc_id (null ids last), of the texts of that id the one of the
    least hash, and of rows that repeat id and text one. Unrelated rows stay, whatever their ids are."""
    rows = _grouped(docs, doc, text, **options).groupBy("root", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("best"))
    judged = rows.join(best, "root")
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_hash").eqNullSafe(F.col("best.row_hash")))
    judged = cut(judged.select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__l"), best.alias("best"), "n").where("not best or n > 1"))
    few = judged.count() <= DROPPED_ROWS
    sized = lambda x: F.broadcast(x) if few else x
    same = F.col(f"`{doc}`").cast("long").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__l"))
    out = docs.withColumn("__h", F.xxhash64(F.col(f"`{text}`").cast("string")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    again = judged.where("best")
    if again.isEmpty():
        return out.join(sized(judged.select("__d", "__l")), same, "left_anti").select(*names)
    alone = out.join(sized(judged.select("__d", "__l")), same, "left_anti").select(*names)
    # Rows that repeat id and text: the one whose columns hash least, by partial minima.
    row = F.struct(*names)
    once = out.join(sized(again.select("__d", "__l")), same).groupBy("__d", "__l").agg(F.min_by(row, F.xxhash64(*names)).alias("r"))
    return alone.unionAll(once.select(*[F.col(f"r.`{c}`") for c in docs.columns]))
