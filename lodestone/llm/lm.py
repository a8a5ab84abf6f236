"""Language-model scores by cross-entropy difference.

A target and a background bigram model share one vocabulary (every word of the corpus), one order and one smoothing; they differ only in
the documents counted. A document's score is the mean over its words of the target's loss less the background's: low where it is like
the target. All words and all bigrams are kept, so the models grow with the corpus; they are never gathered in one place:

1. a pass over the texts finds the heavy words and bigrams (a share of one in ``ranges`` of all tokens), of which there can only be
   ``ranges`` of each, and a second one counts them exactly; these counts are broadcast;
2. a third pass deals what is left of each chunk of texts to ranges by word (by bigram where the word is heavy), packed;
3. each range counts its words and bigrams and sends back to every chunk what they add to each document's losses.

A word w after v has in model m the probability ``(c(v w) + PRIOR * own(w)) / (c(v) + PRIOR)`` with ``own(w) = (c(w) + BASE * g(w)) / (total +
BASE)`` and ``g(w) = c0(w) / (total0 + 1)``, c0 being the background's count; a word that the corpus lacks has ``1 / (total0 + 1)``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, written

#: Weights of a word's own frequency after a context, and of the background's frequency in a word's own one.
PRIOR, BASE = 50.0, 1000.0
#: Tokens that a task holds before it sends them on; bytes of text to a range of words, and ranges at least.
CHUNK = 400_000
RANGE_BYTES = 4 << 20
RANGES = 32
#: Chosen ids (one long each) up to which their table is broadcast.
CHOSEN_ROWS = 500_000
#: Bits of a row: counted in the background, in the target, to be scored; of an entry: it ends its text.
COUNTED, CHOSEN, ASKED, LAST = 1, 2, 4, 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("loss_target", T.DoubleType()),
        T.StructField("loss_background", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text (null: none) as UTF-8, A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class _Chunk:
    """Texts of a task, ``CHUNK`` tokens or one text more: words as places in the chunk's own list of word hashes."""

    def __init__(self, lens: list[int], marks: list[int], parts: list[np.ndarray], words: Iterable[bytes], pieces: list[pa.RecordBatch]) -> None:
        self.pieces, self.lens, self.marks = pieces, np.array(lens, np.int64), np.array(marks, np.uint8)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in words] + [0], np.uint64)  # the last stands for a text's start
        self.n = len(self.hashes) - 1
        self.ids = np.concatenate(parts).astype(np.int64)
        self.doc = np.repeat(np.arange(len(lens)), self.lens)
        ends = np.cumsum(self.lens)[self.lens > 0]
        self.last = np.zeros(len(self.ids), bool)
        self.last[ends - 1] = True
        self.before = np.concatenate(([-1], self.ids[:-1]))
        self.before[ends - self.lens[self.lens > 0]] = -1

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams: place of the second and of the first word, hash, and of each token its bigram; their counts."""
        keys, at, count = np.unique((self.before + 1) * self.n + self.ids, return_inverse=True, return_counts=True)
        word, before = keys % self.n, keys // self.n - 1
        return word, before, _paired(self.hashes[word], self.hashes[before] >> np.uint64(16)), at, count


def _paired(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Bigram hashes of word hashes and of the upper 48 bits of the hashes of the words before them."""
    return word ^ (before * _ODD)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Chunks of batches with the columns ``__t`` and ``__mark``."""

    def fresh() -> tuple[list, list, list, list, defaultdict]:
        ids: defaultdict = defaultdict()
        ids.default_factory = ids.__len__
        return [], [], [], [], ids

    lens, marks, parts, pieces, ids = fresh()
    held = 0
    for batch in batches:
        begun = 0
        texts = batch.column(batch.schema.get_field_index("__t"))
        for i, (body, mark) in enumerate(zip(texts, batch.column(batch.schema.get_field_index("__mark")).to_pylist(), strict=True)):
            words = words_of(body.as_py())
            lens.append(len(words))
            marks.append(mark)
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            held += len(words) + 1
            if held >= CHUNK:
                pieces.append(batch.slice(begun, i + 1 - begun))
                begun = i + 1
                yield _Chunk(lens, marks, parts, ids, pieces)
                lens, marks, parts, pieces, ids = fresh()
                held = 0
        if begun < batch.num_rows:
            pieces.append(batch.slice(begun))
    if lens:
        yield _Chunk(lens, marks, parts, ids, pieces)


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Heavy:
    """What is broadcast: exact counts of heavy words (as words, as contexts) and bigrams, totals, starts of texts; row 0 background, row 1 target."""

    ranges: int
    words: np.ndarray
    pairs: np.ndarray
    unigrams: np.ndarray
    contexts: np.ndarray
    bigrams: np.ndarray
    totals: np.ndarray
    starts: np.ndarray

    def own(self, counts: np.ndarray) -> np.ndarray:
        """Words' own probabilities from their counts (two rows)."""
        shared = np.maximum(counts[0], 1) / (self.totals[0] + 1)
        return (counts + BASE * shared) / (self.totals[:, None] + BASE)

    def first(self, bigrams: np.ndarray, unigrams: np.ndarray) -> np.ndarray:
        """What bigrams add to a loss before their context's count divides it."""
        return -np.log(bigrams + PRIOR * self.own(unigrams))


def _heavy(ranges: int):
    """mapInArrow to ``kind, key, n``: words (0) and bigrams (1) with a share of one in ``ranges`` of a chunk, and totals (2)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            kinds, keys, counts = [], [], []

            def add(kind: int, key: np.ndarray, n: np.ndarray) -> None:
                kinds.append(np.full(len(key), kind, np.int32))
                keys.append(key.view(np.int64))
                counts.append(n.astype(np.int64))

            n = len(c.ids)
            if n:
                single = np.bincount(c.ids, minlength=c.n)
                keep = single * ranges >= n
                add(0, c.hashes[:-1][keep], single[keep])
                _, _, pair, _, count = c.pairs()
                keep = count * ranges >= n
                add(1, pair[keep], count[keep])
            counted, chosen, some = c.marks & COUNTED > 0, c.marks & CHOSEN > 0, c.lens > 0
            add(2, np.arange(5, dtype=np.uint64), np.array([c.lens[counted].sum(), c.lens[chosen].sum(), (counted & some).sum(), (chosen & some).sum(), n]))
            arrays = [np.concatenate(a) for a in (kinds, keys, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["kind", "key", "n"])

    return rows


def _exact(words: np.ndarray, pairs: np.ndarray):
    """mapInArrow to ``kind, key, a, b, c, d``: counts of the heavy words (words and contexts of both models) and bigrams in a task."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = np.zeros((4, len(words))), np.zeros((4, len(pairs)))
        for c in _chunks(batches):
            if not len(c.ids):
                continue
            at, hit = _found(words, c.hashes[:-1])
            _, _, pair, of, _ = c.pairs()
            pair_at, pair_hit = _found(pairs, pair)
            for m, bit in enumerate((COUNTED, CHOSEN)):
                on = (c.marks & bit > 0)[c.doc]
                for row, mask in ((m, on), (2 + m, on & ~c.last)):
                    counts = np.bincount(c.ids[mask], minlength=c.n)
                    np.add.at(single[row], at[hit], counts[hit])
                counts = np.bincount(of[on], minlength=len(pair))
                np.add.at(double[m], pair_at[pair_hit], counts[pair_hit])
        for kind, keys, counts in ((0, words, single), (1, pairs, double)):
            columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), *(pa.array(r.astype(np.int64)) for r in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "a", "b", "c", "d"])

    return rows


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte, which packs better than number by number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


class _Reader:
    """Reads back what ``_planes`` wrote, in order."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = zstandard.ZstdDecompressor().decompress(raw), 0

    def planes(self, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(self.raw, np.uint8, n * width, self.at).reshape(width, n).T
        self.at += n * width
        return out.view("<u8").ravel()


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _dealer(sent, carry: list[str]):
    """mapInArrow to ``range, chunk, packed``: a chunk's entries (text, bigram, count) by range, and (range below 0) its carried columns."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy: Heavy = sent.value
        task = TaskContext.get().partitionId()
        for number, c in enumerate(_chunks(batches)):
            chunk = (task << 24) + number
            base = np.where(c.lens > 0, np.log(heavy.starts + PRIOR)[:, None], 0.0)
            ranges, packed = [], []
            if len(c.ids):
                at, hot = _found(heavy.words, c.hashes[:-1])
                word, before, pair, of, _ = c.pairs()
                pair_at, pair_hot = _found(heavy.pairs, pair)
                inner = c.ids[~c.last]
                for m in (0, 1):
                    after = np.where(hot, np.log(heavy.contexts[m][at] + PRIOR), 0.0) if len(heavy.words) else np.zeros(c.n)
                    base[m] += np.bincount(c.doc[~c.last], weights=after[inner], minlength=len(c.lens))
                if pair_hot.any():  # a heavy bigram's word is heavy
                    ready = np.zeros((2, len(pair)))
                    ready[:, pair_hot] = heavy.first(heavy.bigrams[:, pair_at[pair_hot]], heavy.unigrams[:, at[word[pair_hot]]])
                    for m in (0, 1):
                        base[m] += np.bincount(c.doc, weights=ready[m][of], minlength=len(c.lens))
                left = ~pair_hot[of]
                keys, counts = np.unique(c.doc[left] * len(pair) + of[left], return_counts=True)
                ends = np.zeros(len(keys), np.uint8)
                ending = left & c.last
                ends[np.searchsorted(keys, c.doc[ending] * len(pair) + of[ending])] = LAST
                doc, pair_of = keys // len(pair), keys % len(pair)
                route = np.where(hot[word], pair, c.hashes[word]) * _ODD
                where = ((route >> np.uint64(33)) % np.uint64(heavy.ranges)).astype(np.int64)[pair_of]
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(heavy.ranges + 1))
                for r in np.nonzero(np.diff(cuts))[0].tolist():
                    part = order[cuts[r] : cuts[r + 1]]
                    own, place = np.unique(word[pair_of[part]], return_inverse=True)
                    ranges.append(r)
                    packed.append(
                        _pack(
                            np.array([len(own), len(part)], "<u8").tobytes(),
                            _planes(c.hashes[own], 8),
                            _planes(c.hashes[before[pair_of[part]]] >> np.uint64(16), 6),
                            _planes(place, 4),
                            _planes(np.diff(doc[part], prepend=0), 4),
                            _planes(counts[part], 4),
                            (c.marks[doc[part]] | ends[part]).tobytes(),
                        )
                    )
            asked = np.nonzero(c.marks & ASKED)[0]
            if len(asked):
                kept = pa.Table.from_batches(c.pieces).select(carry).take(pa.array(asked)).combine_chunks()
                for name, values in (("__ord", asked), ("__n", c.lens[asked]), ("__l0", base[0][asked]), ("__l1", base[1][asked])):
                    kept = kept.append_column(name, pa.array(values))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema) as out:
                    out.write_table(kept)
                ranges.append(-1 - chunk % heavy.ranges)
                packed.append(_pack(sink.getvalue().to_pybytes()))
            columns = [pa.array(ranges, pa.int32()), pa.array([chunk] * len(ranges), pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "chunk", "packed"])

    return rows


def _folder(sent):
    """mapInArrow over ``range, chunk, packed`` sorted by range: what a range's words add to the losses of each chunk's texts.

    A range's entries are held by one task: about ``RANGE_BYTES`` of text, as heavy words were dealt by bigram and heavy bigrams not at all.
    """

    def folded(r: int, packs: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        heavy: Heavy = sent.value
        words, befores, docs, counts, marks, sizes = [], [], [], [], [], []
        for _, raw in packs:
            read = _Reader(raw)
            n_own, n = np.frombuffer(read.raw, "<u8", 2).tolist()
            read.at = 16
            own = read.planes(n_own, 8)
            befores.append(read.planes(n, 6))
            words.append(own[read.planes(n, 4)])
            docs.append(np.cumsum(read.planes(n, 4)).astype(np.int32))
            counts.append(read.planes(n, 4).astype(np.int32))
            marks.append(np.frombuffer(read.raw, np.uint8, n, read.at))
            sizes.append(n)
        word, before, count, mark = np.concatenate(words), np.concatenate(befores), np.concatenate(counts), np.concatenate(marks)
        words, befores, counts, marks = [], [], [], []
        pair_of = np.unique(_paired(word, before), return_inverse=True)[1].astype(np.int32)
        every, word_of = np.unique(word, return_inverse=True)
        word_of = word_of.astype(np.int32)
        del word, before
        at, hot = _found(heavy.words, every)
        ends = mark & LAST > 0
        bigrams, unigrams, contexts = [], [], []
        for bit in (COUNTED, CHOSEN):
            on = count * (mark & bit > 0)
            bigrams.append(np.bincount(pair_of, weights=on))
            unigrams.append(np.bincount(word_of, weights=on))
            contexts.append(unigrams[-1] - np.bincount(word_of, weights=ends * (mark & bit > 0)))
        unigrams, after = np.stack(unigrams), np.log(np.stack(contexts) + PRIOR)
        if hot.any():
            unigrams[:, hot] = heavy.unigrams[:, at[hot]]
            after[:, hot] = 0.0
        own = PRIOR * heavy.own(unigrams)
        loss = [count * -np.log(bigrams[m][pair_of] + own[m][word_of]) + (count - ends) * after[m][word_of] for m in (0, 1)]
        del bigrams, pair_of, word_of, count
        begun = 0
        for (chunk, _), doc, n in zip(packs, docs, sizes, strict=True):
            asked = mark[begun : begun + n] & ASKED > 0
            some, of = np.unique(doc[asked], return_inverse=True)
            if len(some):
                sums = [np.bincount(of, weights=row[begun : begun + n][asked]).astype("<f4") for row in loss]
                planes = [_planes(s.view("<u4"), 4) for s in sums]
                yield r, chunk, _pack(np.array([len(some)], "<u8").tobytes(), _planes(np.diff(some, prepend=0), 4), *planes)
            begun += n

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["range", "chunk", "packed"])

        now, packs = -1, []
        for batch in batches:
            for r, chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if r < 0:
                    yield batch_of([(r, chunk, packed.as_py())])
                    continue
                if r != now and packs:
                    yield batch_of(list(folded(now, packs)))
                    packs = []
                now = r
                packs.append((chunk, packed.as_py()))
        if packs:
            yield batch_of(list(folded(now, packs)))

    return rows


def _merged(carry: list[str]):
    """mapInArrow over ``range, chunk, packed`` sorted by chunk and range to the carried columns and the losses of a chunk's texts."""
    kind = pa.struct([("n_words", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64()), ("score", pa.float64())])

    def closed(kept: pa.Table, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = kept.column("__n").to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            base, target = sums[:, kept.column("__ord").to_numpy()] / n
        empty = n == 0
        parts = [pa.array(n), *(pa.array(v, mask=empty) for v in (target, base, target - base))]
        out = kept.select([f"__c{k}" for k in range(len(carry))]).rename_columns(carry)
        out = out.append_column("__lm", pa.StructArray.from_arrays(parts, fields=list(kind)))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, sums = None, None, None
        for batch in batches:
            for r, chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if r < 0:
                    if now is not None:
                        yield from closed(kept, sums)
                    now, kept = chunk, pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed.as_py())).read_all()
                    last = kept.column("__ord")[-1].as_py()
                    sums = np.zeros((2, last + 1))
                    for m in (0, 1):
                        sums[m][kept.column("__ord").to_numpy()] = kept.column(f"__l{m}").to_numpy()
                    continue
                if chunk != now:
                    raise ValueError("losses of a chunk without its texts")
                read = _Reader(packed.as_py())
                n = int(np.frombuffer(read.raw, "<u8", 1)[0])
                read.at = 8
                docs = np.cumsum(read.planes(n, 4)).astype(np.int64)
                for m in (0, 1):
                    sums[m][docs] += read.planes(n, 4).astype("<u4").view("<f4")
        if now is not None:
            yield from closed(kept, sums)

    return rows


def _counted(rows: DataFrame, ranges: int) -> Heavy:
    """Exact counts of the heavy words and bigrams: at most ``ranges`` of each, as each has that share of the tokens."""
    seen = rows.mapInArrow(_heavy(ranges), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    seen = cut(seen)
    totals = np.zeros(5, np.int64)
    for row in seen.where("kind = 2").collect():
        totals[row["key"]] = row["n"]
    # A share of 2 / ranges of all tokens is seen with at least half of that, since chunks without it hold less than 1 / ranges of theirs.
    found = seen.where((F.col("kind") < 2) & (F.col("n") * ranges >= int(totals[4]))).select("kind", "key").collect()
    words, pairs = (np.sort(np.array([r["key"] for r in found if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1))
    sums = rows.mapInArrow(_exact(words, pairs), "kind int, key long, a long, b long, c long, d long").groupBy("kind", "key")
    single, double = np.zeros((4, len(words))), np.zeros((4, len(pairs)))
    for row in sums.agg(*[F.sum(c).alias(c) for c in "abcd"]).collect() if len(found) else []:
        keys, table = (words, single) if row["kind"] == 0 else (pairs, double)
        table[:, np.searchsorted(keys, np.array([row["key"]], np.int64).view(np.uint64))[0]] = [row[c] for c in "abcd"]
    return Heavy(ranges, words, pairs, single[:2], single[2:], double[:2], totals[:2].astype(float), totals[2:4].astype(float))


def scored(
    docs: DataFrame, chosen: DataFrame, doc: str = "doc_id", text: str = "text", carry: list[str] | None = None, corpus: DataFrame | None = None
) -> DataFrame:
    """Columns ``carry`` (``[doc]`` if none are named) of ``docs`` and ``__lm``: ``n_words``, mean losses ``loss_target`` and
    ``loss_background`` in nats, ``score``, their difference.

    The background model counts every text of ``corpus`` (``docs`` if none is given), the target's those whose id is in ``chosen(doc_id)``.
    A null or empty text has no words and null losses; each row is scored by itself, repeated rows alike, and counts by itself; null
    ids are never chosen; of an empty corpus all words are unknown. Texts are read three times, so ``docs`` should be a stored table.
    """
    spark = docs.sparkSession
    carry = [doc] if carry is None else carry
    plain = [f"__c{k}" for k in range(len(carry))]  # names with dots can't pass through Arrow stages
    ids = cut(chosen.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").distinct()).withColumn("__in", F.lit(True))
    few = ids.count() <= CHOSEN_ROWS

    def marked(of: DataFrame, counted: bool, asked: bool) -> DataFrame:
        held = [(F.col(f"`{c}`") if asked else F.lit(None).cast(docs.schema[c].dataType)).alias(n) for c, n in zip(carry, plain, strict=True)]
        found = of.select(*held, F.col(f"`{doc}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__t"))
        mark = F.lit(COUNTED * counted + ASKED * asked)
        if counted:
            found = found.join(F.broadcast(ids) if few else ids, "__id", "left")
            mark = mark + F.when(F.col("__in"), CHOSEN).otherwise(0)
        return found.select(*plain, "__t", mark.cast("int").alias("__mark"))

    rows = marked(docs, True, True) if corpus is None else marked(docs, False, True).unionAll(marked(corpus, True, False))
    if not few:  # a shuffled join may order rows anew when a task is run again; chunks must not change
        rows = written(rows, "texts")
    size = rows.agg(F.sum(F.octet_length("__t")).alias("n")).first()["n"] or 0
    ranges = max(RANGES, -(-size // RANGE_BYTES))
    sent = spark.sparkContext.broadcast(_counted(rows, ranges))
    kind = "range int, chunk long, packed binary"
    dealt = rows.mapInArrow(_dealer(sent, plain), kind).repartition(ranges, "range").sortWithinPartitions("range", "chunk")
    back = dealt.mapInArrow(_folder(sent), kind).repartition("chunk").sortWithinPartitions("chunk", "range")
    return back.mapInArrow(_merged(carry), T.StructType([*[docs.schema[c] for c in carry], T.StructField("__lm", RESULT)]))
