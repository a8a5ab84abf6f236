"""Token ids of whole texts, stored in ascending doc_id order as one wavelet matrix image a shard, and read back.

Images are rows of a Parquet table in the shared folder, written and read by Spark alone, so they reach any store that Spark does;
``image`` of a row is the shard's file, complete in itself (see ``wavelet``).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .wavelet import Wavelet, build

END_ID = 2
#: Tokens at which a shard is closed; it ends with a whole document.
SHARD_TOKENS = 1 << 18
#: Texts cut and encoded at a time, pieces encoded at a time.
_CHUNK = 3072
_TOGETHER = 256

SHARDS = "part long, seq long, n_tokens long, doc_ids array<long>, image binary"


def default_tokenizer() -> str:
    """The path of the byte-level BPE of 50,257 ids among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A space at either end of a text or beside other white space (of Unicode's and of Python's kinds).
_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ODD = rf"^ | $| [{_SPACE}]|[{_SPACE}] "


class Encoder:
    """Ids of texts by the tokenizers library, without special tokens, equal to ``encode`` of each whole text.

    The byte-level pre-tokenizer cuts before a single space between other characters, and merges never cross a cut. So a
    batch of texts is cut at its spaces, each distinct piece is encoded once, and the texts' ids are gathered from the
    pieces'. A text with other spaces than single ones between other characters is encoded whole.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")  # how the vocabulary writes a space

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `` piece`` for each piece, and how many each has. Many are encoded at once: only a piece's first id starts
        with a space."""
        flat, lengths = [], []
        texts = [" " + " ".join(pieces[i : i + _TOGETHER]) for i in range(0, len(pieces), _TOGETHER)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            group = pieces[i * _TOGETHER : (i + 1) * _TOGETHER]
            cuts = np.nonzero(self.spaced[ids])[0]
            if len(cuts) != len(group) or cuts[0] != 0:  # a special token's text, which may stand after a space by itself
                each = [self._ids(" " + w) for w in group]
                ids, cuts = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            flat.append(ids)
            lengths.append(np.diff(cuts, append=len(ids)))
        none = np.zeros(0, np.int64)
        return np.concatenate([np.zeros(0, self.kind), *flat]), np.concatenate([none, *lengths])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0))
        cut = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        starts = cut.offsets.to_numpy()[:-1]
        out = {i: self._ids(texts[i].as_py()) for i in np.nonzero(odd.to_numpy(zero_copy_only=False))[0].tolist()}
        if len(starts):
            values = cut.values
            kinds = values.dictionary_encode()
            which = kinds.indices.to_numpy().astype(np.int64)
            first = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(values.take(pa.array(starts)).to_pylist(), add_special_tokens=False)]
            flat, lengths = self._pieces(kinds.dictionary.to_pylist())
            which[starts] = len(lengths) + np.arange(len(first))
            flat, lengths = np.concatenate([flat, *first]), np.concatenate((lengths, [len(f) for f in first])).astype(np.int64)
            begins = np.cumsum(lengths) - lengths
            sizes = lengths[which]
            ends = np.cumsum(sizes)
            small = np.int32 if ends[-1] < 1 << 31 else np.int64
            at = np.repeat((begins[which] - (ends - sizes)).astype(small), sizes)
            at += np.arange(ends[-1], dtype=small)
            ids = flat.take(at)
            stops = np.append(ends[starts[1:] - 1], ends[-1])
            good = np.nonzero(~odd.to_numpy(zero_copy_only=False))[0].tolist()
            out.update(zip(good, np.split(ids, stops[:-1]), strict=True))
        return [out[i] for i in range(len(texts))]


_encoders: dict[str | None, Encoder] = {}


def encoder_of(path: str | None) -> Encoder:
    """This worker's encoder. (A function of the module, so that tasks share its encoders; what tasks' own functions refer to is
    copied for each task.)"""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def shards(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Written shards ``part, seq, n_tokens, doc_ids, image`` of all texts, ordered by (part, seq) as their documents by doc_id.

    A null or empty text is the end id alone; null ids come first; repeated ids stand side by side, by text; an empty table
    gives no shard. ``tokenizer`` is a path that executors can read (default: the public byte-level BPE).
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([END_ID], encoder.kind)
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            image = build(np.concatenate(parts), np.array(lengths, np.int64))
            row = [[part], [seq], [held], [ids], [image]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "n_tokens", "doc_ids", "image"])

        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                chunk = batch.slice(at, _CHUNK)
                found = encoder.encode(pc.fill_null(chunk.column(1), ""))
                for name, tokens in zip(chunk.column(0).to_pylist(), found, strict=True):
                    ids.append(name)
                    parts += [tokens, end]
                    lengths.append(len(tokens) + 1)
                    held += len(tokens) + 1
                    if held >= shard_tokens:
                        yield close()
                        seq += 1
                        ids, lengths, parts, held = [], [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"compression": "uncompressed", "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1"}
    return written(rows.mapInArrow(encode, SHARDS), "tokens", **options)


def documents(table: DataFrame) -> DataFrame:
    """What the shards hold, read from their images: ``doc_id, start`` (tokens of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as little-endian 32-bit integers)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, ids, image = (batch.column(k)[i].as_py() for k in range(4))
                shard = Wavelet(image)
                tokens, lengths = shard.tokens().astype("<u4"), shard.lengths.astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                sums = [zlib.crc32(tokens[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                k = len(ids)
                columns = [[part] * k, [seq] * k, ids, starts, lengths, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = table.select("part", "seq", "doc_ids", "image").mapInArrow(
        read, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    # Two levels of prefix sums over counts only: parts, then the shards of a part.
    sizes = table.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("base"))
    inner = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("inner"))
    starts = inner.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("begin"))
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
