"""Wavelet matrices of token ids: one self-contained compressed file image for each shard.

Layout of an image (little-endian): a header of ``MAGIC``, counts and a directory of blocks, the sorted alphabet of the shard's
ids (u32), the documents' token counts (u32), and then, level by level, blocks of ``BLOCK`` bits, each compressed by itself. The
directory gives each block's offset and the ones before it, so rank, select and access touch one block a level.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import zstandard

MAGIC = b"WVMX1\0\0\0"
BLOCK = 1 << 16
HEAD = struct.Struct("<8sQIIII")


def build(ids: np.ndarray, lengths: np.ndarray, level: int = 1) -> bytes:
    """The image of a shard: ``ids`` of all its documents end to end, and each document's token count."""
    n = len(ids)
    present = np.bincount(ids, minlength=1) if n else np.zeros(0, np.int64)
    alphabet = np.nonzero(present)[0].astype(np.uint32)
    code = np.zeros(len(present), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    rows = code[ids]
    depth = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    squeeze = zstandard.ZstdCompressor(level=level)
    blocks, ones = [], []
    for bit in range(depth - 1, -1, -1):
        flags = (rows & rows.dtype.type(1 << bit)) != 0
        for at in range(0, n, BLOCK):
            part = flags[at : at + BLOCK]
            ones.append(int(np.count_nonzero(part)))
            blocks.append(squeeze.compress(np.packbits(part, bitorder="little").tobytes()))
        rows = np.concatenate((np.compress(~flags, rows), np.compress(flags, rows)))
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.uint64)
    head = HEAD.pack(MAGIC, n, depth, len(alphabet), len(lengths), len(blocks))
    parts = [head, offsets.tobytes(), np.array(ones, np.uint32).tobytes(), alphabet.tobytes(), np.asarray(lengths, np.uint32).tobytes(), *blocks]
    return b"".join(parts)


@dataclass
class Wavelet:
    """A shard read from its image."""

    image: bytes

    def __post_init__(self) -> None:
        magic, self.n, self.depth, letters, docs, blocks = HEAD.unpack_from(self.image)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix image")
        at = HEAD.size
        take = lambda kind, k, at: (np.frombuffer(self.image, kind, k, at), at + np.dtype(kind).itemsize * k)
        self.offsets, at = take("<u8", blocks + 1, at)
        ones, at = take("<u4", blocks, at)
        self.alphabet, at = take("<u4", letters, at)
        self.lengths, self.body = take("<u4", docs, at)
        self.per_level = -(-self.n // BLOCK)
        by_level = ones.reshape(self.depth, self.per_level).astype(np.int64) if self.depth else np.zeros((0, 0), np.int64)
        self.before = np.concatenate((np.zeros((self.depth, 1), np.int64), np.cumsum(by_level, axis=1)), axis=1)
        self.zeros = self.n - self.before[:, -1] if self.depth else np.zeros(0, np.int64)
        self._kept: tuple[int, np.ndarray] | None = None

    def _block(self, level: int, k: int) -> np.ndarray:
        i = level * self.per_level + k
        if self._kept and self._kept[0] == i:
            return self._kept[1]
        raw = self.image[self.body + int(self.offsets[i]) : self.body + int(self.offsets[i + 1])]
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), bitorder="little")
        bits = bits[: min(BLOCK, self.n - k * BLOCK)]
        self._kept = (i, bits)
        return bits

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a level."""
        k, rest = divmod(i, BLOCK)
        return int(self.before[level, k]) + (int(self._block(level, k)[:rest].sum(dtype=np.int64)) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a level."""
        before = self.before[level]
        counts = before if bit else np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(counts, k, side="right")) - 1
        return block * BLOCK + int(np.nonzero(self._block(level, block) == bit)[0][k - int(counts[block])])

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.depth):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.depth):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if code >> (self.depth - 1 - level) & 1:
                start, stop = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token stands in places ``start`` to ``stop``."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, start, self.n if stop is None else stop)
        return b - a

    def find(self, token: int, k: int) -> int | None:
        """Place of the token's k-th occurrence (from 0), if there is one."""
        code = self._code(token)
        if code is None:
            return None
        start, stop = self._range(code, 0, self.n)
        if not 0 <= k < stop - start:
            return None
        i = start + k
        for level in range(self.depth - 1, -1, -1):
            bit = code >> (self.depth - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        rows = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        places = np.arange(self.n)
        for level in range(self.depth - 1, -1, -1):
            flags = np.concatenate([self._block(level, k) for k in range(self.per_level)]).view(bool)
            zeros = int(self.zeros[level])
            rows[zeros:] |= rows.dtype.type(1 << (self.depth - 1 - level))
            upper = np.empty_like(rows)
            upper[np.compress(~flags, places)] = rows[:zeros]
            upper[np.compress(flags, places)] = rows[zeros:]
            rows = upper
        return self.alphabet[rows] if self.n else np.zeros(0, np.uint32)
