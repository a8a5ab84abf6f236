"""Multistream wiki dumps, read in parallel: a Spark data source that cuts a compressed file into ranges, reads of single members, and a writer.

A dump is bz2 members one after another, each with about a hundred ``<page>`` elements. Every member starts on a byte with its own marks, so a task given a
range of the file looks for the first member that starts in it and reads on to the last that does; the driver plans from the
file's size alone. An index (``offset:page_id:title``) is only needed to know where the first blocks end, or to read chosen pages.

Files are opened through ``pyarrow.fs``: paths may be local or mounted, ``file:``, ``hdfs:``, ``s3:`` or ``gs:``.
"""

from __future__ import annotations

import bz2
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How a bz2 member with data begins (signature, level, mark of a block).
_MEMBER = re.compile(rb"BZh[1-9]1AY&SY")
_MARK_BYTES = 10
_READ_BYTES = 1 << 20
#: Pages and bytes of text in a batch of rows.
_BATCH_PAGES, _BATCH_BYTES = 500, 8 << 20
#: Compressed bytes for a task where no number of partitions is asked for.
RANGE_BYTES = 64 << 20
PAGES = "block long, id long, ns int, title string, redirect string, text string"
_ARROW = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("ns", pa.int32()), ("title", pa.string()), ("redirect", pa.string()), ("text", pa.string())])


def _opened(path: str) -> pa.NativeFile:
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _files(path: str) -> list[str]:
    """The dump files at a path: itself, or in a folder the ``.bz2`` files that are not indexes."""
    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).is_file:
        return [path]
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.is_file)
    return [f"{path.rstrip('/')}/{n}" for n in names if n.endswith(".bz2") and not n.endswith("-index.txt.bz2")]


def _starts(file: pa.NativeFile, begin: int, end: int) -> Iterator[int]:
    """Places in ``[begin, end)`` where a member's marks stand."""
    size, place, tail = file.size(), begin, b""
    while place < min(size, end + _MARK_BYTES):
        data = file.read_at(min(_READ_BYTES, size - place), place)
        for m in _MEMBER.finditer(tail + data):
            at = place - len(tail) + m.start()
            if at >= end:
                return
            yield at
        place, tail = place + len(data), (tail + data)[-(_MARK_BYTES - 1) :]


def _member(file: pa.NativeFile, begin: int) -> Iterator[bytes | int]:
    """A member's data piece by piece, and last the place behind it."""
    unpack, place = bz2.BZ2Decompressor(), begin
    while not unpack.eof:
        data = file.read_at(_READ_BYTES, place)
        if not data:
            raise EOFError(f"the member at {begin} has no end")
        place += len(data)
        while True:
            piece = unpack.decompress(data, _BATCH_BYTES)
            if piece:
                yield piece
            data = b""
            if unpack.eof or unpack.needs_input:
                break
    yield place - len(unpack.unused_data)


def _pages(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole ``<page>`` elements out of pieces of XML."""
    rest = b""
    for piece in pieces:
        seen = max(0, len(rest) - len(b"</page>"))
        rest += piece
        while (stop := rest.find(b"</page>", seen)) >= 0:
            start = rest.find(b"<page", 0, stop)
            if start >= 0:
                yield rest[start : stop + len(b"</page>")]
            rest, seen = rest[stop + len(b"</page>") :], 0


def _row(block: int, page: bytes) -> tuple:
    x = ElementTree.fromstring(page)
    turned = x.find("redirect")
    return block, int(x.findtext("id")), int(x.findtext("ns")), x.findtext("title"), None if turned is None else turned.get("title"), x.findtext("revision/text") or ""


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= _BATCH_PAGES or size >= _BATCH_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _rows_of(file: pa.NativeFile, begin: int) -> Iterator[tuple | int]:
    """The pages of the member at ``begin`` as rows, and last the place behind it."""
    end: list[int] = []

    def pieces() -> Iterator[bytes]:
        for piece in _member(file, begin):
            if isinstance(piece, int):
                end.append(piece)
            else:
                yield piece

    for page in _pages(pieces()):
        yield _row(begin, page)
    yield end[0]


@dataclass
class Range(InputPartition):
    """Members of a file that start in ``[begin, end)``."""

    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.wanted = int(options.get("partitions", 0))
        self.blocks = int(options["blocks"]) if "blocks" in options else None
        self.index = options.get("index")

    def _end(self, path: str, size: int) -> int:
        """Where the first blocks of a file end. Only so much of the index, or of the file, is read as they take."""
        if self.blocks is None:
            return size
        if self.index:
            seen = -1
            found: list[int] = []
            with _opened(self.index) as raw, bz2.open(raw) if self.index.endswith(".bz2") else raw as lines:
                for line in lines:
                    offset = line.partition(b":")[0]
                    if offset.isdigit() and int(offset) != seen:
                        seen = int(offset)
                        found.append(seen)
                        if len(found) > self.blocks:
                            return seen
            return size
        with _opened(path) as file:
            # The header is a member of its own, so it counts only where it holds pages.
            found = 0
            for at in _starts(file, 0, size):
                if found == self.blocks:
                    return at
                found += any(isinstance(x, tuple) for x in _rows_of(file, at))
        return size

    def partitions(self) -> list[Range]:
        out, files = [], _files(self.path)
        if self.blocks is not None and len(files) > 1:
            raise ValueError("the first blocks are those of one file")
        for path in files:
            with _opened(path) as file:
                size = file.size()
            size = self._end(path, size)
            n = max(1, -(-self.wanted // len(files)) if self.wanted else -(-size // RANGE_BYTES))
            cuts = sorted({size * i // n for i in range(n + 1)})
            out += [Range(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self._rows(partition))

    def _rows(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        with _opened(part.path) as file:
            size = file.size()
            place = next(_starts(file, part.begin, part.end), size)
            while place < part.end and place < size:
                for row in _rows_of(file, place):
                    if isinstance(row, int):
                        place = row
                    else:
                        yield row


class DumpSource(DataSource):
    """``spark.read.format("wikidump")``: ``block, id, ns, title, redirect, text`` of every page; ``block`` is the offset of its member.

    Options: ``path`` (a file, or a folder of them), ``partitions`` (how many tasks; default one for each 64 MB), ``blocks`` (only the first so many
    members with pages: later ranges are not planned), ``index`` (a file of offsets, from which ``blocks`` is then known).
    """

    @classmethod
    def name(cls) -> str:
        return "wikidump"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: object) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def pages(spark: SparkSession, path: str, partitions: int | None = None, blocks: int | None = None, index: str | None = None) -> DataFrame:
    """The pages of a dump (see ``DumpSource``); a missing text is empty."""
    spark.dataSource.register(DumpSource)
    options = {"path": path, "partitions": partitions, "blocks": blocks, "index": index}
    return spark.read.format("wikidump").options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def pages_at(offsets: DataFrame) -> DataFrame:
    """The pages of the members at ``offsets(path, offset)``, each read once: a seek and one member's bytes for each."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            path, file = None, None
            for batch in batches:
                for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name != path:
                        if file is not None:
                            file.close()
                        path, file = name, _opened(name)
                    yield from (x for x in _rows_of(file, offset) if isinstance(x, tuple))
            if file is not None:
                file.close()

        yield from _batches(rows())

    dealt = offsets.select("path", F.col("offset").cast("long").alias("offset")).distinct().sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read, PAGES)


def looked_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages whose exact titles are in ``wanted(title)``, by ``index(path, offset, page_id, title)``: only their members are read."""
    found = index.join(wanted.select("title").distinct(), "title", "left_semi").select("path", "offset", "page_id")
    got = pages_at(found.select("path", "offset"))
    return got.join(found.select(F.col("page_id").alias("id")).distinct(), "id", "left_semi")


def write(rows: DataFrame, folder: str, block_pages: int = 100) -> DataFrame:
    """Write ``rows(id, ns, title, redirect, text)`` as a dump of one file a task under ``folder``; returns its index ``path, offset, page_id, title``, lazily.

    Rows keep their order in a task. Each attempt of a task has a file of its own, so read the files that the index (once written) names.
    """

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name, out, place, held = f"part-{uuid.uuid4().hex}.xml.bz2", None, 0, []

        def closed() -> pa.RecordBatch:
            nonlocal place, held
            data = bz2.compress("".join(x for _, _, x in held).encode())
            out.write(data)
            n, began = len(held), place
            columns = [[f"{folder.rstrip('/')}/{name}"] * n, [began] * n, [i for i, _, _ in held], [t for _, t, _ in held]]
            place, held = place + len(data), []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "offset", "page_id", "title"])

        for batch in batches:
            for i, ns, title, redirect, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    head = bz2.compress(b"<mediawiki>\n")
                    out.write(head)
                    place = len(head)
                turned = "" if redirect is None else f"<redirect title={quoteattr(_clean(redirect))} />"
                held.append((i, title, f"<page><title>{escape(_clean(title))}</title><ns>{ns}</ns><id>{i}</id>{turned}<revision><text xml:space=\"preserve\">{escape(_clean(text or ''), {chr(13): '&#13;'})}</text></revision></page>\n"))
                if len(held) >= block_pages:
                    yield closed()
        if held:
            yield closed()
        if out is not None:
            out.write(bz2.compress(b"</mediawiki>\n"))
            out.close()

    return rows.select("id", "ns", "title", "redirect", "text").mapInArrow(put, "path string, offset long, page_id long, title string")


def _clean(text: str) -> str:
    """Text without characters that XML cannot hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "\ufffd", text)
