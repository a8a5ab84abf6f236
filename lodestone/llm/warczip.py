"""Web archives inside ZIP packages: written by tasks, and read again by ranges, without unpacking.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (a gzip member for each WARC record),
``indexes/index.cdxj`` (a line for each record: where it lies) and ``datapackage.json``. A reader takes the end of the file, the central
directory that it names (ZIP64 where sizes or places need it), the index, and then only the ranges of the records wanted: stage by
stage rows of paths become rows of ranges, which are dealt to tasks, and records.

Packages are files that tasks write and read themselves, through ``pyarrow.fs``, so the folder's address must be one that it knows (file, hdfs, s3, gs or a
mounted path). Each attempt of a task writes under a name of its own, and only names that the job's table holds are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import folder, looked_up, written

#: Bytes of records at which a package is closed.
PACKAGE_BYTES = 128 << 20
#: Bytes of an archive whose records one row of the dealing keeps together, and that are read at a time.
RANGE_BYTES = 4 << 20
#: Payload bytes in a batch of records read.
_BATCH_BYTES = 8 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: The profile of revisits, and a date for pages that have none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

_MANIFEST = "path string, n_records long, n_bytes long"
_RANGES = "path string, at long, length long"
RECORDS = "record_type string, key string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def sha1_name(digest: bytes) -> str:
    """A SHA-1 as archives write it: base 32, upper case."""
    return base64.b32encode(digest).decode()


# Records


def _record(kind: str, key: str | None, url: str | None, sha1: bytes, n_bytes: int, refers: str | None, payload: bytes | None) -> bytes:
    """A WARC record. Revisits hold the HTTP header of what they refer to, which tells its length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = lambda k: "null" if k is None else quote(k, safe="")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{name(key)}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=_URI)}", f"WARC-Payload-Digest: sha1:{sha1_name(sha1)}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if key is not None:
        head.append(f"X-Key: {name(key)}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response:{name(refers)}')}>")
        if refers is not None:
            head.append(f"X-Refers-To-Key: {name(refers)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What stays as it is in an address: all but control characters, spaces, quotes and what is not ASCII.
_URI = "%/:?#[]@!$&'()*+,;=~-._|{}^`\\"


def parsed(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields (names in lower case), its block's HTTP header and what follows that."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    return fields, http, body


# Packages


class _Package:
    """One ZIP file in the making; records go straight to the store, index lines are kept until the end."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.out = path, store.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(self._info(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines, self.sha = 0, [], hashlib.sha256()

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def add(self, kind: str, url: str | None, sha1: bytes, record: bytes) -> None:
        squeezed = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = squeezed.compress(record) + squeezed.flush()
        self.member.write(data)
        self.sha.update(data)
        place = {"url": url or "", "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{sha1_name(sha1)}", "length": str(len(data)), "offset": str(self.size), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{_surt(url or '')} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(sorted(self.lines)).encode()
        self.zip.writestr(self._info(INDEX), index)
        parts = [(ARCHIVE, self.size, self.sha.hexdigest()), (INDEX, len(index), hashlib.sha256(index).hexdigest())]
        described = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": p.rpartition("/")[2], "path": p, "bytes": n, "hash": f"sha256:{h}"} for p, n, h in parts]}
        self.zip.writestr(self._info("datapackage.json"), json.dumps(described, indent=1))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.size


def _surt(url: str) -> str:
    """An address as an index sorts it: the host's labels from the last to the first, then the path."""
    host, _, path = re.sub(r"^[a-z][a-z0-9+.-]*://", "", quote(url, safe=_URI).lower()).partition("/")
    return ",".join(reversed(host.split(":")[0].split("."))) + ")/" + path


def packages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Written ``path, n_records, n_bytes`` of the packages that hold a WARC record for each row of ``pages``.

    The payload is the body in UTF-8, a null one empty. Of rows with equal payloads (by SHA-1) of at least ``least_bytes`` the one of the largest key (null
    is smaller than any; of equal ones the largest address) is a response and the others revisit it; those with smaller payloads are all responses. Repeated rows have a record
    each. An empty table gives no package. Payloads are shuffled once for each distinct one, so copies weigh nothing; revisits travel without.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{body}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("key", "url", F.unhex(F.sha1("payload")).alias("sha1"), F.length("payload").cast("long").alias("n_bytes"), "payload")
    text = lambda c: F.col(c).cast("string")
    large = rows.where(F.col("n_bytes") >= least_bytes)
    most = F.max(F.struct("key", "url")).alias("most")
    responses = large.groupBy("sha1", "n_bytes").agg(most, F.first("payload").alias("payload"))
    out = responses.select(F.lit("response").alias("kind"), text("most.key").alias("key"), "most.url", "sha1", "n_bytes", F.lit(None).cast("string").alias("refers"), "payload")
    if least_bytes > 0:
        small = rows.where(F.col("n_bytes") < least_bytes)
        out = out.unionByName(small.select(F.lit("response").alias("kind"), text("key").alias("key"), "url", "sha1", "n_bytes", F.lit(None).cast("string").alias("refers"), "payload"))
    # Revisits: rows beside the response's own. Equal rows are counted, then put out as often as they are too many.
    slim = written(large.select("key", "url", "sha1", "n_bytes").groupBy("key", "url", "sha1", "n_bytes").agg(F.count(F.lit(1)).alias("n")), "slim")
    origins = slim.groupBy("sha1", "n_bytes").agg(most, F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_all"))
    origins = written(origins.where("n_all > 1"), "origins")
    total = origins.agg(F.sum("n_rows")).first()[0] or 0
    met = looked_up(slim, origins.drop("n_all"), ["sha1", "n_bytes"], "n_rows", total).where("most IS NOT NULL")
    extra = F.col("n") - F.when(F.col("key").eqNullSafe(F.col("most.key")) & F.col("url").eqNullSafe(F.col("most.url")), 1).otherwise(0)
    met = met.withColumn("extra", extra).where("extra > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("extra"))).alias("copy"))
    revisits = met.select(F.lit("revisit").alias("kind"), text("key").alias("key"), "url", "sha1", "n_bytes", text("most.key").alias("refers"), F.lit(None).cast("binary").alias("payload"))
    at = folder(pages.sparkSession, "packages")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        package, n = None, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in package.close()], names=["path", "n_records", "n_bytes"])

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(7)), strict=True):
                kind, name, address, sha1, size, refers, payload = (x.as_py() for x in row)
                if package is None:
                    package = _Package(f"{at}/part-{context.partitionId():05d}-{n:04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz")
                    n += 1
                package.add(kind, address, sha1, _record(kind, name, address, sha1, size, refers, payload))
                if package.size >= package_bytes:
                    yield closed()
                    package = None
        if package is not None:
            yield closed()

    return written(out.unionByName(revisits).mapInArrow(put, _MANIFEST), "manifest")


# Reading


def directory(file: pa.NativeFile, size: int) -> dict[str, tuple[int, int, int]]:
    """Of each member of an open ZIP file: where its bytes begin, how many they are, and how they are packed (0: stored)."""

    def at(place: int, n: int) -> bytes:
        got = file.read_at(n, place)
        if len(got) != n:
            raise ValueError("the package ends too early")
        return got

    tail_at = max(0, size - 65_557)  # the end record is 22 bytes, a comment up to 65,535
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and at(locator, 4) == b"PK\x06\x07":
        (place,) = struct.unpack("<Q", at(locator + 8, 8))
        record = at(place, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is not where its locator says")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    entries, out, i = at(start, length), {}, 0
    for _ in range(n):
        if entries[i : i + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", entries, i + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", entries, i + 20)
        (header,) = struct.unpack_from("<I", entries, i + 42)
        name = entries[i + 46 : i + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, j = entries[i + 46 + n_name : i + 46 + n_name + n_extra], 0
        while j + 4 <= len(extra):
            kind, held = struct.unpack_from("<HH", extra, j)
            if kind == 1:  # ZIP64: eight bytes for each value that does not fit, in this order
                wide = iter(struct.unpack_from(f"<{held // 8}Q", extra, j + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            j += 4 + held
        local = at(header, 30)
        out[name] = header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method
        i += 46 + n_name + n_extra + n_comment
    return out


def _lines(file: pa.NativeFile, begin: int, length: int) -> Iterator[bytes]:
    rest = b""
    for i in range(0, length, RANGE_BYTES):
        *whole, rest = (rest + file.read_at(min(RANGE_BYTES, length - i), begin + i)).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _walked(file: pa.NativeFile, begin: int, length: int) -> Iterator[tuple[int, int]]:
    """Places and lengths of the gzip members of an archive that no index describes."""
    start = place = 0
    unpack = zlib.decompressobj(31)
    while place < length:
        data = file.read_at(min(RANGE_BYTES, length - place), begin + place)
        place += len(data)
        while data:
            unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                yield start, place - len(data) - start
                start, unpack = place - len(data), zlib.decompressobj(31)


def ranges(manifest: DataFrame) -> DataFrame:
    """``path, at, length`` of every record of the packages in ``manifest(path)``, from their indexes (an archive without one is walked through).

    Archives must be stored members; one that the ZIP compresses cannot be read by ranges and raises ``ValueError``.
    """

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    members = directory(file, file.size())
                    archives = {n: m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
                    if any(m[2] for m in archives.values()):
                        raise ValueError(f"{path}: an archive is compressed inside the package")
                    told, places = set(), []
                    for name, (begin, length, method) in members.items():
                        if not (name.startswith("indexes/") and name.endswith(".cdxj")) or method:
                            continue
                        for line in _lines(file, begin, length):
                            if b"{" in line:
                                entry = json.loads(line[line.index(b"{") :])
                                told.add(entry["filename"])
                                places.append((archives[f"archive/{entry['filename']}"][0] + int(entry["offset"]), int(entry["length"])))
                    for name, (begin, length, _) in archives.items():
                        if name.removeprefix("archive/") not in told:
                            places += [(begin + i, n) for i, n in _walked(file, begin, length)]
                for i in range(0, len(places), 10_000):
                    part = places[i : i + 10_000]
                    columns = [pa.array([path] * len(part)), pa.array([p for p, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "at", "length"])

    return manifest.select("path").mapInArrow(found, _RANGES)


def records(places: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (``RECORDS``) at ``places(path, at, length)``; without ``payloads`` that column is null.

    Payload digests and lengths are taken from the payload itself where the record has one, and a digest that differs from the record's own raises ``ValueError``;
    revisits carry both. Neighbouring ranges are read together.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, begin, held, rows, size = None, None, 0, b"", [], 0

        def out() -> pa.RecordBatch:
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

        for batch in batches:
            for name, at, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name != path:
                    if file is not None:
                        file.close()
                    store, place = fs.FileSystem.from_uri(name)
                    path, file, held, begin = name, store.open_input_file(place), b"", 0
                if not (begin <= at and at + length <= begin + len(held)):
                    begin, held = at, file.read_at(max(length, RANGE_BYTES), at)
                data = held[at - begin : at - begin + length]
                fields, http, body = parsed(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
                kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind == "revisit":
                    told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    digest, n_bytes, body = said, int(told[1]) if told else None, None
                else:
                    digest, n_bytes = sha1_name(hashlib.sha1(body).digest()), len(body)
                    if said not in (None, digest):
                        raise ValueError(f"{name} at {at}: the payload is not the one that its digest names")
                unquoted = [None if v is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), v).encode("latin-1", "replace").decode("utf-8", "replace") for v in (fields.get("x-key"), fields.get("x-refers-to-key"))]
                rows.append((kind, unquoted[0], fields.get("warc-target-uri"), digest, n_bytes, unquoted[1], body if payloads else None))
                size += n_bytes if payloads and body else 0
                if size >= _BATCH_BYTES or len(rows) >= 10_000:
                    yield out()
                    rows, size = [], 0
        if file is not None:
            file.close()
        if rows:
            yield out()

    dealt = places.select("path", "at", "length").repartition("path", F.floor(F.col("at") / RANGE_BYTES)).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(read, RECORDS)
