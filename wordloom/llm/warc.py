"""WARC files: a writer, and a reader that recovers what lies behind damage and logs what it passes over."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/"
#: The version lines that there have been.
_VERSION_LINE = re.compile(rb"WARC/[01]\.\d+[ \t]*")
#: Bytes read at once.
CHUNK = 1 << 20
#: Bytes inflated at once; a body longer than ``HELD`` is checked before it is held in memory; a binary value of Spark has at most ``LARGEST``.
BLOCK, HELD, LARGEST = 1 << 16, 1 << 26, (1 << 31) - 64
CUT, BAD = "cut short", "bad gzip member"
SCHEMA = "source string, kind string, offset bigint, length bigint, reason string, record_type string, uri string, headers map<string,string>, body binary"
ARROW = pa.schema([("source", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])


class Damage(Exception):
    """A record that fails a check."""


class Found(NamedTuple):
    """A record, or a gap (``reason`` set): ``length`` bytes from ``offset``."""

    offset: int
    length: int
    reason: str | None
    headers: dict[str, str]
    body: bytes


class Bytes:
    """Random access to a value held in memory; ``File`` has the same for a file."""

    def __init__(self, data: bytes) -> None:
        self._data, self.size = data, len(data)

    def read(self, offset: int, n: int) -> bytes:
        return self._data[offset : offset + n]


class File:
    """A file by its path as Spark names it, which is no URI: blanks, ``#`` and ``%`` stand for themselves."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        scheme, colon, rest = path.partition(":")
        if not colon or "/" in scheme or scheme == "file":
            system, at = fs.LocalFileSystem(), "/" + (rest if colon and "/" not in scheme else path).lstrip("/")
        else:
            system, at = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/@:')}")
        self._file = system.open_input_file(at)
        self.size = self._file.size()

    def read(self, offset: int, n: int) -> bytes:
        return self._file.read_at(min(n, max(self.size - offset, 0)), offset)


def write_record(headers: dict[str, str], body: bytes, *, compress: bool = True, level: int = 1) -> bytes:
    """One record, with its length and digest; compressed, a gzip member of its own. Line ends in header values become blanks."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    lines = ["WARC/1.1", *(f"{k}: {' '.join(str(v).splitlines())}" for k, v in headers.items()), f"WARC-Block-Digest: {digest}", f"Content-Length: {len(body)}", "", ""]
    out = "\r\n".join(lines).encode() + body + b"\r\n\r\n"
    if not compress:
        return out
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(out) + z.flush()


def _head(read: Callable[[int, int], bytes], offset: int) -> bytes:
    """The header block at ``offset`` without its last line ends, of any length. Lines are checked as they come, so that little is read where none is."""
    size, seen = 4096, 0
    while True:
        head = read(offset, size)
        stop = head.find(b"\r\n\r\n", seen)
        whole = head[:stop] if stop >= 0 else head[: max(head.rfind(b"\r\n"), 0)]
        lines = whole.split(b"\r\n")
        if not head.startswith(VERSION) or (whole and not _VERSION_LINE.fullmatch(lines[0])):
            raise Damage("no WARC header")
        if not all(b":" in line for line in lines[1:]):
            raise Damage("bad header line")
        if stop >= 0:
            return whole
        if len(head) < size:
            raise Damage("no WARC header")
        size, seen = 4 * size, max(len(head) - 3, 0)


def _record(read: Callable[[int, int], bytes], offset: int, most: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the plain record at ``offset``, checked."""
    head = _head(read, offset)
    headers: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damage("no content length")
    if (n := int(size)) > most:
        raise Damage("record too long")
    begin, body, sha1 = offset + len(head) + 4, None, hashlib.sha1()
    if n <= HELD:
        body = read(begin, n)
        sha1.update(body)
        short = len(body) < n
    else:
        at = begin
        while at < begin + n and (part := read(at, min(CHUNK, begin + n - at))):
            sha1.update(part)
            at += len(part)
        short = at < begin + n
    end = b"" if short else read(begin + n, 4)
    if len(end) < 4:
        raise Damage(CUT)
    if end != b"\r\n\r\n":
        raise Damage("content length is wrong")
    if value := _sha1(headers):
        want = sha1.digest()
        if value.upper().rstrip("=") != base64.b32encode(want).decode() and value.lower() != want.hex():
            raise Damage("digest differs")
    return headers, read(begin, n) if body is None else body, begin + n + 4


def _sha1(headers: dict[str, str]) -> str | None:
    kind, _, value = headers.get("warc-block-digest", "").partition(":")
    return value if kind.lower() == "sha1" else None


class Member:
    """The inflated content of the gzip member at ``offset``, read in blocks.

    ``read`` may go back as far as the block that ``mark`` was called in. Where nothing more comes, ``fault`` says what is wrong, or
    is null, and ``end`` is where the member ends.
    """

    def __init__(self, source, offset: int) -> None:
        self._source, self._offset, self._sound = source, offset, None
        self._mark = (zlib.decompressobj(31), offset, b"", 0)
        self._back()

    def _back(self) -> None:
        z, self._at, self._left, self._start = self._before = self._mark
        self._z, self._data, self.fault, self.end = z.copy(), b"", None, None

    def _more(self) -> bool:
        if not self._left:
            self._left = self._source.read(self._at, CHUNK if self._at > self._offset else 1 << 14)
            self._at += len(self._left)
        return bool(self._left)

    def _pull(self) -> bool:
        """Take the next block."""
        self._start += len(self._data)
        self._data, parts, n = b"", [], 0
        if self.fault or self._z.eof:
            return False
        self._before = (self._z.copy(), self._at, self._left, self._start)
        while n < BLOCK and not self._z.eof and not self.fault:
            ended, spare = not self._more(), self._z.copy()
            try:
                parts.append(self._z.decompress(self._left, BLOCK - n))
                self._left = self._z.unconsumed_tail
                if ended and not parts[-1] and not self._z.eof:
                    self.fault = CUT
            except zlib.error:
                parts += self._creep(spare)
                self.fault = BAD
            n += len(parts[-1]) if parts else 0
        if self._z.eof:
            self.end = self._at - len(self._z.unused_data)
        self._data = b"".join(parts)
        return bool(self._data)

    def _creep(self, z) -> list[bytes]:
        """What comes before the byte that can't be inflated."""
        parts = []
        for step in (256, 1):
            while self._left:
                spare = z.copy()
                try:
                    parts.append(z.decompress(self._left[:step]))
                except zlib.error:
                    z = spare
                    break
                self._left = self._left[step:]
        return parts

    def read(self, offset: int, n: int) -> bytes:
        if offset < self._start:
            self._back()
        parts = []
        while n > 0:
            if offset >= self._start + len(self._data):
                if not self._pull():
                    break
                continue
            parts.append(self._data[offset - self._start : offset - self._start + n])
            offset, n = offset + len(parts[-1]), n - len(parts[-1])
        return b"".join(parts)

    def mark(self) -> None:
        self._mark = self._before

    def place(self, offset: int) -> int:
        """How far the file has been read when ``offset`` bytes, an end within the present block, are out."""
        z, at, left, start = self._before
        z, need = z.copy(), offset - start
        while need > 0:
            if not left:
                if not (left := self._source.read(at, 1 << 14)):
                    break
                at += len(left)
            try:
                need -= len(z.decompress(left, need))
            except zlib.error:
                break
            left = z.unconsumed_tail
        return at - len(left)

    def find(self, offset: int) -> int:
        """Where the next version line may begin, at ``offset`` or after; the end if there is none."""
        while self.read(offset, 1):
            self.mark()
            data = self.read(offset, CHUNK)
            if (k := data.find(VERSION)) >= 0:
                return offset + k
            offset += max(len(data) - len(VERSION) + 1, 1)
        return offset

    def sound(self) -> bool:
        """Whether the whole member inflates to what its check sum says, as far as it goes: a torn end is no contradiction."""
        if self._sound is None:
            other = Member(self._source, self._offset)
            while other._pull():
                pass
            self._sound = other.fault != BAD
        return self._sound


def _member(source, offset: int, most: int) -> Iterator[Found]:
    """Records and gaps of the gzip member at ``offset``; returns where to go on, and what is wrong there. Without a sound record it raises ``Damage``."""
    inner, at, place, gap, found = Member(source, offset), offset, 0, None, False
    while inner.read(place, 1):
        inner.mark()
        begin = at if gap is None else max(at, inner.place(place))
        try:
            headers, body, stop = _record(inner.read, place, most)
            if not _sha1(headers) and not inner.sound():
                raise Damage(BAD)
        except Damage as e:
            gap = gap or str(e)
            place = inner.find(place + 1)
            continue
        if not inner.read(stop, 1) and inner.fault == BAD and not found and gap is None:
            raise Damage(BAD)
        end = max(begin, inner.place(stop)) if inner.end is None or inner.read(stop, 1) else inner.end
        if gap is not None:
            yield Found(at, begin - at, gap, {}, b"")
        yield Found(begin, end - begin, None, headers, body)
        at, place, gap, found = end, stop, None, True
    if not found:
        raise Damage(inner.fault or gap or "empty member")
    if inner.fault:
        return at, inner.fault
    if gap is not None:
        yield Found(at, inner.end - at, gap, {}, b"")
    return inner.end, None


def _next(source, offset: int) -> int:
    """Where the next gzip member or version line may begin, at ``offset`` or after; the end if there is none."""
    while offset < source.size:
        data = source.read(offset, CHUNK)
        if found := [k for k in (data.find(GZIP), data.find(VERSION)) if k >= 0]:
            return offset + min(found)
        if offset + len(data) >= source.size:
            break
        offset += len(data) - len(VERSION) + 1
    return source.size


def salvage(source, *, max_record: int = LARGEST) -> Iterator[Found]:
    """All valid records of a file, in order, and a gap for each run of bytes that belongs to none.

    Gzip members and plain records may be mixed, and a member may hold any number of records: it is inflated as a stream. A record counts
    if its version line, header lines, content length and closing line ends, and its SHA-1 block digest if it has one, are right, and its
    body has at most ``max_record`` bytes, by default as many as a binary value can. A member's only record, and one without a digest,
    counts only if nothing in the member contradicts its check sum; of a torn member what was sound before the tear stays. After a failed
    check the reader tries every later version line of the member and, from where a member breaks, every later place of the file where a
    member or a version line could begin. Records and gaps cover the file with no overlap; within a member their lengths are of what was
    read of the compressed bytes.
    """
    at, gap, why = 0, None, ""

    def quarantined(end: int) -> Iterator[Found]:
        if gap is not None and end > gap:
            yield Found(gap, end - gap, why, {}, b"")

    while at < source.size:
        try:
            start = source.read(at, len(VERSION))
            if start.startswith(GZIP):
                found = _member(source, at, max_record)
                first = next(found)
                yield from quarantined(at)
                gap = None
                yield first
                at, fault = yield from found
                if fault:
                    gap, why, at = at, fault, _next(source, at)
                continue
            if start == VERSION:
                headers, body, end = _record(source.read, at, max_record)
                record = Found(at, end - at, None, headers, body)
            else:
                raise Damage("no record begins here")
        except Damage as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next(source, at + 1)
        else:
            yield from quarantined(at)
            gap = None
            yield record
            at = end
    yield from quarantined(source.size)


def _rows(name: str | None, found: Iterator[Found]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for f in found:
        gap = f.reason is not None
        if rows and held + len(f.body) > 8 << 20:
            yield _batch(rows)
            rows, held = [], 0
        rows.append((name, "gap" if gap else "record", f.offset, f.length, f.reason, f.headers.get("warc-type"), f.headers.get("warc-target-uri"), None if gap else list(f.headers.items()), None if gap else f.body))
        held += len(f.body)
        if held > 8 << 20 or len(rows) >= 4096:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def read_files(spark: SparkSession, paths: list[str], *, max_record: int = LARGEST) -> DataFrame:
    """Records and gaps of WARC files (paths may have wildcards); see ``SCHEMA``. A file is read by one task, in chunks.

    Records have ``kind`` "record", lower-case header names and the payload in ``body``. Gaps have ``kind`` "gap" and ``reason``; their
    bytes are not repeated. Empty files give no rows. A header given twice has the last value.
    """
    files = spark.read.format("binaryFile").load(paths).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _rows(path, salvage(File(path), max_record=max_record))

    return files.mapInArrow(run, SCHEMA)


def read_payloads(shards: DataFrame, *, name_col: str = "source", payload_col: str = "payload", max_record: int = LARGEST) -> DataFrame:
    """The same for WARC files held in a binary column, one a row. Null and empty ones give no rows; a null name stays null. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if data:
                    yield from _rows(name, salvage(Bytes(data), max_record=max_record))

    held = plain(shards, name=name_col, payload=payload_col).select(F.col("name").cast("string"), "payload")
    return held.mapInArrow(run, SCHEMA)


#: 64 bytes of a member whose writing broke off.
TORN = (GZIP + struct.pack("<BIBB", 0, 0, 0, 255) + hashlib.sha256(b"torn").digest() * 2)[:64]
_SOUND = write_record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:page:0>"}, b"what this record says has since changed\n" * 9, compress=False)
_MEMBER = gzip.compress(_SOUND.replace(b"WARC-Block-Digest", b"X-Digest"), 1, mtime=0)
#: Damage of nine kinds: a torn member; plain records with a changed body, with too short and too long a length, without their end and with a
#: bad header line; a member that holds a record with a changed body; one with a wrong check sum; bytes that only look like beginnings.
DAMAGE = (
    TORN, _SOUND.replace(b"has since", b"had since", 1), _SOUND.replace(b"Content-Length: 360", b"Content-Length: 300"), _SOUND.replace(b"Content-Length: 360", b"Content-Length: 3600"), _SOUND[:-30],
    _SOUND.replace(b"Content-Length:", b"Content-Length"), gzip.compress(_SOUND.replace(b"has since", b"had since", 1), 1, mtime=0), _MEMBER[:-8] + bytes(4) + _MEMBER[-4:], GZIP + b"WARC/1.0\r\n" + bytes(50) + b"WARC/1.1\r\n\r\n" + GZIP,
)


def write_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 8 << 20, torn: Callable[[int | None], bool | bytes] | None = None) -> DataFrame:
    """Pages as WARC resource records: ``source`` and ``payload``, a file of about ``shard_bytes`` each. Nothing is shuffled.

    ``torn`` names the pages before whose record a broken member, or the bytes that it returns, are written, to try the reader. A null id, URL or text has no header, or an
    ``X-Null`` header, and is null again in ``read_pages``. Repeated rows are written as often as they occur. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"source": [f"part-{part:05}-{n:05}.warc.gz"], "payload": [b"".join(held)]})

        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers = {"WARC-Type": "resource", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "text/html; charset=utf-8"}
                if page is not None:
                    headers["WARC-Record-ID"] = f"<urn:page:{page}>"
                if url is not None:
                    plainly = url.isprintable() and url == url.strip()
                    headers["WARC-Target-URI"] = url if plainly else "data:;base64," + base64.b64encode(url.encode()).decode()
                    if not plainly:
                        headers["X-Encoded"] = "uri"
                if html is None:
                    headers["X-Null"] = "body"
                if torn and (damage := torn(page)):
                    held.append(TORN if damage is True else damage)
                held.append(write_record(headers, (html or "").encode()))
                size += len(held[-1])
                if size >= shard_bytes:
                    yield shard()
                    n, held, size = n + 1, [], 0
        if held:
            yield shard()

    held = plain(pages, id=id_col, url=url_col, html=html_col).select("id", F.col("url").cast("string"), F.col("html").cast("string"))
    return held.mapInArrow(run, "source string, payload binary")


def read_pages(records: DataFrame) -> DataFrame:
    """``kind``, ``page_id``, ``url``, ``html`` and ``gap_bytes`` of what ``write_pages`` wrote and a reader found."""
    uri = F.when(F.col("headers")["x-encoded"] == "uri", F.unbase64(F.substring_index("uri", ",", -1)).cast("string")).otherwise(F.col("uri"))
    record = F.col("kind") == "record"
    return records.select(
        "kind",
        F.regexp_extract(F.col("headers")["warc-record-id"], r"<urn:page:(-?\d+)>", 1).try_cast("bigint").alias("page_id"),
        F.coalesce(uri, F.when(F.col("headers")["x-encoded"] == "uri", F.lit(""))).alias("url"),
        F.when(record & F.col("headers")["x-null"].isNull(), F.col("body").cast("string")).alias("html"),
        F.when(~record, F.col("length")).alias("gap_bytes"),
    )
