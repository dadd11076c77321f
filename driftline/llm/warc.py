"""WARC archives: a writer, and a reader that splits compressed archives without an index.

Each record is written as a gzip member of its own; the reader also takes members of several records.
A task of the reader owns the members that start inside its byte range: it scans the range for gzip
magic, takes the first place where a whole member decodes to records (headers, lengths and checksum hold,
and another member or the end follows), and from there goes from member to member, past the end of its
range if one does. Members are decoded a bounded piece at a time: payloads are hashed as they pass, and
kept only where asked for, up to a bound.

A member that is none, where one must begin, is a corrupt stretch: it is an error, or a row of its own
and the search goes on behind it. The task that owns the member before it tells of it, so each is told
once.

Archives are written and read through the file system of their path (local or shared mounts, HDFS,
object stores), whole files under a name of the attempt and then renamed, so that a task that is lost
and run again leaves one copy in the manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, slices, small_side

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes of a reading task's range, of a read, of a record's headers and of a kept payload at most.
SPLIT = 8 << 20
READ = 1 << 18
HEADERS = 1 << 16
PAYLOAD = 64 << 20
#: Records of a member that wait for its checksum.
HELD = 16
#: Reading tasks at most; beyond it a task has several ranges.
TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed: a response, or a revisit (of the record of page refers_to) without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    # a header is one line
    target = " ".join((url or "").split()) or "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Corrupt(ValueError):
    """Bytes that are no member of records."""


@dataclass
class Record:
    offset: int  # of its member
    part: int  # its place in the member
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    sha256: str = ""
    payload: bytes | None = None  # if asked for and within bounds


class _Member:
    """The contents of the gzip member at `at`, a bounded piece at a time; Corrupt where they end too soon."""

    def __init__(self, read: Callable[[int, int], bytes], at: int, size: int):
        self.read, self.pos, self.size = read, at, size
        self.inflate, self.raw, self.buffer = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Add to the buffer; False at the end of the member."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.read(self.pos, min(READ, self.size - self.pos)) if self.pos < self.size else b""
                if not self.raw:
                    raise Corrupt("member without end")
                self.pos += len(self.raw)
            try:
                got = self.inflate.decompress(self.raw, READ)
            except zlib.error as e:
                raise Corrupt(str(e)) from e
            self.raw = self.inflate.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def head(self, most: int) -> bytes | None:
        """What stands before the next empty line, taken off the buffer; None if none begins in `most` bytes."""
        while True:
            i = self.buffer.find(b"\r\n\r\n", 0, most + 4)
            if i >= 0:
                out, self.buffer = self.buffer[:i], self.buffer[i + 4 :]
                return out
            if len(self.buffer) > most or not self.more():
                return None

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise Corrupt("record without end")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece

    @property
    def end(self) -> int:
        return self.pos - len(self.inflate.unused_data)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records_at(read: Callable[[int, int], bytes], at: int, size: int, keep: int = 0) -> Iterator[Record | int]:
    """The records of the member at `at`, then its end; payloads of up to `keep` bytes are kept. Corrupt if it is no such member."""
    own, part = _Member(read, at, size), 0
    while True:
        own.buffer = own.buffer.lstrip(b"\r\n")
        while len(own.buffer) < 7 and own.more():
            own.buffer = own.buffer.lstrip(b"\r\n")
        if not own.buffer and part:
            yield own.end
            return
        head = own.head(HEADERS) if own.buffer.startswith(b"WARC/1.") else None
        if head is None:
            raise Corrupt("no record header")
        headers = _fields(head.split(b"\r\n")[1:])
        length = headers.get("content-length", "")
        if not length.isascii() or not length.isdigit():
            raise Corrupt("record without length")
        record, left = Record(at, part, headers), int(length)
        hashed, kept = hashlib.sha256(), [] if keep else None
        pieces = own.take(left)
        first = b""
        if headers.get("content-type", "").startswith("application/http"):
            for piece in pieces:  # the payload begins behind the HTTP header, if there is one
                first += piece
                i = first.find(b"\r\n\r\n")
                if i >= 0:
                    record.http, first = _fields(first[:i].split(b"\r\n")[1:]), first[i + 4 :]
                    break
                if len(first) > HEADERS:
                    break
        for piece in _chain(first, pieces):
            record.payload_bytes += len(piece)
            hashed.update(piece)
            if kept is not None and record.payload_bytes <= keep:
                kept.append(piece)
        record.sha256 = hashed.hexdigest()
        if kept is not None and record.payload_bytes <= keep:
            record.payload = b"".join(kept)
        yield record
        part += 1


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    if first:
        yield first
    yield from rest


def _follows(read: Callable[[int, int], bytes], at: int, size: int) -> bool:
    """Whether the member at `at` decodes wholly to records, and a member or the end follows."""
    try:
        for x in records_at(read, at, size):
            end = x
    except Corrupt:
        return False
    return end >= size or read(end, 3) == MAGIC


def _begins(read: Callable[[int, int], bytes], at: int, size: int) -> bool:
    """Whether a record's header can be read off the start of a member at `at`."""
    own = _Member(read, at, size)
    try:
        while len(own.buffer) < 7 and own.more():
            pass
    except Corrupt:
        return False
    return own.buffer.startswith(b"WARC/1.")


def read_range(read: Callable[[int, int], bytes], size: int, start: int, end: int, keep: int = 0) -> Iterator[Record | Corrupt]:
    """Records whose members start in [start, end) of an archive of `size` bytes; read(at, n) gives its bytes.

    A corrupt stretch behind a member of the range, or at the start of the archive, is a Corrupt with
    its place as second argument.
    """
    at, sure = start, start == 0
    while at < min(end, size):
        if not sure:  # look for a member; a magic may lie across two reads
            raw = read(at, min(READ, size - at))
            i = raw.find(MAGIC)
            if i < 0:
                at += max(1, len(raw) - len(MAGIC) + 1)
                continue
            at += i
            if at >= end:
                return
            if not _follows(read, at, size):
                at += 1
                continue
        held: deque[Record] = deque()  # until the member's checksum has held, or many more records have come
        try:
            for x in records_at(read, at, size, keep):
                if isinstance(x, int):
                    at, sure = x, True
                    yield from held
                else:
                    held.append(x)
                    if len(held) > HELD:
                        yield held.popleft()
        except Corrupt as e:
            yield Corrupt(str(e), at)
            at, sure = at + 1, False
    if sure and end <= at < size and not _begins(read, at, size):
        yield Corrupt("no member", at)


def _open(path: str):
    fs, where = pafs.FileSystem.from_uri(path)
    return fs, where


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", tag: str = ""
) -> DataFrame:
    """Write a record for each page under path; returns the manifest (path, bytes, records), a row for each archive.

    Of pages with equal payloads of LEAST_REVISIT bytes and more, those of the smallest page_id are
    responses and the others revisits of it. A null html is an empty payload; a null page_id never is
    the smallest, unless all are, and then all are responses; several rows of one page_id are a record each,
    of equal payloads all of the smallest page_id are responses; a very long page is one record, written whole;
    an empty table writes no archive; other columns are not read.
    """
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # digests only are counted and moved, unless those that repeat are many
    first = (
        rows.filter(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("digest", "first")
    )
    first = small_side(materialize(first, "warc-first", tag))
    told = rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _open(path)
        fs.create_dir(where, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in slices(batches):
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{where}/.{name}", compression=None)
                data = member(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            fs.move(f"{where}/.{name}", f"{where}/{name}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{path}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"]
            )

    return materialize(told.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest", tag)


RECORDS = (
    "path string, offset long, part int, record_type string, record_id string, refers_to string, target_uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read_warc(archives: DataFrame, split: int = SPLIT, errors: str = "raise", payloads: bool = False, most: int = PAYLOAD) -> DataFrame:
    """Records of archives (path, bytes), as RECORDS; offset is of a record's member, part its place there.

    payload_bytes and payload_digest (hex SHA-256) are of the whole payload, however long: of other
    records as read, of revisits as their headers tell. payloads asks for the payloads themselves, null
    where longer than `most` bytes. Ids are text as they stand, without angle brackets, null if absent.
    errors: raise, or report, which gives a corrupt stretch a row of record_type corrupt whose target_uri
    says what is wrong. archives without records, and an empty table, give no rows.
    """
    if errors not in ("raise", "report"):
        raise ValueError(errors)
    number = F.ceil(F.col("bytes") / F.lit(split))
    tasks = archives.agg(F.coalesce(F.sum(number), F.lit(0))).first()[0]
    ranges = archives.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start")
    ).repartition(max(1, min(TASKS, int(tasks))))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORDS.split(", ")]
    keep = most if payloads else 0

    def bare(urn: str | None) -> str | None:
        return urn.strip().removeprefix("<").removesuffix(">") if urn else None

    def row(path: str, r: Record | Corrupt) -> tuple:
        if isinstance(r, Corrupt):
            if errors == "raise":
                raise ValueError(f"{path} at byte {r.args[1]}: {r.args[0]}")
            return (path, r.args[1], None, "corrupt", None, None, r.args[0], None, None, None)
        size, digest = r.payload_bytes, r.sha256
        if r.headers.get("warc-type") == "revisit":
            told = r.http.get("content-length", "")
            size = int(told) if told.isascii() and told.isdigit() else size
            digest = r.headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
        ids = (bare(r.headers.get("warc-record-id")), bare(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri"))
        return (path, r.offset, r.part, r.headers.get("warc-type"), *ids, size, digest, r.payload)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.to_pylist():
                fs, where = _open(own["path"])
                rows, held = [], 0
                with fs.open_input_file(where) as file:
                    for r in read_range(lambda at, n, file=file: file.read_at(n, at), own["bytes"], own["start"], own["start"] + split, keep):
                        rows.append(row(own["path"], r))
                        held += 200 + len(rows[-1][-1] or b"")
                        if held > READ:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(run, RECORDS)


def warc_digest(pages: DataFrame, tag: str = "") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives written to the shared folder and read back."""
    spark: SparkSession = pages.sparkSession
    archives = write_warc(pages, scratch_path(spark, "warc", tag), tag=tag)
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*)$", 1), F.lit("")).cast("long")
    return read_warc(archives).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
