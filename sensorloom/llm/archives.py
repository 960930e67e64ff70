"""Legacy web archives: ARC files are parsed and converted to equivalent WARC files.

An ARC file is a chain of records: a header line, the declared number of bytes, a
line feed. It is plain, or compressed as a whole or with a gzip member for each record. The
first record (``filedesc://``) names the version, which tells the fields of the header lines:

* version 1: ``URL IP-address Archive-date Content-type Archive-length``
* version 2: ``URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length``

The converter reads headers by the version's fields and bodies by the declared
lengths, and writes WARC/1.1 records with synthesised identifiers (a name-based UUID of
the file and the record's number in it), ISO timestamps, types and SHA-1 digests:
a body with an HTTP header is a response, any other a resource of the ARC's content type.
The first record of equal payloads is a ``response``, the others are ``revisit``
records that refer to it. Files are bounded in size and written straight from the tasks to a
folder that all executors share, under a temporary name first, so that a task
that is run again leaves the same files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, new_folder

# URLs and content types of old crawlers may hold blanks, so the date and the fields at the end tell where they stop
_HEADERS = {
    1: re.compile(rb"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.+) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<type>.+) (?P<status>\S+) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\S+) (?P<file>\S+) (?P<length>\d+)"),
}
_NAMES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
FILE_BYTES = 16 << 20
DATE = "20240101000000"
_ID_HEADER = b"X-Sensorloom-Page-Id: "
_OWN_ID = re.compile(rb"\r\nX-Sensorloom-Page-Id: (-?\d{1,19})\r\n")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then move to ``uri``."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own, compression=None) as out:
        out.write(data)
    system.move(own, path)


class _Files:
    """Numbered files of bounded size of one partition."""

    def __init__(self, folder: str, suffix: str, limit: int):
        from pyspark import TaskContext

        self.folder, self.suffix, self.limit = folder, suffix, limit
        self.part, self.number, self.parts, self.size = TaskContext.get().partitionId(), 0, [], 0

    @property
    def name(self) -> str:
        return f"{self.part:06d}-{self.number:05d}{self.suffix}"

    def add(self, member: bytes) -> None:
        self.parts.append(member)
        self.size += len(member)

    def full(self) -> bool:
        return self.size >= self.limit

    def close(self) -> str | None:
        if not self.parts:
            return None
        name = self.name
        write_file(f"{self.folder}/{name}", b"".join(self.parts))
        self.number, self.parts, self.size = self.number + 1, [], 0
        return name


def _field(text: str | None) -> bytes:
    """A header field: no blanks or line ends inside."""
    return b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes([c]) for c in (text or "").encode()) or b"-"


def arc_header(version: int, url: bytes, length: int, file: str, offset: int, checksum: str, kind: bytes = b"text/html", date: bytes = b"20240101000000", status: int = 200) -> bytes:
    head = [url, b"0.0.0.0", date, kind]
    if version == 2:
        head += [b"%d" % status, checksum.encode(), b"-", b"%d" % offset, file.encode()]
    return b" ".join([*head, b"%d" % length]) + b"\n"


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1, file_bytes: int = FILE_BYTES, date_col: str | None = None) -> DataFrame:
    """ARC files of the pages as HTTP responses; ``file, records`` of each file written. The result must be consumed once. Pages without a date (``date_col``, a timestamp) are of ``DATE``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, records, done = _Files(folder, ".arc.gz", file_bytes), 0, []

        def close() -> None:
            nonlocal records
            if name := files.close():
                done.append((name, records))
            records = 0

        for batch in batches:
            for page, url, html, date in zip(*[batch.column(i) for i in range(4)], strict=True):
                if not files.parts:
                    text = b"%d 0 sensorloom\n%s\n" % (version, _NAMES[version])
                    files.add(gzip.compress(arc_header(version, b"filedesc://" + files.name.encode(), len(text), files.name, 0, "-", b"text/plain") + text + b"\n", 1, mtime=0))
                number = page.as_py()
                payload = (html.as_py() or "").encode()
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if number is None else _ID_HEADER + b"%d\r\n" % number) + b"\r\n" + payload
                head = arc_header(version, _field(url.as_py()), len(body), files.name, files.size, hashlib.md5(body).hexdigest() if version == 2 else "-", date=date.as_py().encode())
                files.add(gzip.compress(head + body + b"\n", 1, mtime=0))
                records += 1
                if files.full():
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["file", "records"])

    date = F.date_format(date_col, "yyyyMMddHHmmss") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(date, F.lit(DATE)).alias("date"))
    return rows.mapInArrow(task, "file string, records bigint")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    view, at, step = memoryview(data), 0, 1 << 13
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + step]  # what is left over of it is copied, so it is short
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        yield b"".join(parts)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """Header fields and body of each record after the version block. Raises ``ValueError`` for headers or lengths that don't fit."""
    more = members(data) if data[:2] == b"\x1f\x8b" else iter([data])
    have, at, header, first = b"", 0, _HEADERS[1], True

    def reach(end: int) -> bool:
        nonlocal have, at
        while len(have) - at < end:
            piece = next(more, None)
            if piece is None:
                return False
            have, at = have[at:] + piece, 0
        return True

    while True:
        while reach(1) and have[at] in b"\r\n":
            at += 1
        if not reach(1):
            return
        while (end_of := have.find(b"\n", at)) < 0:
            if not reach(len(have) - at + 1):
                raise ValueError("an ARC header line is cut off")
        line = have[at:end_of].rstrip(b"\r")
        at = end_of + 1
        version_block = first and line.startswith(b"filedesc://")
        fields = (_HEADERS[1].fullmatch(line) or _HEADERS[2].fullmatch(line)) if version_block else header.fullmatch(line)
        if fields is None:
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        length = int(fields["length"])
        if not reach(length):
            raise ValueError("an ARC record is shorter than declared")
        body, at = have[at : at + length], at + length
        if version_block:
            header = _HEADERS[2 if body.startswith(b"2") else 1]
        else:
            yield fields.groupdict(), body
        first = False


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; all payload if it has none."""
    if body.startswith(b"HTTP/"):
        head, blank, payload = body.partition(b"\r\n\r\n")
        if blank:
            return head + blank, payload
    return b"", body


def _page_id(head: bytes) -> int | None:
    own = _OWN_ID.search(head)
    return int(own[1]) if own and -(1 << 63) <= int(own[1]) < 1 << 63 else None


_RECORD = "file string, number bigint, page_id bigint, url string, date string, payload_bytes bigint, payload_digest string, kind string, body binary"


def read_arc(spark: SparkSession, folder: str, with_body: bool = True) -> DataFrame:
    """One row for each record of the ARC files: file, number in it, id, URL, date, payload length and digest, content type of a body without an HTTP header, and the body (deflated). A file is read whole by one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("number", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("kind", pa.string()), ("body", pa.binary())])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size, name = [], 0, path.as_py().rpartition("/")[2]
                for number, (head, body) in enumerate(parse_arc(content.as_py())):
                    http, payload = http_parts(body)
                    packed = zlib.compress(body, 1) if with_body else None
                    rows.append((name, number, _page_id(http), head["url"].decode("utf-8", "replace"), head["date"].decode(), len(payload), digest(payload), None if http else head["type"].decode("utf-8", "replace"), packed))
                    size += len(packed or b"")
                    if size > FILE_BYTES // 4 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*.arc,*.arc.gz}").load(folder)
    return files.select("path", "content").mapInArrow(task, _RECORD)


def record_id(file: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{number}')}>"


def iso_date(date: str) -> str:
    """ARC's 14 digits (12 in old files) as WARC's date."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, rid: str, url: str, date: str, payload_digest: str, block: bytes, refers: str | None = None, refers_page: int | None = None, page_id: int | None = None, payload_bytes: int = 0, content: str = "application/http; msgtype=response") -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {iso_date(date)}", f"WARC-Target-URI: {url}", f"Content-Type: {content}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Payload-Length: {payload_bytes}"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {refers}"] if refers else []
        head += [f"X-Refers-To-Page: {refers_page}"] if refers_page is not None else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the WARC files of the ARC files' records; ``file, records`` of each. The result must be consumed once.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest
    page id (then file and number) becomes the response.
    """
    records = read_arc(spark, arc_folder)
    same = ["payload_digest", "payload_bytes"]
    keys = read_arc(spark, arc_folder, with_body=False).where(F.col("payload_bytes") >= min_bytes).select(*same, "page_id", "file", "number")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "number")
    # written first, so that Spark can split the records of a very common payload where they meet it
    first = keys.groupBy(*same).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(*same, F.col("first.page_id").alias("to_page"), F.col("first.file").alias("to_file"), F.col("first.number").alias("to_number"))
    revisit = cut(keys.join(cut(first), same).where("file <> to_file or number <> to_number").select("file", "number", "to_page", "to_file", "to_number"))
    rows = records.join(revisit, ["file", "number"], "left").select("file", "number", "page_id", "url", "date", "payload_bytes", "payload_digest", "kind", "body", "to_page", "to_file", "to_number")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, count, done = _Files(warc_folder, ".warc.gz", file_bytes), 0, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                file, number, page, url, date, size, sha, content, packed, to_page, to_file, to_number = (x.as_py() for x in row)
                if not files.parts:
                    info = b"software: sensorloom\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(files.name, -1)}\r\nWARC-Date: {iso_date('20240101')}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    files.add(gzip.compress(head.encode() + info + b"\r\n\r\n", 1, mtime=0))
                body = zlib.decompress(packed)
                rid = record_id(file, number)
                if to_file is None and content is not None:
                    record = warc_record("resource", rid, url, date, sha, body, page_id=page, payload_bytes=size, content=content)
                elif to_file is None:
                    record = warc_record("response", rid, url, date, sha, body, page_id=page, payload_bytes=size)
                else:
                    record = warc_record("revisit", rid, url, date, sha, http_parts(body)[0], record_id(to_file, to_number), to_page, page, size)
                files.add(gzip.compress(record, 1, mtime=0))
                count += 1
                if files.full():
                    done.append((files.close(), count))
                    count = 0
        if files.parts:
            done.append((files.close(), count))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["file", "records"])

    return rows.mapInArrow(task, "file string, records bigint")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record. Raises ``ValueError`` for a length that doesn't fit."""
    for record in members(data):
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        length = int(fields["Content-Length"])
        if len(rest) != length + 4:
            raise ValueError("a WARC record doesn't have its declared length")
        yield fields, rest[:length]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date`` of each response, resource and revisit.

    Length and digest of a response are taken from the payload that was read and must be those
    declared; a revisit has those of its header.
    """
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string())]
    schema = pa.schema(kinds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    kind, sha, size = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "")[5:], int(fields.get("X-Payload-Length", 0))
                    if kind in ("response", "resource"):
                        payload = http_parts(block)[1] if kind == "response" else block
                        if (digest(payload), len(payload)) != (sha, size):
                            raise ValueError("a WARC payload differs from its digest")
                    elif kind != "revisit":
                        continue
                    number, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                    rows.append((None if number is None else int(number), size, sha, kind, None if to is None else int(to), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    spec = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, url string, date string"
    return files.select("content").mapInArrow(task, spec)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_bytes: int = 0, version: int = 1, file_bytes: int = FILE_BYTES, date_col: str | None = None) -> DataFrame:
    """Pages to ARC files, these to WARC files, and what is read back from those: a row for each page.

    Defined cases: a null html is an empty payload; a null URL is written as ``-``; blanks in a URL
    are percent-encoded; rows with a null id are records without an id and come last as
    responses; rows that repeat an id are records of their own. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    for folder in (arc, warc):  # an empty table writes no file
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
    cut(write_arc(pages, arc, id_col, url_col, html_col, version, file_bytes, date_col))
    cut(convert(spark, arc, warc, min_bytes, file_bytes))
    return read_warc(spark, warc).withColumnRenamed("page_id", id_col)
