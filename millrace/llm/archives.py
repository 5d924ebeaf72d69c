"""Legacy ARC archives to WARC, with identical payloads as revisits.

An ARC file opens with a version block that names the fields of its record
lines; each record is such a line and as many bytes as it declares. The
converter parses both published versions and synthesises what WARC asks for:
record ids from what identifies the capture, timestamps from 12- or 14-digit
dates, types from the content, and SHA-1 digests of payload and block.

Archives are written by Spark's text writer as binary-safe lines, so they go
to any shared store under its commit protocol, and are read as whole files. An
archive is closed once it holds ``ARCHIVE_BYTES`` or ``RECORDS_PER_ARCHIVE``,
so it is larger than the first by one record at most. Which record of equal payloads is the response is found
on (digest, id) alone; payloads are never grouped.

Defined results: null payloads and URLs are empty; null ids are the smallest;
of equal ids one record is the response and the rest revisit it; an empty
table makes archives without records; other columns are not carried. A record
with fewer bytes than declared is marked as truncated. Ids are integers: others
fail the writing job, and in archives from elsewhere they read as null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path, settle

RECORDS_PER_ARCHIVE = 5000
ARCHIVE_BYTES = 64_000_000
# Values given to the writer for an archive, and the bytes from which one is given on.
_LINES = 64
_LINE_BYTES = ARCHIVE_BYTES // _LINES
CRAWL_DATE = "20240102030405"
# The version blocks of the two ARC versions, and WARC's names.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _one_line(text: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), text or "unknown:")


def version_block(name: str, version: int, date: str = CRAWL_DATE) -> bytes:
    body = f"{version} 0 Archive\n{ARC_FIELDS[version]}\n".encode()
    tail = f" 0 - - 0 {name} {len(body)}" if version == 2 else f" {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{tail}\n".encode() + body + b"\n"


def arc_record(url: str, content: bytes, version: int, date: str, offset: int = 0, name: str = "-") -> bytes:
    tail = f" 200 {base32_sha1(content)} - {offset} {name} {len(content)}" if version == 2 else f" {len(content)}"
    return f"{url} 0.0.0.0 {date} text/html{tail}\n".encode() + content + b"\n"


def _http(page_id, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"{PAGE_HEADER}: {page_id}")
    return "\r\n".join([*lines, "", ""]).encode() + payload


class ArchiveLines:
    """Turns records into the values of which the writer makes archives of bounded size.

    The writer starts a file every ``_LINES`` values. A value holds records of
    ``_LINE_BYTES`` or more together; an archive that is full before it has all
    its values gets blank lines, which both formats allow between records.
    """

    def __init__(self, archive_bytes: int = ARCHIVE_BYTES, records: int = RECORDS_PER_ARCHIVE):
        self.archive_bytes, self.records = archive_bytes, records
        self.held: list[bytes] = []
        self.held_bytes = self.lines = self.bytes = self.count = 0

    @property
    def fresh(self) -> bool:
        """Whether the next record starts an archive."""
        return not self.count

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        self.held.append(record)
        self.held_bytes += len(record)
        self.bytes += len(record)
        self.count += 1
        full = self.bytes >= self.archive_bytes or self.count >= self.records
        if full or self.held_bytes >= _LINE_BYTES:
            yield from self.give()
        if full or self.lines == _LINES:
            if self.lines < _LINES:
                yield pa.RecordBatch.from_arrays([pa.array([b""] * (_LINES - self.lines), pa.binary())], names=["line"])
            self.lines = self.bytes = self.count = 0

    def give(self) -> Iterator[pa.RecordBatch]:
        """What is held, as one value; the writer adds the line feed that ends it."""
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(self.held)[:-1]], pa.binary())], names=["line"])
            self.held, self.held_bytes, self.lines = [], 0, self.lines + 1


def _save(lines: DataFrame, path: str) -> str:
    (
        lines.select(F.col("line").cast("string").alias("value"))
        .write.mode("errorifexists").option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", _LINES).text(path)
    )
    return path


def write_arc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = CRAWL_DATE,
    records: int = RECORDS_PER_ARCHIVE,
    archive_bytes: int = ARCHIVE_BYTES,
) -> str:
    """Save pages as ARC files, versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, version, made = ArchiveLines(archive_bytes, records), 1, 0
        for batch in batches:
            for i in range(batch.num_rows):
                owner, address, body = (c[i].as_py() for c in batch.columns)
                block = b""
                if lines.fresh:
                    version, made = 1 + made % 2, made + 1
                    block = version_block(f"pages-{made - 1}.arc", version, date)
                yield from lines.add(block + arc_record(_one_line(address), _http(owner, (body or "").encode()), version, date))
        yield from lines.give()

    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return _save(source.mapInArrow(run, "line binary"), path)


@dataclass(frozen=True)
class ArcRecord:
    """One record of an ARC file, with the fields its version has."""

    fields: dict[str, str]
    content: bytes
    offset: int
    truncated: bool


def _opened(data: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or gzipped, without its version blocks."""
    stream = _opened(data)
    names: list[str] | None = None
    offset = 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue
        if text.startswith("filedesc://"):
            body = stream.read(int(text.rsplit(" ", 1)[1]))
            offset += len(body)
            _, fields = body.decode("ascii").splitlines()[:2]
            names = fields.split(" ")
            continue
        if names is None:
            raise ValueError("an ARC file must start with a version block")
        values = text.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not a record line with {len(names)} fields: {text[:200]!r}")
        fields = dict(zip(names, values, strict=True))
        content = stream.read(int(fields["Archive-length"]))
        offset += len(content)
        yield ArcRecord(fields, content, start, len(content) < int(fields["Archive-length"]))


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block with its blank line, and payload; no header if the content is not HTTP."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, mark, payload = content.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (content, b"")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found.group(1).decode("utf-8", "replace") if found else None


def _number(owner: str | None) -> int | None:
    number = int(owner) if owner and re.fullmatch(r"-?[0-9]{1,19}", owner) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def warc_date(date: str) -> str:
    """ISO time of a 12- or 14-digit ARC date."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, owner: str | None, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([url, date, digest, owner or '', place]))}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _converted(record: ArcRecord, place: str, refers: dict | None) -> bytes:
    head, payload = split_http(record.content)
    digest = base32_sha1(payload)
    url, date = record.fields["URL"], record.fields["Archive-date"]
    kind = "revisit" if refers else "response" if head else "resource"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(url, date, digest, http_field(head, PAGE_HEADER), place)),
        ("WARC-Date", warc_date(date)),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", record.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"]),
    ]
    if record.truncated:
        headers.append(("WARC-Truncated", "unspecified"))
    if refers:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Target-URI", refers["url"]), ("WARC-Refers-To-Date", refers["date"])]
    return warc_record(headers, head if refers else record.content)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row per ARC record: path, offset, page_id, url, date, digest, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                place = batch.column(0)[i].as_py()
                rows = []
                for record in parse_arc(batch.column(1)[i].as_py()):
                    head, payload = split_http(record.content)
                    owner, digest = http_field(head, PAGE_HEADER), base32_sha1(payload)
                    url, date = record.fields["URL"], record.fields["Archive-date"]
                    at = f"{place.rsplit('/', 1)[-1]}:{record.offset}"
                    rows.append((place, record.offset, _number(owner), bool(head), url, warc_date(date), digest, record_id(url, date, digest, owner, at)))
                columns = list(zip(*rows, strict=True)) or [()] * 8
                types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "offset", "page_id", "http", "url", "date", "digest", "id"])

    return _archives(spark, path).mapInArrow(run, "path string, offset long, page_id long, http boolean, url string, date string, digest string, id string")


def convert(spark: SparkSession, arc_path: str, warc_path: str, records: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Save the WARC form of ARC files: of equal HTTP payloads one response, the rest revisits."""
    index = settle(arc_index(spark, arc_path).where("http"), "arc-index")
    original = index.groupBy("digest").agg(F.max(F.struct("page_id", "path", "offset", "url", "date", "id")).alias("original"), F.count(F.lit(1)).alias("n"))
    original = settle(original.where("n > 1").select("digest", "original"), "arc-originals")
    revisits = index.select("path", "offset", "digest", "id").join(original, "digest").where(F.col("id") != F.col("original.id"))
    plan = revisits.groupBy("path").agg(F.collect_list(F.struct("offset", F.col("original.id").alias("id"), F.col("original.url").alias("url"), F.col("original.date").alias("date"))).alias("revisits"))
    # A plan holds at most the records of one archive; the archive itself moves compressed.
    work = _archives(spark, arc_path).join(plan.withColumnRenamed("path", "planned"), F.col("path") == F.col("planned"), "left").select("path", "content", "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ArchiveLines(archive_bytes, records)
        info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", ""), ("WARC-Date", warc_date(CRAWL_DATE)), ("Content-Type", "application/warc-fields")], b"software: millrace\r\nformat: WARC File Format 1.1\r\n")
        for batch in batches:
            for i in range(batch.num_rows):
                place = batch.column(0)[i].as_py()
                refers = {r["offset"]: r for r in batch.column(2)[i].as_py() or []}
                for record in parse_arc(batch.column(1)[i].as_py()):
                    at = f"{place.rsplit('/', 1)[-1]}:{record.offset}"
                    head = info.replace(b"WARC-Record-ID: ", b"WARC-Record-ID: " + record_id(at, CRAWL_DATE, "", None, "").encode()) if lines.fresh else b""
                    yield from lines.add(head + _converted(record, at, refers.get(record.offset)))
        yield from lines.give()

    return _save(work.mapInArrow(run, "line binary"), warc_path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, plain or gzipped."""
    stream = _opened(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:200]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response, revisit or resource, its digest checked against the bytes that are there."""
    names = ["page_id", "record_id", "record_type", "uri", "date", "refers_to_id", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for headers, block in parse_warc(batch.column(0)[i].as_py()):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    declared = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload)
                    if kind == "revisit":
                        size = int(http_field(head, "Content-Length") or 0)
                    elif base32_sha1(payload) != declared:
                        raise ValueError(f"payload of {headers['warc-record-id']} is not what its digest says")
                    owner = http_field(head, PAGE_HEADER)
                    rows.append((_number(owner), headers["warc-record-id"], kind, headers["warc-target-uri"], headers["warc-date"], headers.get("warc-refers-to"), size, declared, payload if with_payload else None))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "page_id long, record_id string, record_type string, uri string, date string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
    found = _archives(spark, path).select("content").mapInArrow(run, schema)
    return found if with_payload else found.drop("payload")


def archive_report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as ARC, convert to WARC, read that back, and resolve what revisits refer to."""
    spark = pages.sparkSession
    arc = write_arc(pages, scratch_path(spark, "arc"), page_id, url, html)
    records = settle(read_warc(spark, convert(spark, arc, scratch_path(spark, "warc"))), "warc-records")
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    return records.join(targets, F.col("refers_to_id") == F.col("target"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
