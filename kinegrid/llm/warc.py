"""Legacy archive converter: ARC archives of both versions become WARC archives, equal payloads revisits of the first.

An ARC archive starts with a version block, which says by which fields the header lines that follow describe a record: version 1
has URL, IP address, date, type and length, version 2 also a result code, checksum, location, offset and file name. The
declared length tells where a record ends. Each archive is converted by itself, in three steps:

1. All ARC records are read once for what identifies them: archive, offset, URI, date, payload length and SHA-1 digest.
2. Of records with equal payloads the first (by page id, then date, then place) stays a response; the others are listed, by
   archive, as revisits of it. Only these small rows are shuffled, never payloads.
3. Each archive is read again and written as a WARC archive of the same name: the version block becomes a `warcinfo` record,
   what starts with an HTTP status line a `response` or `revisit`, anything else a `resource`. Record ids are UUIDs of the archive's
   name and the record's offset, so that a task that runs again writes the same bytes. Every record is a gzip member.

Archives are streamed record by record; tasks write through `sources.files`, so that a lost executor leaves no half archive.

Rows: a null html is an empty payload; a null or empty url becomes `about:blank`, and white space and control characters of a
url are percent-encoded; rows that repeat a page_id are records of their own (the first written is the response of equal ones); rows
without a page_id come after all others in the order of equal payloads, and refers_to is null where the response has no page_id;
an empty table gives an empty result; other columns are ignored.

Archives of others: a record that is cut off is kept, as far as it goes, with `WARC-Truncated: length`; where the line after a
record is no header, lines are skipped up to the next one; a date of fewer digits is filled up, an impossible one becomes the start
of 1970; an archive that is no ARC has no records.
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
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.files import TaskFiles, open_stream, save
from .common import bound_batches, discard, materialise, shared_dir

#: Bytes of payload after which a new ARC archive is started.
ARCHIVE_BYTES = 256 << 20
#: Level of the gzip members: most of the time goes into them, and 6 makes archives of web pages a tenth smaller than 1.
LEVEL = 1
#: Fixed values of the ARC format: the fields of a header line by version.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: A URL or a type may have spaces in it, so a line is read by its fixed parts.
_LINES = {
    1: re.compile(rb"(\S.*?) (\S+) (\d{4,14}) (.*?) ?(\d+)\s*"),
    2: re.compile(rb"(\S.*?) (\S+) (\d{4,14}) (.*?) (\S+) (\S+) (\S+) (\d+) (\S+) (\d+)\s*"),
}
#: A line that runs on for longer is no header.
MOST_LINE = 1 << 16
_PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PAGE = re.compile(rb"^X-Page-Id: (-?\d+)\r?$", re.MULTILINE)


@dataclass
class ArcRecord:
    """A record of an ARC archive, with its whole block."""

    offset: int
    uri: bytes
    ip: bytes
    date: bytes
    kind: bytes
    block: bytes
    truncated: bool = False

    @property
    def is_http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    @property
    def head(self) -> int:
        """Length of the HTTP head of the block, its blank line included."""
        ends = [at + len(blank) for blank in (b"\r\n\r\n", b"\n\n") if (at := self.block.find(blank)) >= 0]
        return min(ends) if ends else len(self.block)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def timestamp(digits: bytes) -> str:
    """A WARC date of the digits of an ARC date, whose missing ones are the least possible."""
    text = digits.decode()
    text += "00000101000000"[len(text) :]
    try:
        return datetime.strptime(text[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except ValueError:
        return "1970-01-01T00:00:00Z"


class _Counted:
    """A stream, plain or gzipped, that knows its place in the uncompressed bytes, and that ends where its source is cut off."""

    def __init__(self, raw: io.RawIOBase):
        source = io.BufferedReader(raw)
        self.source = gzip.GzipFile(fileobj=source) if source.peek(2)[:2] == b"\x1f\x8b" else source
        self.at = 0

    def _of(self, read, size: int) -> bytes:
        try:
            out = read(size)
        except (EOFError, gzip.BadGzipFile):
            out = b""
        self.at += len(out)
        return out

    def read(self, size: int) -> bytes:
        parts = []
        while size and (part := self._of(self.source.read, min(size, 1 << 20))):
            parts.append(part)
            size -= len(part)
        return b"".join(parts)

    def line(self, size: int = MOST_LINE) -> bytes:
        return self._of(self.source.readline, size)


def arc_records(raw: io.RawIOBase) -> Iterator[ArcRecord]:
    """The records of an ARC archive in order, its version block first if there is one."""
    stream, version = _Counted(raw), None
    while True:
        offset, line = stream.at, stream.line()
        if not line:
            return
        if line.isspace():
            continue
        found = next((m for v in ((version,) if version else (2, 1)) if (m := _LINES[v].fullmatch(line))), None)
        if not found:
            continue  # the rest of a record that is longer than declared
        uri, ip, date, kind = found.groups()[:4]
        length = int(found.groups()[-1])
        block = stream.read(length)
        if version is None:
            first = block[:1] if uri.startswith(b"filedesc:") else b""
            version = int(first) if first in (b"1", b"2") else 2 if found.re is _LINES[2] else 1
        yield ArcRecord(offset, uri, ip, date, kind, block, len(block) < length)


def _member(headers: list[tuple[str, str | bytes]], block: bytes) -> bytes:
    text = b"WARC/1.0\r\n" + b"".join(k.encode() + b": " + (v if isinstance(v, bytes) else v.encode()) + b"\r\n" for k, v in headers)
    return gzip.compress(text + b"\r\n" + block + b"\r\n\r\n", compresslevel=LEVEL, mtime=0)


def warc_record(archive: str, record: ArcRecord, revisit: tuple[str, bytes, str] | None = None) -> bytes:
    """The gzip member of a record; `revisit` has the id, URI and date of the response with its payload."""
    block = record.block
    shared = [("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", timestamp(record.date))]
    if record.offset == 0 and record.uri.startswith(b"filedesc:"):
        lines = block.split(b"\n")
        body = b"software: kinegrid\r\nformat: WARC File Format 1.0\r\narc-version: %s\r\narc-fields: %s\r\n" % (lines[0], lines[1] if len(lines) > 1 else b"")
        return _member([("WARC-Type", "warcinfo"), *shared, ("WARC-Filename", f"{archive}.warc.gz"), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))], body)
    shared += [("WARC-Target-URI", record.uri)] + ([("WARC-IP-Address", record.ip)] if re.fullmatch(rb"[0-9a-fA-F.:]+", record.ip) and record.ip != b"0.0.0.0" else [])
    if record.truncated:
        shared.append(("WARC-Truncated", "length"))
    if not record.is_http:
        return _member([("WARC-Type", "resource"), *shared, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", record.kind or b"application/octet-stream"), ("Content-Length", str(len(block)))], block)
    kind = "response"
    shared.append(("WARC-Payload-Digest", f"sha1:{sha1(block[record.head :])}"))
    if revisit:
        kind, block = "revisit", block[: record.head]
        shared += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", revisit[0]), ("WARC-Refers-To-Target-URI", revisit[1]), ("WARC-Refers-To-Date", revisit[2])]
    return _member([("WARC-Type", kind), *shared, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block)


def warc_records(raw: io.RawIOBase) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers by lower-case name, block) of the records of a WARC archive in order."""
    stream = _Counted(raw)
    while line := stream.line():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.line().rstrip(b"\r\n")) and b":" in line:
            name, value = line.split(b":", 1)
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get(b"content-length", b"0")))


class _Arc:
    """An ARC archive that is being written, a gzip member for each record."""

    def __init__(self, files: TaskFiles, name: str, version: int, date: str):
        self.out, self.name, self.version, self.date = files.create(f"{name}.arc.gz"), name, version, date
        self.at = self.size = 0
        self.add(f"filedesc://{name}.arc".encode(), b"text/plain", f"{version} 0 kinegrid\n{FIELDS[version]}\n".encode(), b"200")

    def add(self, uri: bytes, kind: bytes, block: bytes, status: bytes) -> None:
        more = b"" if self.version == 1 else b"%s - - %d %s.arc " % (status, self.at, self.name.encode())
        text = b"%s 0.0.0.0 %s %s %s%d\n%s\n" % (uri, self.date.encode(), kind, more, len(block), block)
        self.out.write(gzip.compress(text, compresslevel=LEVEL, mtime=0))
        self.at += len(text)
        self.size += len(block)


def write_arc(pages: DataFrame, path: str, date: str = "20000101000000", archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Writes (page_id, url, html) rows as ARC archives and returns their names; `version` (1 or 2) is that of the row's archive."""

    def task(batches: Iterator[pa.RecordBatch], files: TaskFiles) -> Iterator[dict]:
        part, opened, count = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            for page_id, url, html, version in zip(*(batch.column(k) for k in range(4)), strict=True):
                arc = opened.get(version.as_py())
                if arc is None or arc.size >= archive_bytes:
                    if arc:
                        arc.out.close()
                    arc = opened[version.as_py()] = _Arc(files, f"pages-{part:06d}-{count:04d}", version.as_py(), date)
                    count += 1
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
                head += b"X-Page-Id: %d\r\n" % page_id.as_py() if page_id.is_valid else b""
                uri = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], url.as_buffer().to_pybytes() if url.is_valid else b"") or b"about:blank"
                arc.add(uri, b"text/html", head + b"\r\n" + payload, b"200")
        for arc in opened.values():
            arc.out.close()
        return []

    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"), F.col("version").cast("int"))
    return save(rows, path, task)["files"]


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


_ARC = "archive string, offset long, is_http boolean, uri binary, date string, page_id long, payload_bytes long, payload_digest string"
_WARC = "record_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


def _page_id(head: bytes) -> int | None:
    found = _PAGE.search(head)
    return int(found.group(1)) if found else None


def _arc_row(path: str) -> Iterator[tuple]:
    name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".arc")
    with open_stream(path) as raw:
        for r in arc_records(raw):
            payload = r.block[r.head :] if r.is_http else r.block
            yield name, r.offset, r.is_http, r.uri, timestamp(r.date), _page_id(r.block[: r.head]) if r.is_http else None, len(payload), sha1(payload)


def _warc_row(path: str) -> Iterator[tuple]:
    text = lambda value: value.decode("utf-8", "replace") if value is not None else None
    with open_stream(path) as raw:
        for headers, block in warc_records(raw):
            kind = text(headers.get(b"warc-type"))
            head = ArcRecord(0, b"", b"", b"", b"", block).head if kind in ("response", "revisit") else 0
            digest = text(headers.get(b"warc-payload-digest", b"")).removeprefix("sha1:") or None
            if kind == "response" and (own := sha1(block[head:])) != digest:
                raise ValueError(f"{path}: payload {own} does not have its digest {digest}")
            yield text(headers.get(b"warc-record-id")), kind, text(headers.get(b"warc-target-uri")), _page_id(block[:head]), len(block) - head if kind != "revisit" else None, digest, text(headers.get(b"warc-refers-to"))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], rows, schema: StructType):
        self.paths, self.rows, self.schema = paths, rows, schema

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition.path)


def _read(spark: SparkSession, paths: list[str], rows, schema: str) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    columns = schema

    class Archives(DataSource):
        @classmethod
        def name(cls) -> str:
            return "web_archives"

        def schema(self) -> str:
            return columns

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(paths, rows, schema)

    spark.dataSource.register(Archives)
    return spark.read.format("web_archives").load()


def read_arc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """archive, offset, is_http, uri, date, page_id, payload_bytes, payload_digest of each record, a partition for each archive."""
    return _read(spark, paths, _arc_row, _ARC)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """record_id, record_type, target_uri, page_id, payload_bytes, payload_digest, refers_to_id of each record; the payload of a
    response must have the digest that its header tells."""
    return _read(spark, paths, _warc_row, _WARC)


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """archive, offset of the records whose payload of `min_bytes` or more an earlier one has, and refers_to: id, uri, date of that one."""
    some = records.where(F.col("is_http") & (F.col("payload_bytes") >= min_bytes))
    order = F.struct(F.col("page_id").isNull().alias("without"), "page_id", "date", "archive", "offset")
    key = ["payload_digest", "payload_bytes"]
    firsts = some.groupBy(*key).agg(F.min(F.struct(order.alias("order"), "uri")).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = some.join(firsts.select(*key, "f"), key).where(order > F.col("f.order"))
    return later.select("archive", "offset", F.struct(F.col("f.order.archive").alias("archive"), F.col("f.order.offset").alias("offset"), F.col("f.uri").alias("uri"), F.col("f.order.date").alias("date")).alias("refers_to"))


def convert(spark: SparkSession, paths: list[str], target: str, min_bytes: int = 0) -> list[str]:
    """Writes a WARC archive for each ARC archive and returns their names."""
    records = materialise(read_arc(spark, paths), "records")
    listed = revisits(records, min_bytes).groupBy("archive").agg(F.collect_list(F.struct("offset", "refers_to")).alias("revisits"))
    named = spark.createDataFrame([(p, p.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".arc")) for p in paths], "path string, archive string")
    rows = named.join(listed, "archive", "left").select("path", "archive", "revisits").repartition(max(1, len(paths)), "archive")

    def task(batches: Iterator[pa.RecordBatch], files: TaskFiles) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                known = {x["offset"]: x["refers_to"] for x in row["revisits"] or []}
                with open_stream(row["path"]) as raw, files.create(f"{row['archive']}.warc.gz") as out:
                    for record in arc_records(raw):
                        to = known.get(record.offset)
                        out.write(warc_record(row["archive"], record, to and (record_id(to["archive"], to["offset"]), bytes(to["uri"]), to["date"])))
        return []

    names = save(rows, target, task)["files"]
    discard(records)
    return names


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response) of responses and revisits."""
    responses = records.where("record_type = 'response'")
    first = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"))
    revisit = records.where("record_type = 'revisit'").join(first, "refers_to_id").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(revisit)


def round_trip(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as ARC archives (even ids by version 2, others by version 1), converts these, and reads the WARC archives back."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    version = F.when(F.col("page_id") % 2 == 0, 2).otherwise(1)
    arcs = write_arc(pages.select("page_id", "url", "html", version.alias("version")), f"{root}/arc", archive_bytes=archive_bytes)
    warcs = convert(spark, [f"{root}/arc/{x}" for x in arcs], f"{root}/warc", min_bytes)
    records = read_warc(spark, [f"{root}/warc/{x}" for x in warcs]).where("record_type in ('response', 'revisit')")
    return pages_of(materialise(records, "read"))
