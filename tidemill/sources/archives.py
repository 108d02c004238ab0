"""WARC and ARC files as a data source: ``spark.read.format("webarchive").load(path)`` and ``df.write``.

Reading: one partition a file; records are streamed in batches of a few MB, whatever the file's size, and equality on
file and offset seeks to the one record.  Columns: file, offset, length, type, record_id,
date, target_uri, mimetype, ip, headers, payload.

Options: ``archive`` auto (by name and content), warc or arc; ``mode`` PERMISSIVE (a damaged record ends its
file, with type ``corrupt``) or FAILFAST; ``payload`` false to leave payloads out.  Writing: ``archive`` warc
or arc, ``gzip`` true or false, ``maxBytes`` a file (1e9).  Each task writes files of its own under a name
that says so and renames them when the job commits; what failed tasks leave is deleted.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

SCHEMA = "file string, offset long, length long, type string, record_id string, date timestamp, target_uri string, mimetype string, ip string, headers map<string,string>, payload binary"
_ARC_VERSION = "filedesc"
_ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("date", pa.timestamp("us", "UTC")), ("target_uri", pa.string())]
    + [("mimetype", pa.string()), ("ip", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
#: Records and bytes that are handed over at once: memory that a task needs besides its largest record.
BATCH_RECORDS, BATCH_BYTES = 1000, 4 << 20


def parse_fields(block: bytes) -> list[tuple[str, str]]:
    """(name, value) lines; a line that begins with white space continues the one before, # lines are comments."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").splitlines():
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line and not line.startswith("#"):
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def format_fields(fields: list[tuple[str, str]]) -> bytes:
    for name, value in fields:
        if re.search(r"[\r\n]", name + value) or ":" in name:
            raise ValueError(f"no header line: {name}")
    return "".join(f"{n}: {v}\r\n" for n, v in fields).encode()


class Members:
    """A file as one stream of bytes, gzipped or not; ``start`` is where the record at hand began in the file."""

    def __init__(self, raw: BinaryIO, offset: int = 0) -> None:
        self.raw, self.zipped = raw, False
        raw.seek(offset)
        head = raw.read(2)
        raw.seek(offset)
        self.zipped = head == b"\x1f\x8b"
        self.buffer, self.pending, self.at = b"", b"", offset
        self.unzip = zlib.decompressobj(31) if self.zipped else None
        self.next_member = offset
        self.within = False  # whether the member at hand has more to give

    def _more(self) -> bool:
        data = self.pending or self.raw.read(1 << 16)
        self.pending = b""
        if not data:
            return False
        if not self.zipped:
            self.buffer += data
            return True
        self.buffer += self.unzip.decompress(data)
        self.within = not self.unzip.eof
        if self.unzip.eof:
            self.pending = self.unzip.unused_data
            self.next_member = self.raw.tell() - len(self.pending)
            self.unzip = zlib.decompressobj(31)
        return True

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += 0 if self.zipped else len(out)
        return out

    def line(self) -> bytes:
        while b"\n" not in self.buffer and self._more():
            pass
        cut = self.buffer.find(b"\n") + 1 or len(self.buffer)
        return self.read(cut)

    def offset(self) -> int:
        """Where the next record begins: its gzip member, if there is nothing left of the last one."""
        if self.zipped:
            return self.next_member
        return self.at

    def end_record(self) -> int:
        """Pass what follows a record in its own member; the offset of the next record."""
        while True:
            stripped = self.buffer.lstrip(b"\r\n")
            self.at += 0 if self.zipped else len(self.buffer) - len(stripped)
            self.buffer = stripped
            if self.buffer or not self.within or not self._more():
                return self.offset()

    def skip_blank(self) -> bool:
        """Go to the next record; whether there is one."""
        while True:
            if not self.buffer and not self._more():
                return False
            stripped = self.buffer.lstrip(b"\r\n")
            self.at += 0 if self.zipped else len(self.buffer) - len(stripped)
            self.buffer = stripped
            if self.buffer:
                return True


def _date(text: str) -> datetime | None:
    for shape in ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y%m%d%H%M%S"):
        try:
            return datetime.strptime(text, shape).replace(tzinfo=UTC)
        except ValueError:
            continue
    return None


def warc_records(stream: Members, file: str, payload: bool = True) -> Iterator[tuple]:
    start = stream.offset()
    while stream.skip_blank():
        if not stream.zipped:
            start = stream.at
        version = stream.line()
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start} of {file}")
        block = b""
        while (line := stream.line()).strip():
            block += line
        fields = parse_fields(block)
        headers = dict(fields)
        low = {k.lower(): v for k, v in fields}
        if "content-length" not in low:
            raise ValueError(f"cut off at {start} of {file}")
        length = int(low["content-length"])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"cut off at {start} of {file}")
        uri = low.get("warc-target-uri")
        yield (file, start, length, low.get("warc-type"), low.get("warc-record-id"), _date(low.get("warc-date", "")), uri and uri.strip("<>"), low.get("content-type"), low.get("warc-ip-address"), headers, body if payload else None)
        start = stream.end_record()


def arc_records(stream: Members, file: str, payload: bool = True) -> Iterator[tuple]:
    start = stream.offset()
    while stream.skip_blank():
        if not stream.zipped:
            start = stream.at
        line = stream.line().decode("utf-8", "replace").strip()
        part = line.split(" ")
        if len(part) < 5 or not part[-1].isdigit():
            raise ValueError(f"no ARC record at {start} of {file}")
        uri, ip, date, mime, length = " ".join(part[:-4]), *part[-4:]
        body = stream.read(int(length))
        if len(body) < int(length):
            raise ValueError(f"cut off at {start} of {file}")
        kind = "filedesc" if uri.startswith(_ARC_VERSION) else "response"
        yield (file, start, int(length), kind, None, _date(date), uri, mime, ip, {}, body if payload else None)
        start = stream.end_record()


def kind_of(path: str) -> str:
    if re.search(r"\.warc(?:\.gz)?$", path):
        return "warc"
    if re.search(r"\.arc(?:\.gz)?$", path):
        return "arc"
    with open(path, "rb") as raw:
        head = raw.read(1 << 12)
    head = zlib.decompressobj(31).decompress(head) if head[:2] == b"\x1f\x8b" else head
    return "warc" if head.startswith(b"WARC/") else "arc"


def read_file(path: str, archive: str = "auto", mode: str = "PERMISSIVE", payload: bool = True, offset: int = 0, only: bool = False) -> Iterator[tuple]:
    """Records from an offset on; the one there only, if asked."""
    kind = kind_of(path) if archive == "auto" else archive
    with open(path, "rb") as raw:
        try:
            for record in (warc_records if kind == "warc" else arc_records)(Members(raw, offset), path, payload):
                yield record
                if only:
                    return
        except (ValueError, KeyError, zlib.error) as damage:
            if mode == "FAILFAST":
                raise
            yield (path, raw.tell(), None, "corrupt", None, None, None, None, None, {"error": str(damage)}, None)


def record_batches(records: Iterator[tuple], most: int = BATCH_RECORDS, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches, each full with so many records or bytes of payload."""
    rows: list[tuple] = []
    size = 0
    for record in records:
        rows.append(record)
        size += len(record[10] or b"")
        if len(rows) >= most or size >= most_bytes:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)]
    columns[9] = [list(h.items()) for h in columns[9]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


@dataclass
class File(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.wanted: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on file and offset is used to seek; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("file",), ("offset",)):
                self.wanted[f.attribute[0]] = f.value
            yield f

    def partitions(self) -> list[File]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(path)) if any(c in path for c in "*?[") else [path]
        files = [f for p in found for f in (sorted(x for x in glob.glob(f"{p}/*") if not os.path.basename(x).startswith(("_", "."))) if os.path.isdir(p) else [p])]
        return [File(f) for f in files if self.wanted.get("file", f) == f]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        o = self.options
        offset = int(self.wanted.get("offset", 0))
        yield from record_batches(read_file(partition.path, o.get("archive", "auto"), o.get("mode", "PERMISSIVE"), o.get("payload", "true") == "true", offset, "offset" in self.wanted))


def warc_bytes(kind: str, uri: str | None, date: datetime | None, body: bytes, mimetype: str | None = None, ip: str | None = None, record_id: str | None = None, more: dict[str, str] | None = None) -> bytes:
    """One record of the format's version 1.0."""
    fields = [("WARC-Type", kind)]
    fields += [("WARC-Target-URI", uri)] if uri else []
    fields += [("WARC-Date", (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"))]
    fields += [("WARC-Record-ID", record_id or f"<urn:uuid:{uuid.uuid4()}>")]
    fields += [("WARC-IP-Address", ip)] if ip else []
    known = {n.lower() for n, _ in fields} | {"content-type", "content-length"}
    fields += [(k, v) for k, v in (more or {}).items() if k.lower() not in known]
    fields += [("Content-Type", mimetype)] if mimetype else []
    fields += [("Content-Length", str(len(body)))]
    return b"WARC/1.0\r\n" + format_fields(fields) + b"\r\n" + body + b"\r\n\r\n"


def arc_bytes(uri: str, ip: str | None, date: datetime | None, mimetype: str | None, body: bytes) -> bytes:
    when = (date or datetime.now(UTC)).strftime("%Y%m%d%H%M%S")
    return f"{re.sub(r'\\s', '%20', uri)} {ip or '0.0.0.0'} {when} {mimetype or 'no-type'} {len(body)}\n".encode() + body + b"\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.path = options["path"].removeprefix("file://")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        archive, zipped, most = o.get("archive", "warc"), o.get("gzip", "true") == "true", int(float(o.get("maxbytes", "1e9")))
        os.makedirs(self.path, exist_ok=True)
        files: list[str] = []
        out: io.BufferedWriter | None = None
        for r in (b.slice(k, 1).to_pylist()[0] for b in iterator for k in range(b.num_rows)):
            body = bytes(r.get("payload") or b"")
            date = r["date"].astimezone(UTC) if r.get("date") else None
            headers = dict(r["headers"]) if r.get("headers") else None
            if archive == "warc":
                data = warc_bytes(r.get("type") or "resource", r.get("target_uri"), date, body, r.get("mimetype"), r.get("ip"), r.get("record_id"), headers)
            else:
                data = arc_bytes(r["target_uri"], r.get("ip"), date, r.get("mimetype"), body)
            data = gzip.compress(data, mtime=0) if zipped else data
            if out is None or out.tell() + len(data) > most > 0 and out.tell():
                if out:
                    out.close()
                files.append(f"{self.path}/.part-{uuid.uuid4().hex}.{archive}{'.gz' if zipped else ''}.open")
                out = open(files[-1], "wb")  # noqa: SIM115
                if archive == "arc":
                    about = b"1 0 tidemill\nURL IP-address Archive-date Content-type Archive-length\n"
                    head = f"{_ARC_VERSION}://part 0.0.0.0 {datetime.now(UTC):%Y%m%d%H%M%S} text/plain {len(about)}\n".encode() + about + b"\n"
                    out.write(gzip.compress(head, mtime=0) if zipped else head)
            out.write(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        old = [f for f in glob.glob(f"{self.path}/*") if os.path.isfile(f)] if self.overwrite else []
        for f in (f for m in messages if m for f in m.files):
            os.rename(f, os.path.join(self.path, os.path.basename(f)[1:].removesuffix(".open")))
        for f in old:
            os.remove(f)

    def abort(self, messages: list) -> None:
        for f in (f for m in messages if m for f in m.files):
            os.remove(f)


class WebArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebArchive)
