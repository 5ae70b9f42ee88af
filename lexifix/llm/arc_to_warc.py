"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block, whose body names the version and the fields of the header lines:

* version 1: URL, IP address, date, content type, length;
* version 2: URL, IP address, date, content type, result code, checksum, location, offset, file name, length.

Each record is a header line, the declared number of bytes, and a line feed. The converter synthesises the WARC fields
that ARC lacks: record identifiers from the record's date, place and URL, ISO timestamps from the 14-digit dates, record
types, and block and payload digests. The version block becomes a warcinfo record, a record with an HTTP head a response,
another (of DNS, say) a resource. Payloads that occur more than once become one such record and revisits of it.
Archives may be gzipped, as a whole or record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, lookup, partitions, read, shared_dir, written

#: Fields of the header lines by version: fixed values of the format.
FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
FIELD_LINE = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs
#: Bytes of one ARC file as made from tables, about.
ARC_BYTES = 4 << 20
GZIP_LEVEL = 1
#: Lists of up to so many revisits in all (some 30 MB) are broadcast to the archives.
BROADCAST_REVISITS = 200_000


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    block: bytes

    def split(self) -> tuple[bytes, bytes]:
        """(HTTP head with its blank line, payload); a block without an HTTP head is all payload."""
        end = self.block.find(b"\r\n\r\n") if self.block.startswith(b"HTTP/") else -1
        return (self.block[: end + 4], self.block[end + 4 :]) if end >= 0 else (b"", self.block)


def digest32(data: bytes) -> str:
    """SHA-1 in base 32, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_arc(data: bytes):
    """A stream of the archive's bytes, unpacked if it is gzipped."""
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw


def read_head(stream) -> tuple[ArcRecord | None, list[str]]:
    """The version block and the fields of the header lines that its version has; none of an empty archive."""
    line = stream.readline()
    if not line:
        return None, []
    head = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape").split(" ")
    if not head[0].startswith("filedesc:"):
        raise ValueError("no ARC version block")
    body = stream.read(int(head[-1]))
    version = int(body.split(b" ", 1)[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    return ArcRecord(head[0], head[1], head[2], head[3], body), FIELDS[version]


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC file of either version, without the version block."""
    head, names = read_head(stream)
    return read_records(stream, names) if head else iter(())


def read_records(stream, names: list[str]) -> Iterator[ArcRecord]:
    """Records after the version block; header lines are split from the right, so a URL may hold spaces."""
    while line := stream.readline():
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        if not text:
            continue  # the line feed after a record
        values = text.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"ARC header line of {len(names)} fields: {text[:200]!r}")
        record = dict(zip(names, values))
        size = int(record["length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"ARC record of {record['url']} ends after {len(block)} of {size} bytes")
        yield ArcRecord(record["url"], record["ip"], record["date"], record["type"], block)


def arc_header(version: int, record: ArcRecord, offset: int, filename: str) -> bytes:
    size = len(record.block)
    if version == 1:
        values = [record.url, record.ip, record.date, record.type, str(size)]
    else:
        values = [record.url, record.ip, record.date, record.type, "200", "-", "-", str(offset), filename, str(size)]
    return (" ".join(values) + "\n").encode("utf-8", "surrogateescape")


def write_arc(records: list[ArcRecord], version: int, filename: str) -> bytes:
    body = f"{version} 0 lexifix\n{FIELD_LINE[version]}\n".encode()
    first = ArcRecord(f"filedesc://{filename}", "0.0.0.0", "20050101000000", "text/plain", body)
    out = bytearray()
    for record in [first, *records]:
        out += arc_header(version, record, len(out), filename) + record.block + b"\n"
    return bytes(out)


def iso_date(date: str) -> str:
    """14 digits to a WARC date; shorter dates count from the start of what they name, others as the epoch's start."""
    if not date.isdigit() or not 4 <= len(date) <= 14:
        return "1970-01-01T00:00:00Z"
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(record: ArcRecord, place: str) -> str:
    """The same for the same record in the same place, so a repeated conversion gives the same archive."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record.date} {place} {record.url}')}>"


def warc_record(record: ArcRecord, place: str, revisit_of: tuple[str, str, str] | None) -> bytes:
    """revisit_of: record id, URL and date of the response with the same payload."""
    head, payload = record.split()
    block = head if revisit_of else record.block
    fields = [
        ("WARC-Type", "revisit" if revisit_of else "response" if head else "resource"),
        ("WARC-Record-ID", record_id(record, place)),
        ("WARC-Date", iso_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response" if head else record.type),
        ("Content-Length", str(len(block))),
    ]
    if revisit_of:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", revisit_of[0]),
            ("WARC-Refers-To-Target-URI", revisit_of[1]),
            ("WARC-Refers-To-Date", iso_date(revisit_of[2])),
        ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warcinfo(head: ArcRecord, name: str) -> bytes:
    """The archive's version block as a warcinfo record: its date, and what it says of itself as fields."""
    block = f"software: lexifix\r\nformat: WARC File Format 1.1\r\nsource-archive: {name}\r\n".encode() + b"".join(
        b"arc-version-block: " + line + b"\r\n" for line in head.block.split(b"\n") if line
    )
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", record_id(head, f"{name}:head")),
        ("WARC-Date", iso_date(head.date)),
        ("WARC-Filename", warc_name(name)),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warc_name(name: str) -> str:
    return name.removesuffix(".gz").removesuffix(".arc") + ".warc.gz"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed stream; block digests are verified."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if fields.get("warc-block-digest", f"sha1:{digest32(block)}") != f"sha1:{digest32(block)}":
            raise ValueError(f"block of {fields.get('warc-record-id')} is damaged")
        yield fields, block


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page_record(page_id: int | None, url: str | None, html: str | None) -> ArcRecord:
    """The crawl's clock is the page's id in seconds; white space in a URL is escaped; the id is an HTTP field."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    named = "" if page_id is None else str(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {named}\r\n\r\n"
    safe = "".join(f"%{ord(c):02X}" if c.isspace() or c < " " else c for c in url or "") or "urn:none"
    date = datetime(2005, 1, 1, tzinfo=UTC) + timedelta(seconds=(page_id or 0) % 100_000_000)
    return ArcRecord(safe, "192.0.2.1", date.strftime("%Y%m%d%H%M%S"), "text/html", head.encode() + payload)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """ARC files (name, data) of pages, versions 1 and 2 in turn: legacy input for the converter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held, size
            name = f"crawl-{part:06d}-{count:06d}.arc"
            data = write_arc(held, 1 + count % 2, name)
            count, held, size = count + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["name", "data"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append(_page_record(*row))
                size += len(held[-1].block)
                if size >= ARC_BYTES:
                    yield flush()
        if held:
            yield flush()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "name string, data binary")


_INDEX = "place string, page_id long, url string, date string, digest string"


def _arc_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(*(batch.column(k).to_pylist() for k in range(2))):
            rows = [[] for _ in range(5)]
            for n, record in enumerate(read_arc(open_arc(data))):
                head, payload = record.split()
                page = http_fields(head).get("x-page-id", "")
                for column, value in zip(rows, (f"{name}:{n}", int(page) if page else None, record.url, record.date, digest32(payload))):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [c.split()[0] for c in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)


def _write_warcs(folder: str):
    """Rows (name, data, revisits of the file's records) to one WARC file for each ARC file, gzipped record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, revisits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                known = {r["n"]: r for r in revisits or []}
                path = os.path.join(folder, warc_name(name))
                passing = f"{path}.{os.getpid()}.{TaskContext.get().attemptNumber()}"
                stream = open_arc(data)
                head, names = read_head(stream)
                with open(passing, "wb") as f:
                    if head:
                        f.write(gzip.compress(warcinfo(head, name), GZIP_LEVEL, mtime=0))
                    for n, record in enumerate(read_records(stream, names)):
                        of = None
                        if r := known.get(n):
                            first = ArcRecord(r["url"], "", r["date"], "", b"")
                            of = (record_id(first, r["first"]), r["url"], r["date"])
                        f.write(gzip.compress(warc_record(record, f"{name}:{n}", of), GZIP_LEVEL, mtime=0))
                os.replace(passing, path)
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)])], names=["file"])

    return run


def convert(arcs: DataFrame, folder: str) -> DataFrame:
    """Convert ARC files (name, data) to WARC files in the shared ``folder``; the files' names.

    Of records with equal payloads, that with the smallest page id (then place; without an id last) is the response,
    empty payloads too. The payloads stay in their file's task: only an index of narrow rows is shuffled. The archives are
    written to the shared folder once, as the index and the conversion must see the same ones. An empty table gives no files.
    """
    arcs = written(arcs.select("name", "data"), "arcs")
    index = written(arcs.mapInArrow(_arc_index, _INDEX), "arc-index")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "place", "url", "date")
    firsts = index.groupBy("digest").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = lookup(index.select("digest", "place"), written(firsts, "first-payloads"), "digest", "n", F.col("place"))
    revisits = found.where(F.col("f").isNotNull() & (F.col("f.place") != F.col("place")))
    by_file = revisits.groupBy(F.substring_index("place", ":", 1).alias("name")).agg(
        F.collect_list(
            F.struct(
                F.substring_index("place", ":", -1).cast("int").alias("n"),
                F.col("f.place").alias("first"),
                F.col("f.url").alias("url"),
                F.col("f.date").alias("date"),
            )
        ).alias("revisits")
    )
    by_file = written(by_file, "revisits")
    size = by_file.agg(F.sum(F.size("revisits"))).first()[0] or 0
    lists = F.broadcast(by_file) if size <= BROADCAST_REVISITS else by_file  # beyond, the archives are shuffled
    rows = arcs.join(lists, "name", "left").select("name", "data", "revisits")
    return written(rows.mapInArrow(_write_warcs(local_path(folder)), "file string"), "warc-files")


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string"


def _read_warcs(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = [[] for _ in range(6)]
                with gzip.open(os.path.join(folder, name)) as stream:
                    for fields, block in read_warc(io.BufferedReader(stream, 1 << 20)):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        end = block.find(b"\r\n\r\n") + 4 if "application/http" in fields["content-type"] else 0
                        http = http_fields(block[:end])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = int(http.get("content-length", len(block) - end))
                        if fields["warc-type"] != "revisit" and (size != len(block) - end or digest32(block[end:]) != digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                        page = http.get("x-page-id")
                        values = (int(page) if page else None, size, digest, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"))
                        for column, value in zip(rows, values):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                names = [c.split()[0] for c in _RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return run


def read_warcs(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Records of the WARC files but warcinfo, verified against their digests; ``refers_to`` is the page id that a
    revisit's WARC-Refers-To record has, whose payload's size is the revisit's. Records without an HTTP head have no
    page id."""
    dealt = files.repartition(partitions(spark))
    records = written(dealt.mapInArrow(_read_warcs(local_path(folder)), _RECORDS), "warc-records")
    targets = records.where("refers_id IS NOT NULL").groupBy(F.col("refers_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    pages = records.where("record_type <> 'revisit'").select("record_id", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"))
    table = written(targets.join(pages, "record_id"), "warc-targets").withColumnRenamed("record_id", "refers_id")
    found = lookup(records, table, "refers_id", "n", F.col("record_id"))
    return found.withColumn("payload_bytes", F.coalesce("full", "payload_bytes")).drop("record_id", "refers_id", "full")


def op9_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as ARC files, converted to WARC in the shared folder and read back."""
    folder = shared_dir(spark, "warcs")
    files = convert(pages_to_arc(read(spark, sf_dir, "pages")), folder)
    return read_warcs(spark, folder, files)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t),
b AS (
  SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h, first FROM p JOIN f USING (t)
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_reduce(list_transform(range(5), lambda k:
      (strpos('0123456789abcdef', substr(h, 1 + ((i * 5 + k) // 4)::INT, 1)) - 1) // (1 << (3 - (i * 5 + k) % 4)::INT) % 2),
      lambda a, x: 2 * a + x)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
