import base64
import gzip
import hashlib
import io
import os

import pytest

from lexifix.llm import arc_to_warc
from lexifix.llm.arc_to_warc import (
    ArcRecord,
    arc_header,
    convert,
    iso_date,
    pages_to_arc,
    read_arc,
    read_warc,
    read_warcs,
    write_arc,
)
from lexifix.llm.common import local_path, shared_dir

PAGES = [
    (3, "http://a/x y", "<p>same</p>"),
    (1, "http://a/é", "<p>same</p>"),
    (2, None, None),
    (5, "http://b", ""),
    (4, "http://b", "line\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1"),
    (6, "http://long", "x" * 3_000_000),
    (7, "http://long", "x" * 3_000_000),
    (7, "http://long", "x" * 3_000_000),
    (None, "http://c", "<p>same</p>"),
    (None, None, "only"),
]


def test_arc_versions_round_trip():
    records = [ArcRecord("http://a/ b", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nbody\n"), ArcRecord("dns:a", "0.0.0.0", "2001", "text/dns", b"")]
    for version in (1, 2):
        data = write_arc(records, version, "f.arc")
        assert list(read_arc(io.BytesIO(data))) == records
        assert data.split(b"\n")[1].startswith(str(version).encode())
        with pytest.raises(ValueError, match="ends after"):
            list(read_arc(io.BytesIO(write_arc(records[:1], version, "f.arc")[:-5])))
    assert len(arc_header(1, records[0], 9, "f").split()) == 6 and len(arc_header(2, records[0], 9, "f").split()) == 11
    with pytest.raises(ValueError, match="version 9"):
        list(read_arc(io.BytesIO(b"filedesc://x 0 0 t 4\n9 0\n\n")))
    assert list(read_arc(io.BytesIO(b""))) == []


def test_dates():
    assert iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert iso_date("2001") == "2001-01-01T00:00:00Z"
    assert iso_date("bad") == "1970-01-01T00:00:00Z"


def expected(pages):
    payloads, out = {}, []
    for i, _, html in pages:
        payloads.setdefault(html or "", []).append(i)
    for html, ids in payloads.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is None, i))
        out += [(i, len(raw), digest, "revisit" if n else "response", ids[0] if n else None) for n, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_pages_there_and_back(spark, monkeypatch, limit):
    monkeypatch.setattr(arc_to_warc, "BROADCAST_REVISITS", limit)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    folder = shared_dir(spark, "warc-test")
    files = convert(pages_to_arc(df), folder)
    rows = read_warcs(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == expected(PAGES)
    revisits = 0
    for name in os.listdir(local_path(folder)):
        with gzip.open(os.path.join(local_path(folder), name)) as f:
            for fields, block in read_warc(io.BytesIO(f.read())):
                assert fields["warc-date"].startswith("2005-") and fields["warc-record-id"].startswith("<urn:uuid:")
                if fields["warc-type"] == "revisit":
                    revisits += 1
                    assert block.endswith(b"\r\n\r\n") and "warc-refers-to-date" in fields
    assert revisits == 5


def test_other_records_and_gzip(spark):
    """DNS records become resources, version blocks warcinfo; gzipped archives are read."""
    records = [
        ArcRecord("dns:a", "0.0.0.0", "20010101000000", "text/dns", b"a 1.2.3.4"),
        ArcRecord("http://a/", "1.2.3.4", "20010101000000", "text/html", b"HTTP/1.0 200 OK\r\n\r\nbody"),
        ArcRecord("dns:b", "0.0.0.0", "20010101000001", "text/dns", b"a 1.2.3.4"),
    ]
    data = write_arc(records, 1, "f.arc")
    df = spark.createDataFrame([("f.arc", data), ("g.arc.gz", gzip.compress(write_arc(records[1:2], 2, "g.arc")))], "name string, data binary")
    folder = shared_dir(spark, "warc-test")
    files = convert(df, folder)
    assert sorted(r.file for r in files.collect()) == ["f.warc.gz", "g.warc.gz"]
    with gzip.open(os.path.join(local_path(folder), "f.warc.gz")) as f:
        found = list(read_warc(io.BytesIO(f.read())))
    assert [h["warc-type"] for h, _ in found] == ["warcinfo", "resource", "response", "revisit"]
    assert b"URL IP-address" in found[0][1] and found[1][0]["content-type"] == "text/dns"
    assert found[3][0]["warc-refers-to"] == found[1][0]["warc-record-id"]
    got = sorted((r.record_type, r.payload_bytes) for r in read_warcs(spark, folder, files).collect())
    assert got == [("resource", 9), ("response", 4), ("revisit", 4), ("revisit", 9)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, name string, data string")
    folder = shared_dir(spark, "warc-test")
    rows = read_warcs(spark, folder, convert(pages_to_arc(df), folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == expected(PAGES)


def test_damage_is_found():
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\nWARC-Block-Digest: sha1:X\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError, match="damaged"):
        list(read_warc(io.BytesIO(data)))


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_dir(spark, "warc-test")
    assert read_warcs(spark, folder, convert(pages_to_arc(df), folder)).count() == 0
