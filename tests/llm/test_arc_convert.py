import gzip
import hashlib
import random
import time

import pytest

from quillon.llm import arc_convert as a
from quillon.llm.storage import fresh_path


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    records = [a.ArcRecord("http://x.example/a b", "1.2.3.4", "20010203040506", "text/html", http + b"pay\nload\n", version, 404, "abc"), a.ArcRecord("ftp://y", "0.0.0.0", "1999", "", b"", version)]
    back = list(a.read_arc(a.write_arc(records, version, "n.arc", "20000101000000")))
    assert back[0].url == "filedesc://n.arc" and [r.content for r in back[1:]] == [r.content for r in records]
    assert back[1].url == "http://x.example/a%20b" and back[1].status == (404 if version == 2 else None)
    with pytest.raises(ValueError):
        list(a.read_arc(a.write_arc(records, version, "n.arc", "20000101000000")[:-30]))


def test_dates_and_ids():
    assert a.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and a.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert a.warc_date("200102030405") == "2001-02-03T04:05:00Z" and a.warc_date("x") == "1970-01-01T00:00:00Z"
    assert a.record_id("page", "1") == a.record_id("page", "1") != a.record_id("page", "2")


def test_warc_round_trip_of_hostile_block():
    block = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"
    data = a.warc_record("resource", block, WARC_Record_ID="<x>") + b"\r\n\r\n" + a.warc_record("resource", b"", WARC_Record_ID="<y>") + b"\r\n\r\n"
    found = list(a.read_warc(data))
    assert [b for _, b in found] == [block, b""] and found[1][0]["warc-record-id"] == "<y>"
    with pytest.raises(ValueError):
        list(a.read_warc(data.replace(b"response", b"reXponse")))


def test_pages_through_archives(spark, monkeypatch):
    big, odd = "é" * 600, "WARC/1.1\r\n\r\n" + "\r\n\x00 " * 300
    rows = [(1, "http://a", big), (2, "http://a", big), (9, None, big), (3, "http://b", "x" * 999), (4, "http://b", "x" * 999), (5, "http://c", None), (6, "", ""), (7, "u v\n", odd), (7, "u v\n", odd), (None, "http://n", big), (10, "http://z", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, type int")
    path = fresh_path(spark, "warc")
    found = a.archive_pages(df, path)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        revisit = page is not None and len(data) >= 1000 and page != max(same)
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    got = [tuple(r)[:5] for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    text = spark.read.format("binaryFile").load(path).collect()
    whole = [gzip.decompress(r.content) for r in text]
    assert all(x.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and x.endswith(b"\r\n\r\n") for x in whole)
    assert a.archive_pages(df.limit(0), fresh_path(spark, "warc")).count() == 0


def test_many_members_are_read_in_proportion():
    """An archive of many small members: what follows a member is not copied again for each."""
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 1500, 16384, 70000)] * 20
    data = b"".join(gzip.compress(p) + bytes(rng.randrange(3)) for p in parts)
    assert a.unzipped(data) == gzip.decompress(data) == b"".join(parts) and a.unzipped(b"") == b""
    with pytest.raises(EOFError):
        a.unzipped(gzip.compress(parts[3])[:-1])
    one = rng.randbytes(1500)
    began = time.process_time()
    assert a.unzipped(gzip.compress(one) * 20_000) == one * 20_000  # copying all that follows moves 300 GB
    assert time.process_time() - began < 10
