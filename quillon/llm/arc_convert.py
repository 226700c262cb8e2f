"""Legacy ARC archives, their conversion to WARC, and the reading of WARC archives.

The converter reads an ARC archive record by record: the version block names the version and the fields of the header
lines (five fields in version 1, ten in version 2), a header line's last field declares the length of what follows.
For each record it makes up the WARC equivalents: a record id (a name-based UUID), an ISO 8601 date from the digits of
the archive date, a record type (response for http and https, resource for other schemes, warcinfo for the version
block), and SHA-1 digests in base 32.

``pages_to_arc`` puts pages into ARC archives, ``arc_to_records`` converts, ``revisits`` finds records with equal
payloads, ``write_archives`` writes a WARC file for each ARC archive into a shared folder, ``read_archives`` reads them
back and resolves revisits by the record ids that they refer to. Only ids, sizes and digests are joined; payloads stay
in their archives. Files are written by Spark's own writer, with its commit protocol: a lost executor leaves no half
archive, and any file system that Spark knows will do.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b16encode, b32decode, b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, bounded_batches, materialize

#: Fixed values of the formats.
VERSION_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of at least so many bytes become revisits of an equal one. Bytes after which an archive is closed.
LEAST_REVISIT, ARCHIVE_BYTES = 1000, 8 << 20

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quillon:arc")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    version: int
    status: int | None = None
    checksum: str | None = None


def _field(value: str | None) -> str:
    """A header field holds no white space or control characters: these are percent-encoded, and nothing else is changed.
    Nothing at all becomes ``-``."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value) if value else "-"


def write_arc(records: list[ArcRecord], version: int, name: str, date: str) -> bytes:
    """An ARC archive of the given version."""
    inside = f"{version} 0 quillon\n{VERSION_FIELDS[version]}\n".encode()
    out, size = [], 0
    for r in [ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", inside, version), *records]:
        middle = "" if version == 1 else f" {r.status or 200} {r.checksum or '-'} - {size} {_field(name)}"
        line = f"{_field(r.url)} {_field(r.ip)} {r.date} {_field(r.mime)}{middle} {len(r.content)}\n".encode()
        out += [line, r.content, b"\n"]
        size += len(line) + len(r.content) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive, the version block first. A header or length that does not hold is an error."""
    at, version, fields = 0, None, VERSION_FIELDS[1].split()
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        stop = data.index(b"\n", at)
        parts = data[at:stop].decode().rstrip("\r").split(" ")
        if version is None:
            length = int(parts[-1])
            head = data[stop + 1 : stop + 1 + length].decode().split("\n")
            version = int(head[0].split(" ")[0])
            if version not in VERSION_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = head[1].split() if len(head) > 1 and head[1].startswith("URL") else VERSION_FIELDS[version].split()
            given = VERSION_FIELDS[1 if len(parts) == 5 else 2].split()
        else:
            given = fields
        if len(parts) != len(given):
            raise ValueError(f"ARC header with {len(parts)} fields, not {len(given)}")
        named = dict(zip(given, parts))
        length = int(named["Archive-length"])
        content = data[stop + 1 : stop + 1 + length]
        if length < 0 or len(content) != length:
            raise ValueError("ARC record shorter than its declared length")
        status = named.get("Result-code", "-")
        checksum = named.get("Checksum", "-")
        yield ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], content, version, int(status) if status.isdigit() else None, None if checksum == "-" else checksum)
        at = stop + 1 + length


def warc_date(digits: str) -> str:
    """ISO 8601 of an archive date of 4 to 14 digits; missing parts are the first of their kind."""
    if not re.fullmatch(r"\d{4,14}", digits):
        return "1970-01-01T00:00:00Z"
    d = (digits + "00000101000000"[len(digits) :]) if len(digits) < 14 else digits
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(parts))}>"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, and the payload."""
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if content.startswith(b"HTTP/") and at >= 0 else (b"", content)


def _header(http: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", http)
    return found[1].decode() if found else None


def _base32(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, block: bytes, **headers: str | int | None) -> bytes:
    """A WARC record without its two closing line ends."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in headers.items() if value is not None]
    lines += [f"WARC-Block-Digest: {_base32(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names; ``version``) and block of each record. A length that does not hold is an error."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = {"version": first} | {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) != length:
            raise ValueError("WARC record shorter than its declared length")
        if headers.get("warc-block-digest", _base32(block)) != _base32(block):
            raise ValueError("WARC block digest does not hold")
        yield headers, block
        at = stop + 4 + length


ARCHIVE = "name string, content binary"
RECORD = "archive string, place long, record_id string, page_id long, type string, url string, date string, ip string, mime string, http binary, payload binary, payload_bytes long, payload_digest string"


def _squeezed(data: bytes, level: int) -> bytes:
    """A gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def unzipped(data: bytes, piece: int = 1 << 14) -> bytes:
    """The content of a gzip file of any number of members, zero bytes between and after them left out. What follows a member
    is copied a piece at a time; ``gzip.decompress`` copies all of it, for each member. A cut member is an error."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        if not data[at]:
            at += 1
            continue
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise EOFError("gzip member cut short")
            out.append(member.decompress(view[at : at + piece]))
            at = min(at + piece, len(data))
        at -= len(member.unused_data)
    return b"".join(out)


def pages_to_arc(pages: DataFrame, date: str = "20040101120000") -> DataFrame:
    """Compressed ARC archives (``name``, ``content``) of about ARCHIVE_BYTES with a record for each page, versions 1 and 2 in turn.

    The HTTP header carries the page's id. A null html is an empty payload, a null url is ``-``, a null id is left out.
    No two archives have one name.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"legacy-{part:06d}-{n:06d}.arc.gz"
            return pa.RecordBatch.from_pydict({"name": pa.array([name]), "content": pa.array([_squeezed(write_arc(held, 1 + n % 2, name, date), 1)], pa.binary())})

        for batch in batches:
            ids, urls, texts = batch.columns
            for i in range(batch.num_rows):
                payload = (texts[i].as_py() or "").encode()
                page = ids[i].as_py()
                http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
                held.append(ArcRecord(urls[i].as_py() or "", "0.0.0.0", date, "text/html", http.encode() + payload, 1))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    return bounded_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(put, ARCHIVE)


def convert(name: str, content: bytes) -> Iterator[tuple]:
    """The WARC equivalents (columns of RECORD) of a compressed archive's records; the version block that opens it is left out.

    A record's id is made of the archive's name and its place there, so repeated pages have ids of their own."""
    for place, r in enumerate(islice(read_arc(unzipped(content)), 1, None)):  # the version block is always first
        http, payload = split_http(r.content)
        page = _header(http, b"X-Page-Id")
        digest = hashlib.sha1(payload).hexdigest()
        yield name, place, record_id(name, str(place)), int(page) if page is not None else None, "response" if http else "resource", r.url, warc_date(r.date), r.ip, r.mime, http, payload, len(payload), digest


def arc_to_records(archives: DataFrame, *columns: str) -> DataFrame:
    """WARC equivalents of the records of ARC archives, see ``convert``: all columns, or those named."""
    texts, numbers = {"http", "payload"}, {"place", "page_id", "payload_bytes"}
    every = [x.split(" ")[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.binary() if n in texts else pa.int64() if n in numbers else pa.string()) for n in every if not columns or n in columns])
    at = [every.index(n) for n in schema.names]

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = convert(name.as_py(), content.as_py())
                while some := [[r[i] for i in at] for r in islice(rows, 500)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    kinds = dict(x.split(" ") for x in RECORD.split(", "))
    return bounded_batches(archives).select("name", "content").mapInArrow(converted, ", ".join(f"{n} {kinds[n]}" for n in schema.names))


def revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``archive``, ``place``, ``target``: the records that refer to another with an equal payload of at least ``least``
    bytes, and that record's id: of equal payloads the one with the largest page id stays.

    Records without a page id take no part. Rows that repeat the largest page id all stay. Maxima are pre-aggregated;
    a payload shared by a third of all pages is a skewed key of a join of short rows, which adaptive execution splits.
    """
    whole = records.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("archive", "place", "record_id", "page_id", F.unhex("payload_digest").alias("digest"))
    groups = whole.groupBy("digest").agg(F.max(F.struct("page_id", "record_id")).alias("kept"), F.min("page_id").alias("low")).filter("kept.page_id <> low")
    return whole.join(groups, "digest").filter("page_id <> kept.page_id").select("archive", "place", F.col("kept.record_id").alias("target"))


def write_archives(archives: DataFrame, repeats: DataFrame, path: str) -> None:
    """Writes a compressed WARC file for each ARC archive into the folder ``path``, with a warcinfo record first; the
    records that ``repeats`` names become revisits. Each record is a gzip member of its own, so it can be read alone;
    the writer ends a file with a zero byte, which gzip takes for padding."""
    marks = repeats.groupBy("archive").agg(F.collect_list(F.struct("place", "target")).alias("marks"))  # at most an archive's records

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def member(record: bytes) -> bytes:
            return _squeezed(record + b"\r\n\r\n", 3)

        info = b"software: quillon\r\nformat: WARC File Format 1.1\r\n"
        for batch in batches:
            for name, content, mark in zip(*batch.columns):
                name, target = name.as_py(), {m["place"]: m["target"] for m in mark.as_py() or ()}
                out = [member(warc_record("warcinfo", info, WARC_Record_ID=record_id(name), WARC_Date="2004-01-01T00:00:00Z", Content_Type="application/warc-fields"))]
                for _, place, own, _, kind, url, date, ip, mime, http, payload, _, digest in convert(name, content.as_py()):
                    shown = "sha1:" + b32encode(bytes.fromhex(digest)).decode()
                    named = {"WARC_Record_ID": own, "WARC_Date": date, "WARC_Target_URI": url, "WARC_IP_Address": ip, "WARC_Payload_Digest": shown, "Content_Type": "application/http; msgtype=response" if http else mime}
                    if place in target:
                        out.append(member(warc_record("revisit", http, **named, WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=target[place])))
                    else:
                        out.append(member(warc_record(kind, http + payload, **named)))
                yield pa.RecordBatch.from_pydict({"content": pa.array([b"".join(out)], pa.binary())})

    rows = archives.join(marks, archives["name"] == marks["archive"], "left").select("name", "content", "marks")
    contents = bounded_batches(rows).mapInArrow(packed, "content binary")
    contents.select(F.col("content").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, target string, record_id string, url string, date string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``record_id``, ``url``, ``date`` of the WARC
    records in a folder. Responses' payloads are hashed anew and compared with what their records declare. What a
    revisit refers to, and so the page and the size, is the record with that id."""
    schema = pa.schema([(x.split(" ")[0], pa.int64() if x.endswith(" long") else pa.string()) for x in FOUND.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in read_warc(unzipped(content.as_py())):
                    if h["warc-type"] == "warcinfo":
                        continue
                    declared = b16encode(b32decode(h["warc-payload-digest"].removeprefix("sha1:"))).decode().lower()
                    http, payload = split_http(block)
                    page, size = _header(http, b"X-Page-Id"), None
                    if h["warc-type"] != "revisit":
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != declared:
                            raise ValueError("WARC payload digest does not hold")
                    rows.append((int(page) if page is not None else None, size, declared, h["warc-type"], h.get("warc-refers-to"), h["warc-record-id"], h["warc-target-uri"], h["warc-date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    found = materialize(bounded_batches(files).select("content").mapInArrow(read, FOUND), "warc-records")
    alone = found.filter("target is null").withColumn("refers_to", F.lit(None).cast("long"))
    kept = found.filter("target is null").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    again = found.filter("target is not null").join(kept, "target", "left").withColumn("payload_bytes", F.col("size"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]
    return alone.select(columns).union(again.select(columns))


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Pages by way of ARC archives into WARC files under ``path``, and the records read back from there.

    One row for each row of ``pages`` (``page_id``, ``url``, ``html``; more columns are ignored; repeated rows stay). An empty
    table gives no rows. The ARC archives are kept until the WARC files are written.
    """
    with Scratch(pages.sparkSession, "arc") as scratch:
        archives = scratch.table(pages_to_arc(pages), "archives")
        records = scratch.table(arc_to_records(archives, "archive", "place", "record_id", "page_id", "payload_bytes", "payload_digest"), "records")
        write_archives(archives, revisits(records), path)
    return read_archives(pages.sparkSession, path)
