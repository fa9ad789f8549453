"""Legacy ARC archives converted to WARC, written, deduplicated and read back.

An ARC file is records of a header line and as many bytes as the line declares. Its first record describes the file and its
version: version 1 lines have five fields (URL, IP address, date, type, length), version 2 lines ten (with result code,
checksum, location, offset and file name before the length). Lengths, not content, say where a record ends. A record's
network document is a response with its HTTP head where it has one.

A record's WARC equivalent gets its identifier, date, type and digests from what the ARC record is and where it stood: the
identifier is a UUID that holds the record's number, so a reference can be followed without a lookup.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, stage_path

CRLF = b"\r\n"
#: The fields of a header line by version.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
#: Records of one archive file, and their bytes before compression; a reader takes a file as a whole.
RECORDS_A_FILE, BYTES_A_FILE = 2000, 32 << 20


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def write_arc(records: list[ArcRecord], version: int = 2, name: str = "pages.arc") -> bytes:
    """An ARC file of records whose fields hold no white space; missing fields are a dash."""
    about = f"{version} 0 legacy\n{' '.join(FIELDS[version])}\n".encode()
    head = ArcRecord({"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "20000101000000", "type": "text/plain", "status": "200", "filename": name}, about)
    out = []
    for r in [head, *records]:
        line = " ".join(str(len(r.content)) if f == "length" else r.fields.get(f) or "-" for f in FIELDS[version])
        out += [line.encode("utf-8", "replace"), b"\n", r.content, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the file's own, by its version's lines and the declared lengths."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        first = not version
        if first:
            version = 2 if len(values) == len(FIELDS[2]) else 1
        names = FIELDS[version]
        if len(values) > len(names):  # blanks in the URL
            values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not a version {version} header line at byte {at}")
        fields, at = dict(zip(names, values)), end + 1
        n = int(fields["length"])
        if at + n > len(data):
            raise ValueError(f"a record at byte {at} declares {n} bytes")
        content, at = data[at : at + n], at + n
        if first and fields["url"].startswith("filedesc:"):
            stated = content[:1].decode("latin-1")
            version = int(stated) if stated in "12" and stated else version
        else:
            yield ArcRecord(fields, content)


def salvaged(data: bytes) -> tuple[list[ArcRecord], str | None]:
    """The records before what is broken in an archive, and what is broken."""
    out: list[ArcRecord] = []
    try:
        for record in read_arc(data):
            out.append(record)
    except ValueError as e:
        return out, str(e) or "no line ends"
    return out, None


def broken(archives: DataFrame) -> DataFrame:
    """(data, n_records, error) of the archives (data) that break off: how many records come before, which convert() takes, and why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                records, error = salvaged(data.as_py() or b"")
                if error:
                    yield pa.RecordBatch.from_arrays([pa.array([data.as_py()], pa.binary()), pa.array([len(records)], pa.int64()), pa.array([error])], ["data", "n_records", "error"])

    return archives.select("data").mapInArrow(run, "data binary, n_records long, error string")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(number: int | None, salt: str) -> str:
    """A version 8 UUID: 58 bits of what the record is, then its number in 64 bits (the lowest number for none)."""
    n = (number if number is not None else -(1 << 63)) & (1 << 64) - 1
    mark = int.from_bytes(hashlib.sha1(salt.encode("utf-8", "replace")).digest()[:8], "big") >> 6
    free = mark << 64 | n  # 122 bits, around the version and the variant
    value = (free >> 74) << 80 | 8 << 76 | (free >> 62 & 0xFFF) << 64 | 2 << 62 | free & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def number_of(identifier: str) -> int | None:
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    n = (value >> 64 & 0x3) << 62 | value & (1 << 62) - 1
    n -= (n >> 63) << 64
    return None if n == -(1 << 63) else n


def warc_date(date: str) -> str:
    """An ARC date of 14 or fewer digits as WARC writes it; what is missing is the least."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :] if len(d) >= 4 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if len(d) == 14 else "1970-01-01T00:00:00Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, body); without a head all is body."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    ends = [(i + len(m)) for m in (b"\r\n\r\n", b"\n\n") if (i := content.find(m)) >= 0]
    cut_at = min(ends, default=len(content))
    return content[:cut_at], content[cut_at:]


def number_in(record: ArcRecord) -> int | None:
    """A version 2 record's offset; version 1 has none."""
    offset = record.fields.get("offset", "")
    number = int(offset) if re.fullmatch(r"-?[0-9]{1,19}", offset) else None
    return number if number is not None and abs(number) < 1 << 63 else None


def id_of(record: ArcRecord) -> str:
    f = record.fields
    return record_id(number_in(record), f"{f.get('filename', '-')} {f['url']} {f['date']}")


def to_warc(record: ArcRecord, refers_to: str | None = None) -> bytes:
    """The WARC record, without the two line ends behind it. With refers_to it is a revisit and leaves the payload out."""
    f = record.fields
    head, payload = split_http(record.content)
    block = head if refers_to else record.content
    kind = "revisit" if refers_to else "response" if head or f["url"].startswith("http") or f["url"] == "-" else "resource"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", id_of(record)),
        ("WARC-Date", warc_date(f["date"])),
        ("WARC-Target-URI", f["url"]),
        ("WARC-IP-Address", f["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(payload))),  # of the full payload, also where a revisit leaves it out
        *([("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to else []),
        ("Content-Type", "application/http; msgtype=response" if head else f["type"]),
        ("Content-Length", str(len(block))),
    ]
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "replace") for k, v in headers if v != "-"), b"", b""]
    return CRLF.join(lines) + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(CRLF * 2, at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        n = int(headers["Content-Length"])
        if data[start + n : start + n + 4] != CRLF * 2:
            raise ValueError(f"the record at byte {at} does not end where it declares")
        yield headers, data[start : start + n]
        at = start + n + 4


def pages_as_arc(page_id: int | None, url: str | None, html: bytes) -> bytes:
    """A page as a version 2 ARC file of one record, whose offset field is the page's number."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    address = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "-") or "-"
    fields = {"url": address, "ip": "0.0.0.0", "date": "20240101000000", "type": "text/html", "status": "200", "offset": "-" if page_id is None else str(page_id), "filename": "pages.arc"}
    return write_arc([ArcRecord(fields, head + html)], 2)


def convert(archives: DataFrame, least: int = 0) -> str:
    """Converts archives (data: whole ARC files) to WARC files, compressed by gzip, in the shared folder; the path of the folder.

    Of records with equal payloads of at least `least` bytes, the one with the largest number is a response and the others
    revisit it; a record without a number is always a response. A payload is known by its SHA-1 and its length. Of an archive that
    breaks off, the records before are converted; broken() tells which these are. A null archive is empty.
    """
    spark = archives.sparkSession
    prepare(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ids, names, sizes, records = [], [], [], [], []
            for data in batch.column(0):
                for r in salvaged(data.as_py() or b"")[0]:
                    payload = split_http(r.content)[1]
                    numbers.append(number_in(r))
                    ids.append(id_of(r))
                    names.append(digest(payload))
                    sizes.append(len(payload))
                    records.append((list(r.fields.items()), r.content))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
            columns = [numbers, ids, names, sizes, [f for f, _ in records], [c for _, c in records]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["number", "id", "digest", "size", "fields", "content"])

    parsed = archives.select("data").mapInArrow(parse, "number long, id string, digest string, size long, fields map<string,string>, content binary")
    narrow = parsed.where("number IS NOT NULL").where(F.col("size") >= least)
    groups = cut(narrow.groupBy("digest", "size").agg(F.max(F.struct("number", "id")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "size", "kept"))
    joined = parsed.join(groups, ["digest", "size"], "left").select("number", "fields", "content", F.col("kept.number").alias("to"), F.col("kept.id").alias("to_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(CRLF * 2).join(held)], pa.binary())], ["archive"])

        for batch in batches:
            for number, fields, content, to, to_id in zip(*(c.to_pylist() for c in batch.columns)):
                target = to_id if to is not None and number is not None and to != number else None
                record = to_warc(ArcRecord(dict(fields), content), target)
                if held and (len(held) == RECORDS_A_FILE or size + len(record) > BYTES_A_FILE):
                    yield archive()
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield archive()

    path = stage_path(spark, "warc")
    lines = joined.mapInArrow(write, "archive binary").select(F.col("archive").cast("string").alias("value"))
    # a row is a file; the text writer puts its bytes as they are, and behind them the two line ends that close the last record
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, record_id) of every record of the archives at a path.

    page_id and refers_to are the numbers in the identifiers. A response's digest and length are taken from its block and
    must be those that its headers state; a revisit has those of its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "record_id"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for data in batch.column(0):
                rows, data = [], data.as_py()
                for headers, block in read_warc(gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data):
                    stated, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] != "revisit":
                        payload = split_http(block)[1]
                        if digest(payload) != stated or len(payload) != size:
                            raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not what its headers state")
                    to = headers.get("WARC-Refers-To")
                    rows.append((number_of(headers["WARC-Record-ID"]), size, stated, headers["WARC-Type"], number_of(to) if to else None, headers.get("WARC-Target-URI"), headers["WARC-Record-ID"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string"
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Of every row of pages (page_id, url, html): what its WARC record says after ARC, conversion, writing and reading.

    A null html is an empty payload, a null url is left out of the record, and a null page_id makes a response. Rows that
    repeat a page_id with an equal payload are all the response.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array([pages_as_arc(n, u, h or b"") for n, u, h in rows], pa.binary())], ["data"])

    source = pages.select(F.col("page_id").cast("long"), "url", F.encode("html", "UTF-8").alias("html"))
    return read(pages.sparkSession, convert(source.mapInArrow(run, "data binary"), least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS top FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', h[i]) - 1), 4)), '') AS bits FROM b)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(1, 6), lambda i: (bits[5 * k + i] = '1')::INT * (1 << (5 - i))))::INT]), '') AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM bits
"""
