import hashlib

import pytest
from hyperdelta.llm import arc


def test_both_versions_of_headers():
    body = b"HTTP/1.0 200 OK\nServer: x\n\npay\n\nload\r\n"
    for version, fields in ((1, {"url": "http://a/b c", "ip": "1.2.3.4", "date": "19990102030405", "type": "text/html"}), (2, {"url": "http://a/b", "date": "1999", "type": "text/html", "offset": "77", "filename": "f"})):
        data = arc.write_arc([arc.ArcRecord(fields, body), arc.ArcRecord({**fields, "offset": "-5"}, b"")], version)
        one, two = arc.read_arc(data)
        assert one.content == body and two.content == b"" and all(one.fields[k] == v for k, v in fields.items())
        assert list(one.fields) == list(arc.FIELDS[version])
        warc = arc.to_warc(one)
        ((headers, block),) = arc.read_warc(warc + b"\r\n\r\n")
        assert block == body and headers["WARC-Type"] == "response" and headers["X-Payload-Length"] == "11"
        assert headers["WARC-Date"] == ("1999-01-02T03:04:05Z" if version == 1 else "1999-01-01T00:00:00Z")
        assert arc.number_of(headers["WARC-Record-ID"]) == (None if version == 1 else 77)
    (last,) = list(arc.read_arc(arc.write_arc([arc.ArcRecord({"url": "u", "date": "x", "offset": "-5"}, b"z")], 2)))
    for n, number in ((2**63 - 1, 2**63 - 1), (-(2**63) + 1, -(2**63) + 1), (2**63, None), ("x", None)):
        assert arc.number_in(arc.ArcRecord({"offset": str(n)}, b"")) == number
    assert arc.number_in(last) == -5 and arc.warc_date("x") == "1970-01-01T00:00:00Z"


def test_broken_archives_are_refused():
    with pytest.raises(ValueError, match="declares"):
        list(arc.read_arc(b"filedesc://f 0.0.0.0 1999 text/plain 100\nshort"))
    with pytest.raises(ValueError, match="header"):
        list(arc.read_arc(b"only three fields\n"))
    with pytest.raises(ValueError, match="declares|end"):
        list(arc.read_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


@pytest.mark.parametrize("n", [0, 1, -1, 2**63 - 1, -(2**63) + 1, None])
def test_identifiers_hold_numbers(n):
    a, b = arc.record_id(n, "x"), arc.record_id(n, "y")
    assert arc.number_of(a) == arc.number_of(b) == n and a != b and a[24] == "8"


def plain(pages, least=0):
    out = []
    for i, _, html in pages:
        payload = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        top = max(same) if i is not None and len(payload) >= least else i
        digest = arc.base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "response" if top == i else "revisit", None if top == i else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip_and_edges(spark, least):
    html = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>"
    pages = [(1, "http://a/ b", html), (2, None, html), (3, "http://c", None), (4, "", ""), (5, "x\ny", "HTTP/1.1 200\r\n\r\nnested"), (6, "http://d", html), (None, "http://e", html), (7, "http://f", "l" * 300_000), (8, "http://g", "ab"), (9, "http://g", "ab"), (9, "http://g", "ab")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, number long")
    assert sorted((tuple(r) for r in arc.round_trip(df, least).collect()), key=str) == plain(pages, least)
    assert arc.round_trip(df.limit(0)).count() == 0


def test_archives_of_many_records(spark):
    records = [arc.ArcRecord({"url": f"http://h/{i}", "date": "20200101", "type": "text/html", "offset": str(i)}, b"HTTP/1.1 200 OK\r\n\r\n" + b"\x00\xff" + str(i % 3).encode()) for i in range(50)]
    df = spark.createDataFrame([(arc.write_arc(records[:20]),), (arc.write_arc(records[20:]),), (arc.write_arc([], 1),), (None,)], "data binary")
    rows = {r["page_id"]: r for r in arc.read(spark, arc.convert(df)).collect()}
    assert len(rows) == 50 and {rows[i]["refers_to"] for i in range(47)} == {47, 48, 49} and rows[49]["record_type"] == "response" and rows[49]["payload_bytes"] == 3


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(arc, "BYTES_A_FILE", 5_000)
    pages = [(2**62 + i, "http://h", "x" * (i % 7 * 600)) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    source = [(arc.pages_as_arc(i, u, h.encode()),) for i, u, h in pages]
    path = arc.convert(spark.createDataFrame(source, "data binary"))
    sizes = [len(arc.gzip.decompress(r["content"])) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    assert len(sizes) > 20 and max(sizes) < 7_000
    assert sorted((tuple(r) for r in arc.round_trip(df).collect()), key=str) == plain(pages)


def test_broken_archives_do_not_stop_the_others(spark):
    """What comes before the break is converted, and the archive is listed."""
    records = [arc.ArcRecord({"url": f"http://h/{i}", "date": "20200101", "type": "text/html", "offset": str(i)}, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * i) for i in range(6)]
    whole, cut_off = arc.write_arc(records[:3]), arc.write_arc(records[3:])[:-4]
    rows = [(whole,), (cut_off,), (b"only three fields\n",), (b"no line end",), (None,), (b"",)]
    df = spark.createDataFrame(rows, "data binary")
    assert sorted(r["page_id"] for r in arc.read(spark, arc.convert(df)).collect()) == [0, 1, 2, 3, 4]
    found = {bytes(r["data"]): (r["n_records"], r["error"]) for r in arc.broken(df).collect()}
    assert found.keys() == {cut_off, b"only three fields\n", b"no line end"} and found[cut_off][0] == 2 and "declares" in found[cut_off][1]
