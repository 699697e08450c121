"""WARC derivatives: records are parsed back and digests recomputed."""

import base64
import hashlib
import uuid

from simsift.llm import warc
from simsift.llm.queries import WARC_DATE

SCHEMA = "page_id long, url string, html string, record string"
PAGE = ("<!DOCTYPE html><html lang='EN-gb'><head><title>A &amp; B\n C</title><style>p{x}</style><script>var a='</p>';</script>"
        "</head><body><!-- gone <b> --><nav><a href=\"/x?a=1&amp;b=2\">X</a></nav><p>One <b>bold</b>  word</p><p>Two&nbsp;é<br>"
        "three</p>2 < 3 &lt;tag&gt;<script>open")


def parse(record):
    """(version, headers, block) of one serialised record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    assert rest[size:] == b"\r\n\r\n"
    return version, headers, rest[:size]


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_plain_text():
    assert warc.plain_text(PAGE) == "A & B\nC\nX\nOne bold word\nTwo é\nthree\n2 < 3 <tag>"
    assert warc.plain_text("") == "" and warc.plain_text("<p><p><br>") == ""
    assert warc.plain_text("a<!-- open") == "a" and warc.plain_text("< b >") == "< b >"


def check(pages, rows):
    made = {}
    for r in rows:
        made.setdefault(r.page_id, []).append(r)
    for page_id, url, html in pages:
        page = html or ""
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page.encode())}\r\n\r\n"
                 + page).encode()
        for r in made[page_id]:
            version, headers, content = parse(bytes(r.record))
            assert version == "WARC/1.1" and headers["WARC-Type"] == r.record_type
            assert headers["WARC-Record-ID"] == f"<{r.record_id}>" and headers["WARC-Refers-To"] == f"<{r.refers_to}>"
            assert r.record_id == f"urn:uuid:{uuid.uuid5(warc.SPACE, r.refers_to + '#' + r.record_type)}"
            assert headers["WARC-Date"] == headers["WARC-Refers-To-Date"] == WARC_DATE
            assert headers["WARC-Block-Digest"] == sha1(content) == r.block_digest
            assert headers["WARC-Source-Payload-Digest"] == sha1(page.encode()) == r.source_payload_digest
            assert headers["WARC-Source-Block-Digest"] == sha1(block) == r.source_block_digest
            assert len(content) == r.content_length and headers["Content-Type"] == r.content_type
            assert ("WARC-Target-URI" in headers) == (url is not None) and r.target_uri == url
            if r.record_type == "conversion":
                assert content.decode() == warc.plain_text(page)
            else:
                fields = [line.split(": ", 1) for line in content.decode().split("\r\n")[:-1]]
                assert dict(fields)["sourceRecordId"] == f"<{r.refers_to}>"
                assert dict(fields)["sourcePayloadDigest"] == sha1(page.encode())


def test_records(spark):
    pages = [(1, "http://a.example/x y\r\nEvil: 1", PAGE), (2, None, None), (3, "http://b/", ""), (4, "http://c/", "<p>" * 50_000)]
    df = spark.createDataFrame([(*p, "") for p in pages] + [(1, "http://a.example/x y\r\nEvil: 1", PAGE, "")], SCHEMA)
    rows = warc.derivatives(warc.responses(df, WARC_DATE)).collect()
    assert len(rows) == 10 and len({r.record_id for r in rows}) == 8
    check(pages, rows)
    one = next(r for r in rows if r.page_id == 1 and r.record_type == "metadata")
    _, headers, content = parse(bytes(one.record))
    assert headers["WARC-Target-URI"] == "http://a.example/x%20y%0D%0AEvil:%201" and "Evil" not in headers
    assert "title: A & B C\r\n" in content.decode() and "language: en-gb\r\n" in content.decode()
    assert "outlink: /x?a=1&b=2\r\n" in content.decode()
    assert warc.derivatives(warc.responses(df.limit(0), WARC_DATE)).count() == 0


def test_source_headers_are_kept(spark):
    """Whole response records: what their headers say stands in the derivatives."""
    body = "<title>caf\u00e9</title><p>na\u00efve</p>".encode("latin-1")
    plain = b"HTTP/1.1 404 Not Found\r\nServer: x\r\nX-Long: a\r\n  b\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + body
    headers = ("WARC-Type: response\r\nWARC-IP-Address: 192.0.2.7\r\nWARC-Payload-Digest: sha1:GIVEN\r\n"
               "Content-Type: application/http; msgtype=response\r\nContent-Length: 5\r\n")
    coded = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n\x1f\x8b\x00"
    odd = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=none-such\r\n\r\n<p>\xff ok"
    rows = [("a", "urn:a", "http://a/", "d", None, headers, plain), ("b", "urn:b", None, "d", "unused", None, coded),
            ("c", "urn:c", None, "d", None, "", odd), ("d", "urn:d", None, "d", None, None, b""),
            ("e", "urn:e", None, "d", None, "no name\r\n: none\r\n", b"HTTP/1.1 200 OK\r\nServer: y")]
    df = spark.createDataFrame(rows, warc.RESPONSE.replace("id long", "id string", 1))
    made = {(r.page_id, r.record_type): r for r in warc.derivatives(df).collect()}
    assert len(made) == 10
    _, head, fields = parse(bytes(made["a", "metadata"].record))
    lines = fields.decode().split("\r\n")
    assert head["WARC-Source-Payload-Digest"] == "sha1:GIVEN" and head["WARC-Source-Block-Digest"] == sha1(plain)
    assert head["WARC-Source-Content-Type"] == "application/http; msgtype=response"
    assert [x for x in lines if x.startswith("sourceH")] == [
        "sourceHeader: WARC-IP-Address: 192.0.2.7", "sourceHttpStatus: HTTP/1.1 404 Not Found", "sourceHttpHeader: Server: x",
        "sourceHttpHeader: X-Long: a b", "sourceHttpHeader: Content-Type: text/html; charset=ISO-8859-1"]
    assert f"sourceContentLength: {len(plain)}" in lines and "title: caf\u00e9" in lines
    texts = {i: parse(bytes(made[i, "conversion"].record))[2].decode() for i in "abcde"}
    assert texts == {"a": "caf\u00e9\nna\u00efve", "b": "", "c": "\ufffd ok", "d": "", "e": ""}
    assert made["b", "conversion"].source_payload_digest == sha1(b"\x1f\x8b\x00")
    assert b"sourceHttpHeader: Server: y" in bytes(made["e", "metadata"].record)


def test_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.derivatives(warc.responses(pages, WARC_DATE)).collect()
    assert len(rows) == 2 * pages.count()
    check([(r.page_id, r.url, r.html) for r in pages.collect()], rows)
