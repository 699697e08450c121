"""WARC derivatives: response records to linked metadata and conversion records.

Every response yields a ``metadata`` record (``application/warc-fields``: source
identifiers, digests and headers, title, language, links) and a ``conversion``
record (the page as plain text).  Both refer to the response by
``WARC-Refers-To`` and repeat its target URI, date and digests; their own record
ids are derived from the response's (UUID version 5), so a rerun or a retried
task writes the same records.

A response is a record with its WARC headers and its block, the HTTP message.  Digests that
its headers state are kept as they are, others are computed; its other WARC headers, the
status line and all HTTP headers stand in the metadata record.  Where only the page is known
(``responses``), the block is made from it.

Text: comments, scripts and styles go, block elements end a line, other tags go,
character references are resolved, white space is collapsed, empty lines go.

Defined results: a null or empty page gives both records, the text is empty; a body is read
in the charset of its Content-Type (else, or if unknown, UTF-8; faulty bytes become U+FFFD); a
body in a content or transfer coding is not decoded, its text is empty; a block without an
empty line is all headers; the id keeps its type; a null url: no target URI header and column; control characters and spaces in
header values are percent-encoded; repeated rows give repeated records; an empty
table gives an empty result; other columns are not looked at."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")    # RFC 4122, URLs

_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)")
_TITLE = re.compile(r"(?is)<title[^<>]*>(.*?)(?:</title\s*>|\Z)")
_LANG = re.compile(r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)")
_LINK = re.compile(r"(?is)<a\b[^<>]*?\bhref\s*=\s*[\"']([^\"'<>]*)[\"']")
_BLOCK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|"
                    r"li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>")
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_SPACES = re.compile(r"[^\S\n]+")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_VALUE = re.compile(r"[\x00-\x1f\x7f]")
_CHARSET = re.compile(r"(?i)\bcharset\s*=\s*[\"']?([^\s;\"']+)")
_FOLD = re.compile(r"\r?\n[ \t]+")

#: A response record: ``warc_headers`` its header lines, ``block`` the HTTP message.  Either may
#: be null or absent; without a block, ``html`` is the page.
RESPONSE = ("id long, record_id string, target_uri string, warc_date string, html string, warc_headers string, "
            "block binary")
DERIVED = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, "
           "warc_date string, content_type string, content_length long, block_digest string, "
           "source_payload_digest string, source_block_digest string, record binary")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    body = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub(" ", page)))
    lines = (_SPACES.sub(" ", line).strip() for line in html.unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def _header(value: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One serialised record; headers without a value are left out."""
    lines = [VERSION] + [f"{k}: {v}" for k, v in headers if v is not None]
    return "\r\n".join(lines + [f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def response_block(page: str) -> bytes:
    """The HTTP message of a page."""
    body = page.encode()
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
            ).encode() + body


def header_lines(text: str) -> list[tuple[str, str]]:
    """(name, value) of header lines; folded lines are joined, lines without a name go."""
    pairs = (line.partition(":") for line in _FOLD.sub(" ", text).splitlines())
    return [(name.strip(), _VALUE.sub(lambda m: f"%{ord(m[0]):02X}", value.strip()))
            for name, colon, value in pairs if colon and name.strip()]


def message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, lines = head.decode("latin-1").partition("\n")
    return _VALUE.sub("", status), header_lines(lines), body


def page_of(headers: dict[str, str], body: bytes) -> str:
    """The page as text; ``headers`` by lower-case name."""
    if any(headers.get(name, "identity").lower() not in ("", "identity")
           for name in ("content-encoding", "transfer-encoding")):
        return ""
    charset = _CHARSET.search(headers.get("content-type", ""))
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


#: WARC headers that a derivative has of its own.
_OWN = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-type", "content-length",
        "warc-block-digest", "warc-payload-digest"}


def metadata_fields(source: list[tuple[str, str | None]], page: str) -> str:
    title = _TITLE.search(page)
    lang = _LANG.search(page)
    named = [(k, v) for k, v in source if v is not None]
    if title:
        named.append(("title", " ".join(html.unescape(title[1]).split())))
    if lang:
        named.append(("language", lang[1].lower()))
    named += [("outlink", _header(html.unescape(link))) for link in _LINK.findall(page)]
    return "".join(f"{k}: {v}\r\n" for k, v in named)


def _schema(id_type: pa.DataType) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [(n, kinds[t]) for n, t in (c.split() for c in DERIVED.split(", "))]
    return pa.schema([(fields[0][0], id_type), *fields[1:]])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = _schema(batch.schema.field("id").type)
        out = []
        for row in batch.to_pylist():
            refers, uri, block = row["record_id"], row["target_uri"], row["block"]
            uri = None if uri is None else _header(uri)
            block = response_block(row["html"] or "") if block is None else block
            status, headers, body = message(block)
            stated = header_lines(row["warc_headers"] or "")
            warc = {name.lower(): value for name, value in stated}
            page = page_of({name.lower(): value for name, value in headers}, body)
            payload_digest = warc.get("warc-payload-digest") or digest(body)
            block_digest = warc.get("warc-block-digest") or digest(block)
            kind_of_block = warc.get("content-type") or "application/http;msgtype=response"
            links = [("WARC-Refers-To", f"<{refers}>"), ("WARC-Refers-To-Target-URI", uri),
                     ("WARC-Refers-To-Date", row["warc_date"]), ("WARC-Source-Payload-Digest", payload_digest),
                     ("WARC-Source-Block-Digest", block_digest), ("WARC-Source-Content-Type", kind_of_block)]
            source = [("sourceRecordId", f"<{refers}>"), ("sourceTargetURI", uri), ("sourceDate", row["warc_date"]),
                      ("sourcePayloadDigest", payload_digest), ("sourceBlockDigest", block_digest),
                      ("sourceContentType", kind_of_block), ("sourceContentLength", str(len(block)))]
            source += [("sourceHeader", f"{name}: {value}") for name, value in stated if name.lower() not in _OWN]
            source += [("sourceHttpStatus", status or None)]
            source += [("sourceHttpHeader", f"{name}: {value}") for name, value in headers]
            for kind, content, made in (
                    ("metadata", "application/warc-fields", metadata_fields(source, page).encode()),
                    ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
                name = f"urn:uuid:{uuid.uuid5(SPACE, refers + '#' + kind)}"
                own = digest(made)
                lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Target-URI", uri),
                         ("WARC-Date", row["warc_date"]), *links, ("WARC-Block-Digest", own),
                         ("WARC-Payload-Digest", own if kind == "conversion" else None), ("Content-Type", content)]
                out.append((row["id"], kind, name, refers, row["target_uri"], row["warc_date"], content, len(made),
                            own, payload_digest, block_digest, record(lines, made)))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                              if out else [pa.array([], f.type) for f in schema], schema=schema)


def responses(pages: DataFrame, warc_date: str, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """Pages as response records; the record id is derived from id and url."""
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                            F.coalesce(F.col(url_col), F.lit(""))))
    name = F.concat(F.lit("urn:uuid:"), F.regexp_replace(
        key, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5"))
    return pages.select(F.col(id_col).alias("id"), name.alias("record_id"),
                        F.col(url_col).alias("target_uri"), F.lit(warc_date).alias("warc_date"),
                        F.col(html_col).alias("html"))


def derivatives(response_rows: DataFrame) -> DataFrame:
    """Two records (metadata, conversion) for every response (columns RESPONSE, the last two
    optional), columns DERIVED."""
    added = [F.lit(None).cast(kind).alias(name) for name, kind in (("warc_headers", "string"), ("block", "binary"))
             if name not in response_rows.columns]
    rows = response_rows.select("*", *added).select("id", "record_id", "target_uri", "warc_date", "html",
                                                    "warc_headers", "block")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_derive, DERIVED.replace("page_id long", f"page_id {kind}", 1))
