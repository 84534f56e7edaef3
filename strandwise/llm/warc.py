"""WARC derivatives: metadata and plain-text conversion records of response records.

Records are bytes as ISO 28500 lays them out. A derivative refers to its response by record id and
repeats its target URI and date; the metadata record also carries the response's WARC and HTTP
headers and payload digest, so that nothing of the source's description is lost.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.text import lean

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

# What is not closed runs to the end of the page, so that no page is scanned again and again.
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!doctype[^>]*(?:>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|pre|blockquote)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<(?=[A-Za-z/!?])[^>]*(?:>|\Z)")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title[^<>]*>(.*?)(?:</title>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """A page's text: scripts, styles and tags gone, entities resolved, a line for each block."""
    page = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", page)))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(page))).strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its block digest and length."""
    lines = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = b"\r\n".join([VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in lines)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The records of some bytes (gzip members or plain), as headers and block."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as error:
            raise ValueError(f"damaged gzip: {error}") from error
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n") if end >= 0 else []
        if not lines or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = [(k.strip(), v.strip()) for k, _, v in (x.decode().partition(":") for x in lines[1:])]
        size = int(_get(headers, "Content-Length") or 0)
        if size < 0:
            raise ValueError("a record of negative length")
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is cut short")
        out.append((headers, block))
        at = end + 4 + size + 4
    return out


def _get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def response_of(url: str, page: str, key: str, date: str = DATE) -> bytes:
    """A response record of a page; its id follows from its key, so that runs agree."""
    payload = page.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record([("WARC-Type", "response"), ("WARC-Record-ID", _id("response", key)), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")], head + payload)


def _id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{key}')}>"


def derive(response: bytes) -> dict:
    """The metadata and conversion records of one response record, and what they hold."""
    ((headers, block),) = parse(response)
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    http_headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    charset = re.search(r"charset=([\w-]+)", _get(http_headers, "Content-Type") or "")
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, uri, date = (_get(headers, k) or "" for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    text = plain_text(page)
    links = [a or b or c for a, b, c in _LINK.findall(page)]
    title, lang = _TITLE.search(page), _LANG.search(page)
    common = [("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    fields = [("http-status", lines[0]), *((f"http-{k.lower()}", v) for k, v in http_headers), *((f"source-{k.lower()}", v) for k, v in headers)]
    fields += [("title", plain_text(title[1]) if title else ""), ("language", lang[1] if lang else ""), ("charset", charset[1] if charset else ""), *(("outlink", html.unescape(x)) for x in links)]
    body = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode()
    meta_id, conv_id = _id("metadata", source), _id("conversion", source)
    plain = text.encode()
    meta = record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *common, ("WARC-Concurrent-To", conv_id), ("Content-Type", "application/warc-fields")], body)
    conv = record([("WARC-Type", "conversion"), ("WARC-Record-ID", conv_id), *common, ("WARC-Source-Payload-Digest", _get(headers, "WARC-Payload-Digest") or digest(payload)), ("WARC-Payload-Digest", digest(plain)), ("Content-Type", "text/plain; charset=utf-8")], plain)
    return {"response_id": source, "metadata_id": meta_id, "conversion_id": conv_id, "payload_digest": _get(headers, "WARC-Payload-Digest") or digest(payload), "text_digest": digest(plain), "n_links": len(links), "title": plain_text(title[1]) if title else "", "text": text, "metadata": meta, "conversion": conv}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(id, response binary): a response record of each page. Null urls and pages are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            out = [response_of(u or "", p or "", f"{i}|{u or ''}", date) for i, u, p in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "response"])

    held = pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return held.mapInArrow(lean(run), f"`{id_col}` bigint, response binary")


DERIVED = "response_id string, metadata_id string, conversion_id string, payload_digest string, text_digest string, n_links bigint, title string, text string, metadata binary, conversion binary, error string"


def derivatives(records: DataFrame, id_col: str = "page_id", response_col: str = "response") -> DataFrame:
    """The linked metadata and conversion records of every response record (bytes), with their ids,
    digests and text. A null, damaged or cut record, or one of negative length, gives a row with its error and nulls elsewhere; null
    ids come back null; repeated rows give repeated rows; an empty table gives none."""
    names = [id_col, *(x.split()[0] for x in DERIVED.split(", "))]
    kinds = {"n_links": pa.int64(), "metadata": pa.binary(), "conversion": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for data in part.column(1).to_pylist():
                    try:
                        rows.append(derive(data or b""))
                    except ValueError as error:
                        rows.append({"error": str(error)})
                cols = [pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    held = records.select(F.col(id_col).cast("bigint").alias(id_col), F.col(response_col).alias("response"))
    return held.mapInArrow(lean(run), f"`{id_col}` bigint, {DERIVED}")
