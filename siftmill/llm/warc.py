"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from."""

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

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Date of responses whose table names none.
DATE = "2024-01-01T00:00:00Z"

# No pattern runs past the next tag or, unclosed, more than once to the end: a hostile page costs no more than its length.
_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)")
_BLOCK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|title|head|body|html|blockquote|pre|hr|dt|dd|dl|form|option|td|th)\b[^>]*>")
_TAG = re.compile(r"(?s)<[a-zA-Z/!?][^>]*>")
_LINK = re.compile(r"""(?is)<a\b[^<>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TITLE = re.compile(r"(?is)<title\b[^<>]*>([^<]*)</title\s*>")
_LANG = re.compile(r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z-]+)""")

RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length long, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError where its parts or lengths do not fit."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers.get("content-length", "-1"))
    if n < 0 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the length of the block is not that of its header")
    return headers, rest[:n]


def plain_text(page: str) -> str:
    """Visible text: scripts, styles and comments go, block elements break lines, references are decoded.

    What is not closed reaches to the end of the page; a last tag without its end is text.
    """
    seen = _DROPPED.sub(" ", page)
    cut = seen.rfind(">") + 1
    text = _TAG.sub("", _BLOCK.sub("\n", seen[:cut])) + seen[cut:]
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def outlinks(page: str) -> list[str]:
    return [html.unescape(next(x for x in m.groups() if x is not None)) for m in _LINK.finditer(_DROPPED.sub(" ", page))]


def response(page_id: object, url: str, page: str, date: str = DATE) -> tuple[str, list[tuple[str, str | None]], bytes, bytes]:
    """Record id, headers, block and payload of a page as an HTTP response."""
    payload = page.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    rid = record_id("response", page_id, url, digest(payload))
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload))]
    return rid, headers, block, payload


def derivatives(record: bytes) -> list[tuple[str, str, bytes]]:
    """(type, record id, record) of the metadata and the conversion record of a response record."""
    source, block = parse(record)
    head, _, payload = block.partition(b"\r\n\r\n")
    page = payload.decode("utf-8", "replace")
    title, lang = _TITLE.search(page), _LANG.search(page)
    status = head.split(b"\r\n", 1)[0].decode("latin-1")
    kind = next((x.split(b":", 1)[1].strip().decode("latin-1") for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-type:")), None)
    fields = [("status", status), ("http-content-type", kind), ("title", " ".join(html.unescape(title[1]).split()) if title else None), ("language", lang[1].lower() if lang else None), ("source-payload-digest", source.get("warc-payload-digest")), ("source-block-digest", source.get("warc-block-digest")), *(("outlink", x) for x in outlinks(page))]
    out = []
    for name, mime, body in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None).encode()),
        ("conversion", "text/plain; charset=UTF-8", plain_text(page).encode()),
    ):
        rid = record_id(name, source.get("warc-record-id"), digest(body))
        headers = [("WARC-Type", name), ("WARC-Record-ID", rid), ("WARC-Date", source.get("warc-date")), ("WARC-Target-URI", source.get("warc-target-uri")), ("WARC-Refers-To", source.get("warc-record-id")), ("Content-Type", mime), ("WARC-Block-Digest", digest(body)), ("WARC-Payload-Digest", digest(body) if name == "conversion" else source.get("warc-payload-digest"))]
        out.append((name, rid, serialise(headers, body)))
    return out


def build_warc(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Three linked records for each page: the response, its metadata and its plain-text conversion.

    Derivatives name the response in WARC-Refers-To and keep its date, target and digests; record ids follow from what
    they identify, so reruns and retried tasks write the same records. A null url counts as empty, null html as an empty
    page, a long or malformed one is read whole; a null key is kept; repeated rows give repeated records; an empty table gives none; other columns are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = []
                for row in batch.slice(lo, 200).to_pylist():
                    address = " ".join((row["url"] or "").split())
                    rid, headers, block, payload = response(row["page_id"], address, row["html"] or "")
                    record = serialise(headers, block)
                    for kind, ident, made in (("response", rid, record), *derivatives(record)):
                        h, b = parse(made)
                        rows.append((row["page_id"], kind, ident, h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"], h["content-type"], h["warc-block-digest"], h["warc-payload-digest"], len(b), made))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(each, RECORD)
