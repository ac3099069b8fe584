"""WARC derivative builder: metadata and plain-text conversion records from responses.

Every response gives one metadata record (title, language, character set, links out) and one conversion record
(its text). Both carry the response's record id as WARC-Refers-To, its target URI, date, headers and payload
digest, and a digest of their own block. Record ids are hashes of what they identify, so a rerun or a retried
task gives the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every alternative runs to the end of the page where its end is missing, so no part of a page is searched twice.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
TITLE, TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
#: Start tags whose attributes are read, up to the mark that ends them.
TAG = re.compile(r"<(html|meta|a)\b[^>]*", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
CHARSET = re.compile(r"\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
#: Elements that end a line of text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
SPACES = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\s*\n\s*")
EPOCH = "1970-01-01T00:00:00Z"

RECORD = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_digest string, source_headers map<string,string>, content string"
)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    """Text of an HTML page: no scripts, styles or comments, one line for each block."""

    def mark(m: re.Match) -> str:
        tag = m[3]
        if not m[0].endswith(">") and not m[1] and not m[0].startswith("<!--"):
            # never ended: text as it stands, up to a comment in it
            return m[0].split("<!--")[0] + (" " if "<!--" in m[0] else "")
        return "\n" if tag and tag.lower() in BLOCKS else ("" if tag else " ")

    text = html.unescape(MARKUP.sub(mark, SPACES.sub(" ", page.replace("\n", " "))))
    return LINES.sub("\n", SPACES.sub(" ", text)).strip()


def metadata_fields(page: str) -> str:
    """application/warc-fields block of a page, in one pass over its tags: a tag's first link, the first language and set."""
    one_line = lambda x: SPACES.sub(" ", html.unescape(x).replace("\n", " ")).strip()
    fields, links = {}, []
    # behind the last mark no tag ends; a title without an end has none behind a later start either
    last = page.rfind(">") + 1
    if (start := TITLE.search(page, 0, last)) and (end := TITLE_END.search(page, start.end())):
        fields["title"] = page[start.end() : end.start()]
    for tag in TAG.finditer(page):
        name = tag[1].lower()
        if name == "a":
            if (href := HREF.search(page, tag.start(), tag.end())) and (value := VALUE.match(page, href.end())):
                links.append(value[value.lastindex])
        elif (kind := "language" if name == "html" else "charset") not in fields and (m := (LANG if name == "html" else CHARSET).search(page, tag.start(), tag.end())):
            fields[kind] = m[1]
    named = [(k, fields[k]) for k in ("title", "language", "charset") if k in fields]
    return "".join(f"{name}: {one_line(value)}\r\n" for name, value in [*named, *(("outlink", x) for x in links)])


def derived_records(page_id, url, page, source_id, date, headers) -> list[tuple]:
    """Rows of the metadata and the conversion record of one response; absent parts may be None."""
    page, url, date = page or "", url or "", date or EPOCH
    source_digest = digest(page.encode())
    source_id = source_id or record_id("response", str(page_id), url, source_digest)
    kept = {"WARC-Type": "response", "WARC-Record-ID": source_id, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": source_digest, "Content-Type": "text/html"}
    kept |= {k: v for k, v in (headers or {}).items() if v is not None}
    out = []
    for kind, media, content in (("metadata", "application/warc-fields", metadata_fields(page)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        block = content.encode()
        out.append((page_id, kind, record_id(kind, source_id), source_id, url, date, media, len(block), digest(block), source_digest, kept, content))
    return out


def derive_records(responses: DataFrame) -> DataFrame:
    """Two rows for each response (page_id, url, html; optional record_id, date, headers map).

    Null html is an empty page with an empty conversion, null urls are empty, a response without its own record
    id gets one from page_id, url and payload. Equal rows give equal records. Columns beyond those named are not
    read; an empty table gives an empty result.
    """
    have = set(responses.columns)
    optional = [F.col(c).cast(t).alias(f"_{c}") if c in have else F.lit(None).cast(t).alias(f"_{c}") for c, t in (("record_id", "string"), ("date", "string"), ("headers", "map<string,string>"))]
    schema = pa.schema(
        [("page_id", pa.int64())]
        + [(n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type")]
        + [("content_length", pa.int64()), ("block_digest", pa.string()), ("source_digest", pa.string()), ("source_headers", pa.map_(pa.string(), pa.string())), ("content", pa.string())]
    )

    def run(batches):
        for batch in batches:
            columns = [batch[n].to_pylist() for n in ("page_id", "url", "html", "_record_id", "_date", "_headers")]
            for at in range(0, batch.num_rows, 256):
                rows = [r for item in zip(*(c[at : at + 256] for c in columns)) for r in derived_records(*item[:5], dict(item[5]) if item[5] else None)]
                arrays = [pa.array([list(r[k].items()) for r in rows] if schema.names[k] == "source_headers" else [r[k] for r in rows], schema.types[k]) for k in range(len(schema))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return responses.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *optional).mapInArrow(run, RECORD)


def record_bytes(row) -> bytes:
    """A derived record in WARC/1.1 form; source headers follow as X-Source lines."""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Refers-To: {row['refers_to']}", f"WARC-Target-URI: {row['target_uri']}", f"WARC-Date: {row['date']}"]
    lines += [f"WARC-Block-Digest: {row['block_digest']}", f"Content-Type: {row['content_type']}", f"Content-Length: {row['content_length']}"]
    lines += [f"X-Source-{k}: {v}" for k, v in sorted(row["source_headers"].items())]
    clean = [line.replace("\r", " ").replace("\n", " ") for line in lines]
    return "\r\n".join(clean).encode() + b"\r\n\r\n" + row["content"].encode() + b"\r\n\r\n"
