"""WARC derivatives: linked metadata and plain-text conversion records from response records.

Every response gives one metadata record (application/warc-fields: the source's HTTP headers, title, language and
links) and one conversion record (text/plain). Both keep the response's URI and date, point to its record id in
WARC-Refers-To, and carry the digests of their own block and of the response's payload. Record ids are derived from
the response's id, so a task that runs again makes the same records. Rows are worked on one by one, without a shuffle.

Plain text is made by one linear pass over the markup: comments, scripts, styles and the like go; block elements end
a line; character references are decoded; white space is collapsed and empty lines are dropped. Text after an
unclosed comment or script belongs to it.

Defined cases: a null or empty block gives records with empty payloads; a block without an HTTP header is all payload;
unknown character sets are read as UTF-8, with U+FFFD for what cannot be decoded; a payload whose transfer or
content coding is broken is read as it is; a payload that is neither HTML nor text has an empty conversion; a null
URI is left out; repeated responses give repeated records with the same ids; pages and tags of any length are read whole; an
empty table gives an empty table; columns other than those named are ignored, so their names cannot clash.
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
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs

RECORD = T.StructType(
    [
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("source_payload_digest", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)

_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select"}
_NESTED = {"svg", "template"}
_NEVER_EMPTY = {"script", "style", "iframe", "textarea"}  # a slash before the > does not close these
_BREAKS = set(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/<>]*)|[!?/])")
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LANG = re.compile(r"""\slang\s*=\s*["']?([a-zA-Z0-9-]+)""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)
#: What is left of a tag: a > inside a quoted value does not end it. A quote that never closes is a character like others;
#: only the last quote of a page can be one, so all tags together take time in proportion to the page.
_REST = re.compile(r"""(?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+')?+)*+>""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    ends = [(i, n) for i, n in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if i >= 0]
    if not ends:
        return "", [], block
    end, skip = min(ends)
    lines = block[:end].decode("latin-1").replace("\r\n", "\n").split("\n")
    headers = []
    for line in lines[1:]:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, block[end + skip :]


def _unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if line + 2 + size > len(body):
            raise ValueError("chunk past the end")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def decoded_body(headers: list[tuple[str, str]], body: bytes) -> bytes:
    of = {k.lower(): v.lower() for k, v in headers}
    try:
        if "chunked" in of.get("transfer-encoding", ""):
            body = _unchunk(body)
        coding = of.get("content-encoding", "")
        if "gzip" in coding:
            return gzip.decompress(body)
        return zlib.decompress(body) if "deflate" in coding else body
    except (ValueError, OSError, EOFError, zlib.error):
        return body


def payload_text(headers: list[tuple[str, str]], body: bytes) -> tuple[str, bool]:
    """The text of a payload and whether it is HTML."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "text/html")
    named = _CHARSET.search(kind) or _CHARSET.search(body[:1024].decode("latin-1"))
    try:
        text = body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, ValueError):
        text = body.decode("utf-8", "replace")
    is_html = "html" in kind.lower() or "xml" in kind.lower()
    return (text if is_html or kind.lower().startswith("text/") else ""), is_html


def extract(markup: str, base: str = "") -> tuple[str, str, str, list[str]]:
    """(plain text, title, language, links) of HTML."""
    parts, title, lang, links = [], [], "", []
    at, in_title = 0, False
    while True:
        tag = _TAG.search(markup, at)
        text = markup[at : tag.start() if tag else len(markup)]
        if text:
            parts.append(text)
            if in_title:
                title.append(text)
        if not tag:
            break
        if tag[1]:
            end = markup.find("-->", tag.end())
            at = end + 3 if end >= 0 else len(markup)
            continue
        name = (tag[3] or "").lower()
        end = _tag_end(markup, tag.end())
        attributes = markup[tag.end() : end]
        if not tag[2] and name in _RAW and (name in _NEVER_EMPTY or not _closes_itself(attributes)):
            at = _raw_end(markup, end, name)
        else:
            at = end
        if name == "title":
            in_title = not tag[2]
        elif name == "a" and not tag[2] and (href := _HREF.search(attributes)):
            links.append(html.unescape(href[1] or href[2] or href[3] or ""))
        elif name == "html" and not lang and (found := _LANG.search(attributes)):
            lang = found[1]
        if name in _BREAKS:
            parts.append("\n")
    joined = html.unescape("".join(x if x == "\n" else x.replace("\n", " ") for x in parts))
    lines = [" ".join(x.split()) for x in joined.split("\n")]
    text = "\n".join(x for x in lines if x)
    return text, " ".join(html.unescape("".join(title)).split()), lang, [_resolved(base, x) for x in links]


def _tag_end(markup: str, at: int) -> int:
    """Behind the tag's >, which may stand inside quotes before that."""
    whole = _REST.match(markup, at)
    return whole.end() if whole else len(markup)


def _closes_itself(attributes: str) -> bool:
    """Whether a tag, from behind its name, ends in /> and the slash is not part of an unquoted value."""
    if not attributes.endswith("/>"):
        return False
    last = attributes[:-2].split()[-1:] if not attributes[:-2][-1:].isspace() else []
    return not last or "=" not in last[0] or last[0][-1] in "\"'"


def _raw_end(markup: str, at: int, name: str) -> int:
    if name not in _NESTED:
        close = re.compile(f"</{name}[^>]*>", re.I).search(markup, at)
        return close.end() if close else len(markup)
    tags, depth = re.compile(rf"<(/?){name}(?=[\s/>])", re.I), 1
    while depth:
        tag = tags.search(markup, at)
        if not tag:
            return len(markup)
        at = _tag_end(markup, tag.end())
        if tag[1]:
            depth -= 1
        elif not _closes_itself(markup[tag.end() : at]):
            depth += 1
    return at


def _resolved(base: str, link: str) -> str:
    try:
        return urljoin(base, link.strip())
    except ValueError:
        return link.strip()


def _field(value: str) -> str:
    return " ".join(value.split())


def derive_one(rec_id: str, uri: str | None, date: str | None, block: bytes | None) -> list[tuple]:
    """The two records made from a response, as RECORD rows."""
    status, headers, body = split_http(block or b"")
    payload = decoded_body(headers, body)
    source_digest = digest(body)
    text, is_html = payload_text(headers, payload)
    title, lang, links = "", "", []
    if is_html:
        text, title, lang, links = extract(text, uri or "")
    fields = [("http-status", status)] if status else []
    fields += [(f"http-header-{k}", v) for k, v in headers]
    fields += [("title", title)] if title else []
    fields += [("languages-html", lang)] if lang else []
    fields += [("outlink", x) for x in links]
    told = "".join(f"{_field(k)}: {_field(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for kind, mime, made in (("metadata", "application/warc-fields", told), ("conversion", "text/plain", text.encode("utf-8", "replace"))):
        out.append((kind, record_id(rec_id, kind), rec_id, uri, date, mime, digest(made), source_digest, len(made), made))
    return out


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(source_id, record_id, target_uri, date, block): pages as HTTP response records."""
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    key = F.sha2(F.concat_ws("\u0000", F.col(f"`{id_col}`").cast("string"), F.col(f"`{url_col}`"), F.sha2(body, 256)), 256)
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col(f"`{id_col}`").alias("source_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(f"`{url_col}`").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head, body).cast("binary").alias("block"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """(source_id, RECORD...) of responses (source_id, record_id, target_uri, date, block)."""
    source = responses.select("source_id", "record_id", "target_uri", "date", "block")
    schema = T.StructType([source.schema["source_id"], *RECORD.fields])
    kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                given = [part.column(i).to_pylist() for i in range(1, 5)]
                rows = [r for one in zip(*given) for r in derive_one(one[0] or "", *one[1:])]
                ids = part.column(0).take(pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int64()))
                made = [pa.array([r[j] for r in rows], kinds[j]) for j in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([ids, *made], names=schema.names)

    return source.mapInArrow(run, schema)


def serialize(row) -> bytes:
    """A record as it stands in a WARC file."""
    named = [
        ("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Block-Digest", row["block_digest"]),
        ("WARC-Source-Payload-Digest", row["source_payload_digest"]), ("Content-Type", row["content_type"]),
        ("Content-Length", str(len(row["block"]))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_field(v)}\r\n" for k, v in named if v is not None)
    return head.encode("utf-8") + b"\r\n" + bytes(row["block"]) + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8").split("\r\n")[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
