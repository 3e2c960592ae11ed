"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives one ``metadata`` record (application/warc-fields: title, charset, HTTP
status, source headers and digests, outlinks) and one ``conversion`` record (text/plain).
Both refer to the response by WARC-Refers-To and keep its target URI, date and digests.
Rows are independent; nothing is shuffled.

Defined results: identifiers follow from the source record's identifier, so reruns agree and
repeated rows give repeated records; a null block counts as an empty one (status 0, no title,
empty text); a null URI or date stays null and its header is left out; blocks are whole, and any page takes time linear
in its length; where a payload's coding breaks off, or it is larger than ``MAX_PAYLOAD`` decoded, the metadata record says so under
``decoding-error`` and the text is empty; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
#: Elements that start a new line of text.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text.
SILENT = frozenset("script style template noscript svg title".split())
#: Largest payload after its content coding is undone.
MAX_PAYLOAD = 1 << 28
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
#: A tag without < or > in its quotes, found in one step; other tags take ``Marks.tag``.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>"']*(?:"[^"<>]*"[^<>"']*|'[^'<>]*'[^<>"']*)*)>""")
_HREF = re.compile(r"""\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in SILENT}
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NUMBER = re.compile(r"&#(?:0*(\d+)|[xX]0*([0-9a-fA-F]+));?")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(kind: str, source_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {source_id}')}>"


class Marks:
    """Where the tags of a page end, in time linear in the page: what has been searched for in vain isn't searched for again."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.open: set[int] = set()  # quotes in tags that never end
        self.unclosed: set[str] = set()
        self.searched = (0, -1)  # from where a > or quote was last looked for, and where one was found

    def tag(self, at: int) -> int:
        """The position behind the tag whose name ends at ``at``, -1 if it has no end. A > in quotes is none."""
        passed, first = [], at
        while at <= self.last:
            where = self.searched[1] if at == first and self.searched[0] <= at <= self.searched[1] else _STOP.search(self.page, at).start()
            if at == first:
                self.searched = (at, where)
            if self.page[where] == ">":
                return where + 1
            if where in self.open:
                break
            passed.append(where)
            at = self.page.find(self.page[where], where + 1) + 1
            if not at:
                break
        self.open.update(passed)
        return -1

    def close(self, name: str, at: int) -> tuple[int, int]:
        """(start, end) of the next closing tag of an element; both at the end of the page if there is none."""
        m = None if name in self.unclosed else _CLOSE[name].search(self.page, at)
        if m:
            return m.span()
        self.unclosed.add(name)
        return len(self.page), len(self.page)


def unescape(text: str) -> str:
    """html.unescape, also for character numbers of any length."""
    if "&#" in text:
        text = _NUMBER.sub(lambda m: m[0] if len(m[1] or m[2]) < 9 else "\ufffd", text)
    return html.unescape(text) if "&" in text else text


def first_href(page: str, at: int, end: int) -> str | None:
    """The target of the link whose attributes stand from ``at`` to ``end``."""
    m = _HREF.match(page, at, end)
    if not m:
        m = next((a for a in _ATTRIBUTE.finditer(page, at, end) if a[1].lower() == "href"), None)
        return (m[2] or m[3] or m[4] or "") if m and m.lastindex > 1 else None
    return m[1] or m[2] or m[3] or ""


def read_html(page: str) -> tuple[str, str | None, list[str]]:
    """(visible text with a line per block element, first title, targets of links); no script, style, comment or title in the text."""
    page = page.replace("\n", " ")
    marks, text, title, links, at, done = None, [], None, [], 0, 0
    n, find, plain, put = len(page), page.find, _PLAIN.match, text.append
    while (at := find("<", at)) >= 0:
        m = plain(page, at)
        if m:
            end, slash, after, raw = m.end(), m[1], m.end(2), m[2]
        else:
            marks = marks or Marks(page)
            if page.startswith("<!--", at):
                end = find("-->", at + 4)
                put(page[done:at])
                at = done = end + 3 if end >= 0 else n
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                end = find(">", at) if at < marks.last else -1
                if end >= 0:
                    put(page[done:at])
                    at = done = end + 1
                else:
                    at += 1
                continue
            m = _NAME.match(page, at + 1)
            if not m:
                at += 1
                continue
            end, slash, after, raw = -1, m[1], m.end(), m[2]
        name = raw.lower()
        if name in SILENT and not slash and not (page[after : after + 1].isalnum() or page[after : after + 1] == "_"):
            marks = marks or Marks(page)
            stop = find(">", after) if at < marks.last else -1
            if stop >= 0:
                start, over = marks.close(name, stop + 1)
                if name == "title" and title is None and over > start:
                    title = page[stop + 1 : start]
                put(page[done:at])
                at = done = over
                continue
        if end < 0:
            end = marks.tag(after)
            if end < 0:
                at += 1
                continue
        put(page[done:at])
        if name in BLOCKS:
            put("\n")
        elif name == "a" and not slash:
            link = first_href(page, after, end - 1)
            if link is not None:
                links.append(unescape(link))
        at = done = end
    put(page[done:])
    return _LINES.sub("\n", _BLANK.sub(" ", unescape("".join(text)))).strip(), None if title is None else " ".join(unescape(title).split()), links


def html_text(page: str) -> str:
    return read_html(page)[0]


def split_http(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """(status, headers, payload as sent) of an HTTP response message."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    first = re.match(r"HTTP/\S+ (\d{3})", lines[0])
    if not first:
        return 0, [], block
    pairs = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()]
    return int(first[1]), pairs, payload


def dechunked(payload: bytes) -> bytes:
    """The body of a chunked transfer, read by position; ValueError where it breaks off or a size isn't one."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at, at + 4096)
        if end < 0:
            raise ValueError("chunks break off")
        n = int(payload[at:end].split(b";")[0], 16)
        if n <= 0:
            return b"".join(out)
        at = end + 2 + n + 2
        if n > len(payload) - end - 2:
            raise ValueError("chunks break off")
        out.append(payload[end + 2 : end + 2 + n])


def inflated(payload: bytes, wbits: int) -> bytes:
    """All members of a compressed body, decoded in pieces; what follows the last one is left out. ValueError if it breaks off or is too large."""
    out, held, rest = [], 0, payload
    while rest:
        coded = zlib.decompressobj(wbits)
        try:
            plain = coded.decompress(rest, MAX_PAYLOAD - held + 1)
        except zlib.error:
            if not out:
                raise
            break  # padding after a member
        held += len(plain)
        out.append(plain)
        if held > MAX_PAYLOAD:
            raise ValueError(f"more than {MAX_PAYLOAD} bytes")
        if not coded.eof:
            raise ValueError("cut off")
        rest = coded.unused_data if wbits == 47 else b""
    return b"".join(out)


def decode_body(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """(body without its transfer and content coding, what was wrong with these). A body that never had the coding its header names is
    left as it is; one that breaks off within it, or is larger than MAX_PAYLOAD decoded, is empty."""
    h = {k.lower(): v.lower() for k, v in headers}
    problem = None
    if h.get("transfer-encoding", "") == "chunked":
        try:
            payload = dechunked(payload)
        except ValueError as e:
            problem = f"transfer-encoding: {e}"
    coding = h.get("content-encoding", "")
    if coding not in ("gzip", "x-gzip", "deflate") or not payload:
        return payload, problem
    for wbits in (47,) if coding != "deflate" else (15, -15):
        try:
            return inflated(payload, wbits), problem
        except zlib.error:
            continue
        except ValueError as e:
            return b"", f"content-encoding: {e}"
    return payload, "content-encoding: not the coding that the header names"


def decode_text(headers: list[tuple[str, str]], body: bytes) -> tuple[str, str]:
    """(text, charset). Undecodable bytes become replacement characters; a charset that Python has no text decoder for counts as UTF-8."""
    kind = next((v for k, v in reversed(headers) if k.lower() == "content-type"), "")
    found = _CHARSET.search(kind.encode("latin-1", "replace")) or _CHARSET.search(body[:2048])
    name = found[1].decode().lower() if found else "utf-8"
    try:
        return body.decode(name, "replace"), name
    except (LookupError, ValueError):  # unknown, or a codec that refuses whole texts
        return body.decode("utf-8", "replace"), "utf-8"


def decode_payload(headers: list[tuple[str, str]], payload: bytes) -> tuple[str, str]:
    return decode_text(headers, decode_body(headers, payload)[0])


def derive(record_id: str, uri: str | None, date: str | None, block: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block = block or b""
    status, headers, payload = split_http(block)
    body, problem = decode_body(headers, payload)
    page, charset = decode_text(headers, body)
    text, title, links = read_html(page)
    source = [("source-block-digest", digest(block)), ("source-payload-digest", digest(payload)), ("http-status", str(status))]
    fields = [*source, *((f"source-header-{k.lower()}", v) for k, v in headers), ("charset", charset)]
    if problem:
        fields.append(("decoding-error", problem))
    if title is not None:
        fields.append(("title", title))
    for link in links:
        try:
            fields.append(("outlink", " ".join(urljoin(uri or "", link).split())))
        except ValueError:
            fields.append(("outlink", " ".join(link.split())))
    made = [
        ("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ]
    out = []
    for kind, content, body in made:
        own, body_digest = derived_id(kind, record_id), digest(body)
        pairs = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        pairs += [("WARC-Block-Digest", body_digest), ("WARC-Source-Payload-Digest", source[1][1]), ("Content-Type", content), ("Content-Length", str(len(body)))]
        out.append({"record_type": kind, "record_id": own, "refers_to": record_id, "target_uri": uri, "date": date, "content_type": content, "block_digest": body_digest, "source_block_digest": source[0][1], "source_payload_digest": source[1][1], "headers": json.dumps([p for p in pairs if p[1] is not None]), "block": body})
    return out


RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_block_digest string, source_payload_digest string, headers string, block binary"
_KINDS = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.string()) for c in RECORD.split(", ")])


def derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """responses: key, record_id, target_uri, date, block (HTTP message). Two records a row, with the key."""
    kind = responses.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [r for x in part.select(["record_id", "target_uri", "date", "block"]).to_pylist() for r in derive(x["record_id"], x["target_uri"], x["date"], x["block"])]
                keys = part.column("_key").take(pa.array([i // 2 for i in range(len(rows))], pa.int64()))
                made = pa.RecordBatch.from_pylist(rows, schema=_KINDS)
                yield pa.RecordBatch.from_arrays([keys, *made.columns], names=[key, *_KINDS.names])

    cols = [F.col(key).alias("_key"), "record_id", "target_uri", "date", "block"]
    return responses.select(*cols).mapInArrow(run, f"`{key}` {kind}, {RECORD}")


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html): an HTTP message around each page."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digits = F.md5(F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit(""))))
    number = F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(digits, i, n), F.lit("-" if i < 21 else ">"))])
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", number.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def record_bytes(headers: str, block: bytes) -> bytes:
    """A WARC/1.1 record as it stands in a file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in json.loads(headers))
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def members(records: DataFrame) -> DataFrame:
    """Adds member: the record as a gzip member. Members put one after another are a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [gzip.compress(record_bytes(h, b), mtime=0) for h, b in zip(part.column("headers").to_pylist(), part.column("block").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "member"])

    records = records.drop("member")
    return records.mapInArrow(run, StructType([*records.schema.fields, StructField("member", BinaryType())]))


def parse_warc(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a WARC file, compressed or not."""
    f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        pairs = []
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            pairs.append((k.strip(), v.strip()))
        yield pairs, f.read(int(dict((k.lower(), v) for k, v in pairs).get("content-length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_type, record_id, target_uri, date, headers (JSON), block. A file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "record_id", "target_uri", "date", "headers", "block"]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for pairs, block in parse_warc(content.as_py()):
                    h = {k.lower(): v for k, v in pairs}
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), json.dumps(pairs), block))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 5 else pa.string()) for i in range(6)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_type string, record_id string, target_uri string, date string, headers string, block binary")
