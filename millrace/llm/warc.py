"""Operator 10: WARC derivatives. Responses become linked metadata and plain-text conversion records.

A response is an HTTP message in a WARC record. For each, a ``conversion`` record holds its text and a ``metadata``
record its language, title and links; both name it in ``WARC-Refers-To`` and carry its target, date and payload
digest, and metadata repeats the headers of the source. Pages are written as response records first; these files are
read, and their derivatives written beside them. Records are written as WARC/1.1 by Spark's own text writer, whose line
separator is the two line ends after a record, compressed by gzip, and are read back by content length alone. Files
are cut by bytes: a row of the writer holds records of ``CHUNK`` bytes (or one larger record), and a file
``PER_FILE`` rows. Markup is scanned once from front to end, so that no page costs more than its length.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, pieces, table_path

#: A reader holds one file at a time: PER_FILE rows of CHUNK bytes, a row being larger only by its last record.
CHUNK, PER_FILE = 4 << 20, 12
OPTIONS = {"lineSep": "\r\n\r\n", "maxRecordsPerFile": PER_FILE, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_HIDDEN = {b"script", b"style", b"noscript", b"template", b"head", b"title"}
_BREAKS = set(b"p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav footer header main blockquote pre".split())
_NAME = re.compile(rb"</?([a-zA-Z][a-zA-Z0-9]*)")
_LANG = re.compile(rb"\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(rb"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: object) -> str:
    """The same for the same source, so that a task that runs twice writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, kind + '|' + '|'.join(map(str, parts)))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


class Markup:
    """What one forward scan over a page finds: text, title, language and links.

    Comments, and elements in ``_HIDDEN``, give no text; only in the head tags count all the same. An element or a
    comment that is never closed hides nothing, its tag alone goes. A "<" that no letter, "/", "!" or "?" follows, or
    without a ">" after it, is text.
    """

    def __init__(self, payload: bytes):
        self.pieces: list[bytes] = []
        self.links: list[str] = []
        self.title: str | None = None
        self.language: str | None = None
        self.payload, self.low = payload, payload.lower()  # bytes: A-Z only, so places stay
        self.nowhere: dict[bytes, bool] = {}  # what no longer comes
        self._scan()

    def _find(self, what: bytes, at: int) -> int:
        if self.nowhere.get(what):
            return -1
        found = self.low.find(what, at)
        self.nowhere[what] = found < 0
        return found

    def _closing(self, name: bytes, at: int) -> tuple[int, int]:
        """Where the end tag ``name`` begins and ends after ``at``; (-1, -1) if nowhere."""
        begin = self._find(b"</" + name, at)
        end = self._find(b">", begin) if begin >= 0 else -1
        return (begin, end + 1) if end >= 0 else (-1, -1)

    def _scan(self) -> None:
        payload, at, head_end = self.payload, 0, 0
        while True:
            tag = payload.find(b"<", at)
            text = payload[at : tag if tag >= 0 else len(payload)]
            if text and at >= head_end:
                self.pieces.append(text)
            if tag < 0:
                return
            if payload.startswith(b"<!--", tag) and (end := self._find(b"-->", tag + 4)) >= 0:
                at = end + 3
                continue
            end = self._find(b">", tag)
            if end < 0 or not (payload[tag + 1 : tag + 2].isalpha() or payload[tag + 1 : tag + 2] in (b"/", b"!", b"?")):
                self._part(b"<", tag, head_end)
                at = tag + 1
                continue
            at = end + 1
            named = _NAME.match(payload, tag, end)
            if not named:
                continue
            name, opens = named[1].lower(), payload[tag + 1 : tag + 2] != b"/"
            if opens and name in _HIDDEN:
                begin, after = self._closing(name, at)
                if begin >= 0:
                    if name == b"title" and self.title is None:
                        self.title = " ".join(html.unescape(payload[at:begin].decode("utf-8", "replace")).split())
                    if name == b"head":
                        head_end = max(head_end, after)
                    else:
                        at = after
            elif name in _BREAKS:
                self._part(b"\n", tag, head_end)
            elif opens and name == b"a" and (found := _HREF.search(payload, tag, end)):
                self.links.append(re.sub(r"[\r\n]", "", html.unescape((found[1] or found[2] or found[3] or b"").decode("utf-8", "replace"))))
            elif opens and name == b"html" and self.language is None and (found := _LANG.search(payload, tag, end)):
                self.language = found[1].decode().lower()

    def _part(self, piece: bytes, at: int, head_end: int) -> None:
        if at >= head_end:
            self.pieces.append(piece)

    def text(self) -> str:
        """Visible text with a line for each block."""
        text = html.unescape(b"".join(self.pieces).decode("utf-8", "replace"))
        lines = (_BLANKS.sub(" ", x).strip() for x in text.split("\n"))
        return "\n".join(x for x in lines if x)


def plain_text(markup: str) -> str:
    return Markup(markup.encode("utf-8", "replace")).text()


def response(page_id: int | None, url: str | None, markup: str | None, date: str) -> tuple[list[tuple[str, str]], bytes]:
    """The response record of a page: headers and HTTP message. The test table has pages only, no HTTP."""
    payload = (markup or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    target = re.sub(r"[\r\n]", "", url or "")
    named = [("WARC-Target-URI", target)] if target else []
    return [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(payload))), ("WARC-Date", date), *named, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http;msgtype=response")], block


def derivatives(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and conversion records of a response record."""
    source = dict(headers)
    head, _, payload = block.partition(b"\r\n\r\n")
    page = Markup(payload)
    link = [("WARC-Refers-To", source["WARC-Record-ID"])]
    if "WARC-Target-URI" in source:
        link += [("WARC-Refers-To-Target-URI", source["WARC-Target-URI"]), ("WARC-Target-URI", source["WARC-Target-URI"])]
    link += [("WARC-Refers-To-Date", source["WARC-Date"]), ("WARC-Date", source["WARC-Date"])]
    text = page.text().encode("utf-8", "replace")
    fields = [f"source-{line}" for line in head.decode("latin-1").split("\r\n")[1:]]
    fields += [f"source-payload-digest: {source['WARC-Payload-Digest']}", f"source-block-digest: {source['WARC-Block-Digest']}"]
    fields += [f"language: {page.language}"] if page.language else []
    fields += [f"title: {page.title}"] if page.title else []
    fields += [f"outlink: {x}" for x in page.links]
    facts = ("\r\n".join(fields) + "\r\n").encode("utf-8", "replace")
    out = []
    for kind, body, mime in (("metadata", facts, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        ident = record_id(kind, source["WARC-Record-ID"])
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", ident), *link, ("WARC-Source-Payload-Digest", source["WARC-Payload-Digest"]), ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)], body))
    return out


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and markup_language of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                found = []
                for x in part.column(2):
                    m = Markup((x.as_py() or "").encode("utf-8", "replace"))
                    found.append((m.text(), m.language))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.string()) for x in zip(*found, strict=True))], ["page_id", "url", "text", "markup_language"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, markup_language string")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file, by their content lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def unzipped(data: bytes) -> bytes:
    """The whole of a gzip file, of one member or several."""
    out = []
    while data:
        stream = zlib.decompressobj(31)
        out += [stream.decompress(data), stream.flush()]
        data = stream.unused_data
    return b"".join(out)


def chunks(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records as rows of the text writer, ``CHUNK`` bytes together."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held).decode()], pa.string())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held).decode()], pa.string())], ["value"])


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_responses(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as response records in WARC files under ``path``.

    Null html is an empty page, a null url leaves out the target. Equal rows have equal record ids. Other columns
    are ignored; an empty table gives no records.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                yield record(*response(*(x.as_py() for x in row), date))

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    slim.mapInArrow(lambda batches: chunks(made(batches)), "value string").write.options(**OPTIONS).text(path)


def write_derivatives(spark: SparkSession, source: str, path: str) -> None:
    """Write the metadata and conversion records of the response records in the files under ``source`` as WARC files
    under ``path``. Records of other types are passed over."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse(unzipped(content.as_py())):
                    if headers.get("WARC-Type") == "response":
                        yield from (record(*r) for r in derivatives(list(headers.items()), block))

    files(spark, source).mapInArrow(lambda batches: chunks(made(batches)), "value string").write.options(**OPTIONS).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, refers_to, target_uri, date, source_digest, block_digest, digest_ok, length, block) of each
    record in the WARC files under ``path``."""
    names = {"WARC-Type": "type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Source-Payload-Digest": "source_digest", "WARC-Block-Digest": "block_digest"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for headers, block in parse(unzipped(batch.column(0)[k].as_py())):
                    rows.append((*(headers.get(n) for n in names), headers.get("WARC-Block-Digest") == digest(block), len(block), block))
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * len(names), pa.bool_(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*names.values(), "digest_ok", "length", "block"])

    schema = ", ".join(f"{n} string" for n in names.values()) + ", digest_ok boolean, length long, block binary"
    return files(spark, path).mapInArrow(run, schema)


def derive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as responses to the shared folder, and from these files their derivatives, and read them back:
    a row for each record with its length in bytes, checked digest, and for conversions the number of characters and
    words of the text. The responses' files go once their derivatives are written."""
    spark = pages.sparkSession
    source, path = (table_path(spark, tag) + ".warc" for tag in ("responses", "derivatives"))
    write_responses(pages, source)
    write_derivatives(spark, source, path)
    delete_path(spark, source)
    text = F.when(F.col("type") == "conversion", F.decode("block", "UTF-8"))
    found = read_records(spark, path)
    return found.select("type", "record_id", "refers_to", "target_uri", "date", "source_digest", "block_digest", "digest_ok", "length", F.length(text).cast("long").alias("n_chars"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
