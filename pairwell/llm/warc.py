"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writing: each page is a record in a gzip member of its own, committed by
Spark's text writer, whose line separator supplies the zero byte that ends a
member (the top byte of its size; a member of 16 MiB or more gets the byte as
padding, which gzip readers skip). Of equal payloads the page with the
smallest id is the response, the others are revisits of it; equality is
decided on narrow rows (id and SHA-1), pre-aggregated per digest.

Reading: files are taken as they come, gzip members or plain records. A
member or record that fails a check (gzip CRC, version line, header, length,
closing line ends, payload digest) is given up; the reader searches for the
next place where a whole member or a version line stands, goes on there and
logs the bytes between as a gap. A member of several records that breaks gives
those before the break whose payloads match their digests, and a whole member
with a damaged record gives the others; the member's range is then logged as a
gap too.

Defined cases: null html is an empty payload; a null url is left out and line
ends in one are percent-encoded; rows without an id revisit the smallest id
with their payload, and are responses if there is none; a repeated row is
written again with the same type; an empty table gives no files and no rows;
extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, fresh_path, read_table, record_batch, text_batches, utf8

RECORDS_PER_FILE = 8192
LEVEL = 4
#: How much of a file is fed to the inflater at once.
CHUNK = 16 << 10
#: The same in a damaged member, of which at most as much is lost before the break.
FINE = 32
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    block = (HTTP % len(payload)).encode() + (b"" if revisits else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisits:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without the zero byte that the separator adds."""
    squeeze = zlib.compressobj(LEVEL, wbits=31)
    packed = squeeze.compress(data) + squeeze.flush()
    return packed[:-1] if packed[-1] == 0 else packed


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and digest of the pages that revisit another, and which."""
    narrow = pages.select(F.col(id_col).cast("long").alias("revisitor"), F.sha1(utf8(html_col)).alias("same"))
    first = narrow.groupBy("same").agg(F.min("revisitor").alias("refers_to"))
    return narrow.join(first, "same").filter(~F.col("revisitor").eqNullSafe(F.col("refers_to"))).distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives all pages."""
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(html_col).alias("payload")
    )
    same = F.col("page_id").eqNullSafe(F.col("revisitor")) & (F.sha1("payload") == F.col("same"))
    typed = source.join(roles(pages, id_col, html_col), same, "left").select(
        "page_id", "url", "payload", F.col("same").isNotNull().alias("revisits"), "refers_to"
    )
    out = ddl_schema("value binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "payload"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisits", "refers_to")))
            yield record_batch([[member(record(*r)) for r in rows]], out)

    lines = typed.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Damaged(Exception):
    """A check failed."""


_VERSION = re.compile(rb"WARC/\d\.\d{1,2}\r?\n")
_LENGTH = re.compile(rb"\d{1,18}")


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict, bytes, int]:
    """Headers (lower-case names), block and end of the record that begins at `at`; Damaged if a check fails."""
    if not _VERSION.match(data, at):
        raise Damaged("version line")
    edge = data.find(b"\r\n\r\n", at)
    if edge < 0:
        raise Damaged("header end")
    headers = {}
    for line in bytes(data[at:edge]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip()
    length = headers.get("content-length", b"")
    if not _LENGTH.fullmatch(length):
        raise Damaged("content length")
    begin = edge + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = bytes(data[begin:end])
    claimed = headers.get("warc-payload-digest", b"")
    if headers.get("warc-type") == b"response" and claimed.startswith(b"sha1:"):
        if payload_digest(_payload(block)) != claimed[5:].decode("latin-1"):
            raise Damaged("payload digest")
    return headers, block, end + 4


def _payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    return body if gap and head.startswith(b"HTTP/") else block


def _pour(data: bytes, at: int, step: int) -> tuple[bytes, int | None, str]:
    pour, parts = zlib.decompressobj(31), []
    while not pour.eof:
        some = data[at : at + step]
        if not some:
            return b"".join(parts), None, "member end"
        try:
            parts.append(pour.decompress(some))
        except zlib.error:
            return b"".join(parts), None, "member data"
        at += len(some)
    return b"".join(parts), at - len(pour.unused_data), ""


def inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """Content and end of the gzip member at `at`; of a damaged one what comes before the break, no end, and why."""
    content, end, why = _pour(data, at, CHUNK)
    return (_pour(data, at, FINE)[0], None, why) if end is None else (content, end, "")


def _proved(headers: dict) -> bool:
    """Whether parse_record has held the payload against a digest."""
    return headers.get("warc-type") == b"response" and headers.get("warc-payload-digest", b"").startswith(b"sha1:")


def _inside(content: bytes) -> tuple[list[tuple[dict, bytes]], str]:
    """The whole records of a member's content, found again at version lines after a damaged one, and the first damage."""
    records, at, why = [], 0, ""
    while at < len(content):
        try:
            headers, block, at = parse_record(content, at)
            records.append((headers, block))
        except Damaged as e:
            why = why or str(e)
            found = _LINE.search(content, at + 1)
            at = found.start() if found else len(content)
    return records, why


def _at(data: bytes, at: int) -> tuple[list[tuple[dict, bytes]], int | None, str]:
    """The records of the member at `at`, or the plain record there; their end, None after a break; and what is damaged.

    Of a member that does not inflate whole, the records before the break count whose payloads have their
    digests; of one with wrong bytes, only if there are two or more: a header has no digest, so one of them may be wrong in it.
    """
    if data.startswith(b"\x1f\x8b", at):
        content, end, why = inflate(data, at)
        records, flaw = _inside(content)
        if end is None:
            records = [r for r in records if _proved(r[0])]
            if why != "member end" and len(records) < 2:
                records = []  # the damage may lie in the header of the one record
        if not records:
            raise Damaged(why or flaw or "empty member")
        return records, end, why or flaw
    headers, block, end = parse_record(data, at)
    return [(headers, block)], end, ""


_LINE = re.compile(rb"(?<=\n)WARC/\d")
_NEXT = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|(?<=\x00))WARC/\d")
_PADDING = re.compile(rb"[\0\r\n]*")


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', offset, end, headers, block) and ('gap', offset, end, reason) in file order.

    Zero bytes and line ends between records are padding, not gaps.
    """
    at, lost, reason = 0, None, ""
    while True:
        if lost is None:
            at = _PADDING.match(data, at).end()
        if at >= len(data):
            break
        try:
            records, end, flaw = _at(data, at)
        except Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if lost is not None:
            yield "gap", lost, at, reason
            lost = None
        for headers, block in records:
            yield "record", at, at if end is None else end, headers, block
        if end is None:  # the rest of the member is sought through like any other damage
            lost, reason = at, flaw
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if flaw:
            yield "gap", at, end, flaw
        at = end
    if lost is not None:
        yield "gap", lost, len(data), reason


READ = (
    "kind string, file string, byte_from long, byte_to long, reason string, page_id long, url string, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string"
)
_LENGTH_LINE = re.compile(rb"(?i)^content-length:\s*(\d+)\s*$", re.M)


def _page(urn: bytes) -> int | None:
    tail = urn.rstrip(b">").rpartition(b":")[2]
    return int(tail) if re.fullmatch(rb"-?\d+", tail) else None


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


def _row(file: str, found: tuple, with_payload: bool) -> tuple:
    kind, begin, end = found[:3]
    if kind == "gap":
        return (kind, file, begin, end, found[3], None, None, None, None, None, None, None)
    headers, block = found[3:]
    type_ = _text(headers.get("warc-type"))
    payload = _payload(block)
    if type_ == "revisit":
        size = _LENGTH_LINE.search(block.partition(b"\r\n\r\n")[0])
        size, claimed = int(size[1]) if size else None, headers.get("warc-payload-digest", b"")
        digest, payload = _text(claimed.partition(b":")[2]), None
    else:
        size, digest = len(payload), payload_digest(payload)
    refers = headers.get("warc-refers-to")
    return (
        kind, file, begin, end, None, _page(headers.get("warc-record-id", b"")), _text(headers.get("warc-target-uri")),
        type_, _page(refers) if refers else None, size, digest, payload,
    )


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record and per gap of all files below `path`; with_payload adds the payloads of responses."""
    ddl = READ + (", payload binary" if with_payload else "")
    out = ddl_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for found in salvage(content.as_py()):
                    rows.append(_row(file, found, with_payload)[: len(out)])
                    if len(rows) >= 1000:
                        yield record_batch(list(zip(*rows)), out)
                        rows = []
                if rows:
                    yield record_batch(list(zip(*rows)), out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


def gap_log(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'gap'").select("file", "byte_from", "byte_to", "reason")


def op2_salvage_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages into archives, and the archives read back."""
    path = fresh_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return (
        read_warc(spark, path)
        .filter("kind = 'record'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
