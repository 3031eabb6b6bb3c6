"""Secret scans: a worklist of decoded layers, each scanned again, spans mapped back to the text.

The whole text is the first layer. A layer gives new ones: its percent escapes
undone, its Unicode escapes undone, each base64 run decoded (at all four
alignments), each compressed stream in it unpacked. New layers go on the
worklist until none is new; a layer is known by its content and its place in
the text, so a stream that unpacks to itself ends there. Every layer carries
the place of each of its characters in the text: a base64 byte comes from two
characters, an escape from the whole escape, unpacked text from its stream.

Defined cases: a null text is the empty text; rows without an id are scanned
like others; equal texts have equal results, repeated rows stay repeated; very
long texts are scanned whole, one row at a time; ties (a span found in two
layers) count once; an empty table gives no rows; extra columns are not read.
A text whose layers together pass BUDGET characters (a decompression bomb)
keeps what is found so far and counts the layers left unopened in `unopened`.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, read_table, record_batch, text_batches

#: The kinds in their order, and what counts as a secret of each.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Characters that the layers of one text may hold together, beside BUDGET_X times the text itself.
BUDGET, BUDGET_X = 64 << 20, 64

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
#: The shortest secret has 14 bytes, 19 base64 characters; lines of encoded mail belong together.
LEAST_RUN = 19
RUN = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]{19,}")
BREAK = re.compile(r"[\r\n]")
PLAIN = str.maketrans("-_", "+/")
STREAM = re.compile(r"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
MAGICS = ("\x1f\x8b", "x\x01", "x^", "x\x9c", "x\xda", "BZh", "\xfd7z", "(\xb5/")
NOT_BYTE = re.compile(r"[^\x00-\xff]")


def _marks(pattern: str) -> bytes:
    """A translation of bytes to 1 where the class matches and to 0 elsewhere."""
    return bytes(int(b < 128 and re.match(pattern, chr(b)) is not None) for b in range(256))


HEX_MARKS, RUN_MARKS = _marks(r"[0-9a-f]"), _marks(r"[A-Za-z0-9+/_-]")


def _has_run(raw: bytes, marks: bytes, least: int) -> bool:
    """Whether raw has so many bytes of a class in a row."""
    return b"\1" * least in raw.translate(marks)


@dataclass
class Layer:
    """text and, for each character, where it comes from: [start, end) in the whole text, or one place for all."""

    text: str
    starts: np.ndarray | int
    ends: np.ndarray | int
    via: str = ""

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the whole text that characters [start, end) come from."""
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def part(self, starts: np.ndarray, ends: np.ndarray) -> tuple:
        """Places of characters that come from [starts, ends) of this layer."""
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[starts], self.ends[ends - 1]


def matches(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets in one text (raw: its UTF-8), leftmost and non-overlapping in each kind."""
    found = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _has_run(raw, HEX_MARKS, LEAST_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def _replaced(layer: Layer, found: list[tuple[int, int, str]], via: str) -> Layer:
    """The layer with stretches [start, end) replaced, each by one character."""
    text, pieces, firsts, lasts, at = layer.text, [], [], [], 0
    for start, end, char in found:
        pieces += (text[at:start], char)
        firsts.append(start)
        lasts.append(end)
        at = end
    pieces.append(text[at:])
    first, last = np.array(firsts), np.array(lasts)
    keep = np.ones(len(text), bool)
    # all but the first character of each stretch goes
    inside = np.zeros(len(text) + 1, np.int64)
    inside[first + 1] += 1
    inside[last] -= 1
    keep[np.cumsum(inside)[:-1] > 0] = False
    starts = np.flatnonzero(keep)
    ends = starts + 1
    ends[np.searchsorted(starts, first)] = last
    return Layer("".join(pieces), *layer.part(starts, ends), f"{layer.via}{via}/")


def _percent(layer: Layer) -> Iterator[Layer]:
    """Percent escapes as bytes; the patterns are ASCII, so bytes stand for themselves."""
    if found := [(m.start(), m.end(), chr(int(m[0][1:], 16))) for m in PERCENT.finditer(layer.text)]:
        yield _replaced(layer, found, "url")


def _code_point(m: re.Match) -> str | None:
    brace, high, low, short, long, byte, hexed, decimal = m.groups()
    if high:
        return chr(0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00)
    value = int(decimal) if decimal else int(brace or short or long or byte or hexed, 16)
    return chr(value) if value <= 0x10FFFF else None


def _unicode(layer: Layer) -> Iterator[Layer]:
    """Escapes of JSON, C and HTML as the characters they stand for; beyond Unicode they stay."""
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    if found := [(m.start(), m.end(), c) for m in ESCAPE.finditer(layer.text) if (c := _code_point(m)) is not None]:
        yield _replaced(layer, found, "unicode")


def _base64(layer: Layer) -> Iterator[Layer]:
    """Each run decoded from its first four characters on; wrapped lines are one run."""
    for m in RUN.finditer(layer.text):
        run = m[0]
        at = np.arange(m.start(), m.end())
        if BREAK.search(run):
            at = at[[c not in "\r\n" for c in run]]
            run = BREAK.sub("", run)
        run = run.translate(PLAIN)
        for shift in range(4):
            body = run[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            first = shift + np.arange(len(raw)) * 8 // 6
            last = shift + (np.arange(len(raw)) * 8 + 7) // 6
            if raw:
                yield Layer(raw.decode("latin-1"), *layer.part(at[first], at[last] + 1), f"{layer.via}base64/")


def _unpackers(head: bytes) -> object:
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78":
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor()
    return zstandard.ZstdDecompressor().decompressobj()


def _unpacked(raw: bytes, most: int) -> tuple[bytes, int, bool]:
    """What a compressed stream holds, how much of raw it takes, and whether it passes `most`; a broken one gives what precedes the break."""
    opener, out, size, at, step = _unpackers(raw[:4]), [], 0, 0, 4096
    try:
        while at < len(raw) and not getattr(opener, "eof", False):
            out.append(opener.decompress(raw[at : at + step]))
            at += step
            size += len(out[-1])
            if size > most:
                return b"", at, True
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        pass
    unused = len(getattr(opener, "unused_data", b"") or b"")
    return b"".join(out), max(0, min(at, len(raw)) - unused), False


def _compressed(layer: Layer, most: int) -> Iterator[Layer | None]:
    """Each compressed stream of the layer, unpacked; None for one that is too large."""
    at = 0
    while m := STREAM.search(layer.text, at):
        stop = NOT_BYTE.search(layer.text, m.start())
        raw = layer.text[m.start() : stop.start() if stop else None].encode("latin-1")
        text, used, large = _unpacked(raw, most)
        at = m.start() + (max(used, 1) if text or large else 1)
        if large:
            yield None
        elif text:
            start, end = layer.place(m.start(), m.start() + max(used, 1))
            yield Layer(text.decode("latin-1"), start, end, f"{layer.via}packed/")


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]], int, int]:
    """Base matches, all spans with the way to their layer, layers scanned, layers left unopened."""
    raw = text.encode("utf-8", "surrogatepass")
    base = matches(text, raw)
    spans = {m: "" for m in base}
    if not ("%" in text or "\\" in text or "&#" in text or _has_run(raw, RUN_MARKS, LEAST_RUN) or any(m in text for m in MAGICS)):
        return base, [(*m, "") for m in base], 1, 0
    whole = np.arange(len(text))
    work, seen, layers, unopened = deque([Layer(text, whole, whole + 1)]), set(), 1, 0
    budget = BUDGET + BUDGET_X * len(text)
    while work:
        layer = work.popleft()
        for step in (_percent, _unicode, _base64, partial(_compressed, most=max(budget, 0))):
            for new in step(layer):
                if new is None or len(new.text) > budget:
                    unopened += 1
                    continue
                raw = new.text.encode("utf-8", "surrogatepass")
                key = (xxhash.xxh3_128_digest(raw), new.place(0, len(new.text)))
                if key in seen:
                    continue
                seen.add(key)
                budget -= len(new.text)
                layers += 1
                for start, kind, end in matches(new.text, raw):
                    first, last = new.place(start, end)
                    spans.setdefault((first, kind, last), new.via)
                work.append(new)
    return base, sorted((*m, via) for m, via in spans.items()), layers, unopened


SPANS = (
    "doc_id long, base array<struct<kind:string,start:long,end:long>>, "
    "spans array<struct<kind:string,start:long,end:long,via:string>>, layers long, unopened long"
)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base matches, all spans (with the decodings that led there, as url/base64/), layers scanned and left unopened.

    A map over the scan: nothing is shuffled, a task holds one batch and the layers of one text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = ddl_schema(SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, spans, layers, unopened = scan(text or "")
                plain = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base]
                every = [{"kind": KINDS[k], "start": s, "end": e, "via": v} for s, k, e, v in spans]
                rows.append((doc_id, plain, every, layers, unopened))
            yield record_batch(list(zip(*rows)) or [[]] * len(out), out)

    return source.mapInArrow(run, SPANS)


def op11_decoding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents, in the text and in its decoded layers."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        "layers",
        "unopened",
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The SHA-256 of spans in their written form, for tests and other users."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
