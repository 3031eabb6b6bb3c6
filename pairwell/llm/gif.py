"""GIF media columns: encoding, decoding with timing, disposal and transparency, colour histograms.

LZW code widths depend only on a code's ordinal since the last clear code, so
codes are cut out of (and put into) the bit stream with array operations;
strings are rebuilt code by code. Frames are composed on the canvas as the
format says: disposal 2 clears the frame's area, 3 brings back what was there,
a transparent index leaves the canvas as it is, interlaced rows are put in
order. A frame's histogram counts the canvas in 4 x 4 x 4 colour bins.

Byte payloads are stored as frames 64 pixels wide with a 3-3-2 bit palette,
one palette index per byte, at most FRAME_ROWS rows a frame.

Defined cases: a null text is the empty text, a frame of 64 zero bytes;
repeated rows give equal values; rows without an id keep it null; a null media
value gives no frames, a damaged one an error row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import ddl_schema, materialize, read_table, record_batch, text_batches

WIDTH, FRAME_ROWS, DELAY = 64, 4096, 10
#: Fixed by the format: the most codes, and the rows of an interlaced image by pass (first, step).
TABLE = 4096
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))

_INDEX = np.arange(256)
PALETTE = np.stack([(_INDEX >> 5) * 255 // 7, (_INDEX >> 2 & 7) * 255 // 7, (_INDEX & 3) * 85], axis=1).astype(np.uint8)


def _widths(count: int, bits: int) -> np.ndarray:
    """Width of each of `count` codes that follow a clear code, for data of `bits` bits."""
    free = (1 << bits) + 2 + np.arange(count) - 1  # the next entry when the code is read
    free[:1] = (1 << bits) + 2
    return np.minimum(np.floor(np.log2(np.maximum(free, 1))).astype(np.int64) + 1, 12)


_FULL = TABLE + 8
_WIDTHS = {bits: _widths(_FULL, bits) for bits in range(2, 9)}
_OFFSETS = {bits: np.concatenate([[0], np.cumsum(w)]) for bits, w in _WIDTHS.items()}


def lzw_codes(data: bytes, bits: int = 8) -> tuple[list[int], list[int]]:
    """Codes of the data, and where in them each run after a clear code begins."""
    clear = 1 << bits
    codes, runs = [clear], [1]
    add, table, free = codes.append, {}, clear + 2
    get = table.get
    prefix = data[0]
    for c in data[1:]:
        key = prefix << 8 | c
        known = get(key)
        if known is not None:
            prefix = known
            continue
        add(prefix)
        table[key] = free
        free += 1
        prefix = c
        if free == TABLE:
            add(clear)
            runs.append(len(codes))
            table.clear()
            free = clear + 2
    add(prefix)
    add(clear + 1)
    return codes, runs


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of the data, one byte or more."""
    codes, runs = lzw_codes(data, bits)
    ends = [*runs[1:], len(codes)]
    widths = np.concatenate([[bits + 1], *(_WIDTHS[bits][: b - a] for a, b in zip(runs, ends))])
    lanes = np.arange(12, dtype=np.uint16)
    spread = (np.array(codes, np.uint16)[:, None] >> lanes).astype(np.uint8) & 1
    return np.packbits(spread[lanes < widths[:, None]], bitorder="little").tobytes()


def _codes_from(raw: np.ndarray, at: int, bits: int, limit: int, all_: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, widths and codes that follow bit `at`: as many as fill the table, or all up to the end."""
    offsets, widths = at + _OFFSETS[bits][:-1], _WIDTHS[bits]
    if all_:
        more = offsets[-1] + 12 * (1 + np.arange(max(0, limit - int(offsets[-1])) // 12))
        offsets, widths = np.concatenate([offsets, more]), np.concatenate([widths, np.full(len(more), 12, widths.dtype)])
    count = int(np.searchsorted(offsets + widths, limit, "right"))
    offsets, widths = offsets[:count], widths[:count]
    byte = offsets >> 3
    window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
    return offsets, widths, (window >> (offsets & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The first `size` pixels of a code stream; what is missing is zero."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0" * 4, np.uint8).astype(np.uint32)
    limit, at, got, out = 8 * len(stream), 0, 0, []
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    while got < size and at + bits + 1 <= limit:
        offsets, widths, found = _codes_from(raw, at, bits, limit, False)
        stops = np.flatnonzero((found == clear) | (found == end))
        if not len(stops) and len(found) == _FULL:  # the clear code is deferred: the table stays, the codes too are as wide as before
            offsets, widths, found = _codes_from(raw, at, bits, limit, True)
            stops = np.flatnonzero((found == clear) | (found == end))
        run = int(stops[0]) if len(stops) else len(found)
        codes = found[:run].tolist()
        if codes and codes[0] < clear:
            table = singles.copy()
            add, free = table.append, clear + 2
            last = table[codes[0]]
            text = [last]
            for c in codes[1:]:
                if c < free:
                    entry = table[c]
                elif c == free:
                    entry = last + last[:1]
                else:
                    raise ValueError("code beyond the table")
                text.append(entry)
                if free < TABLE:
                    add(last + entry[:1])
                    free += 1
                last = entry
            piece = b"".join(text)
            out.append(piece)
            got += len(piece)
        elif codes:
            raise ValueError("first code is no pixel")
        if not len(stops):
            break
        at = int(offsets[run] + widths[run])
        if found[run] == end:
            break
    return b"".join(out)[:size].ljust(size, b"\0")


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes, closed by an empty one."""
    whole = len(data) // 255
    body = np.empty((whole, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_payload(payload: bytes, n_bytes: int) -> bytes:
    """A GIF whose pixels are the payload, a positive multiple of 64 bytes; n_bytes goes into a comment."""
    rows = len(payload) // WIDTH
    parts = [
        b"GIF89a",
        struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0),
        PALETTE.tobytes(),
        b"\x21\xfe" + _blocks(b"n_bytes=%d" % n_bytes),
    ]
    for top in range(0, rows, FRAME_ROWS):
        some = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        parts += [
            b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0),
            b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(some) // WIDTH, 0) + b"\x08",
            _blocks(lzw_encode(some)),
        ]
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    indices: bytes


@dataclass
class Gif:
    width: int
    height: int
    comment: bytes
    frames: list[Frame]
    error: str | None = None


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    size = 2 << (flags & 7)
    table = np.zeros((256, 3), np.uint8)
    table[:size] = np.frombuffer(data, np.uint8, size * 3, at).reshape(size, 3)
    return table, at + size * 3


def _deinterlaced(indices: bytes, width: int, height: int) -> bytes:
    rows = np.frombuffer(indices, np.uint8).reshape(height, width)
    out = np.empty_like(rows)
    order = [y for first, step in PASSES for y in range(first, height, step)]
    out[order] = rows
    return out.tobytes()


def parse(data: bytes) -> Gif:
    """All frames of a GIF file with their palettes and rules; of a damaged one those before the damage, and what it is."""
    gif = Gif(0, 0, b"", [])
    try:
        _parse(data, gif)
    except (ValueError, IndexError, struct.error) as e:
        gif.error = "cut short" if isinstance(e, IndexError) else str(e)
    return gif


def _parse(data: bytes, gif: Gif) -> None:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    gif.width, gif.height, control = width, height, (0, 0, None)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label, (body, after) = data[at + 1], _read_blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay * 10, index if packed & 1 else None)
            elif label == 0xFE:
                gif.comment += body
            at = after
        elif data[at] == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at, palette = at + 10, shared
            if local & 0x80:
                palette, at = _palette(data, at, local)
            bits = data[at]
            body, at = _read_blocks(data, at + 1)
            indices = lzw_decode(body, bits, w * h)
            if local & 0x40 and h:
                indices = _deinterlaced(indices, w, h)
            gif.frames.append(Frame(left, top, w, h, control[1], control[0], control[2], palette, indices))
            control = (0, 0, None)
        else:
            raise ValueError(f"no block at byte {at}")


def _bins(palette: np.ndarray) -> np.ndarray:
    r, g, b = (palette[:, i].astype(np.int64) >> 6 for i in range(3))
    return r * 16 + g * 4 + b


def histograms(gif: Gif) -> list[np.ndarray]:
    """64 colour bins of the canvas as each frame shows it; untouched canvas counts in no bin."""
    found, canvas = [], None
    plain = all(
        f.transparent is None and (f.left, f.top, f.width, f.height) == (0, 0, gif.width, gif.height) for f in gif.frames
    )
    for f in gif.frames:
        pixels = np.frombuffer(f.indices, np.uint8)
        if plain:
            counts = np.bincount(pixels, minlength=256)
            found.append(np.bincount(_bins(f.palette), weights=counts, minlength=64).astype(np.int64))
            continue
        if canvas is None:
            canvas = np.full((gif.height, gif.width), -1, np.int16)
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        image = pixels.reshape(f.height, f.width)[: area.shape[0], : area.shape[1]]
        shown = _bins(f.palette)[image].astype(np.int16)
        np.copyto(area, shown, where=image != f.transparent if f.transparent is not None else True)
        found.append(np.bincount(canvas[canvas >= 0], minlength=64).astype(np.int64))
        if f.disposal == 2:
            area[:] = -1
        elif f.disposal == 3:
            canvas = before
    return found


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media, the text's bytes as a GIF."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = ddl_schema("doc_id long, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            media = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                media.append(encode_payload(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)))
            yield record_batch([batch.column("doc_id"), media], out)

    return source.mapInArrow(run, "doc_id long, media binary")


FRAMES = (
    "doc_id long, frame int, left int, top int, width int, height int, delay_ms long, disposal int, "
    "transparent int, pixels binary, histogram array<long>, error string"
)


def frames(media: DataFrame) -> DataFrame:
    """A row per frame of each GIF in column media, with palette indices and the canvas's colour histogram.

    A file that is damaged or no GIF has one row more, whose frame is null and whose error says why.
    """
    out = ddl_schema(FRAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "media"):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                gif = parse(data) if data else Gif(0, 0, b"", [])
                for i, (f, h) in enumerate(zip(gif.frames, histograms(gif))):
                    rows.append(
                        (doc_id, i, f.left, f.top, f.width, f.height, f.delay_ms, f.disposal, f.transparent, f.indices, h.tolist(), None)
                    )
                if gif.error:
                    rows.append((doc_id, *[None] * (len(out) - 2), gif.error))
            yield record_batch(list(zip(*rows)) or [[]] * len(out), out)

    return media.select("doc_id", "media").mapInArrow(run, FRAMES)


STORED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def _stored(doc_id: int | None, data: bytes) -> tuple:
    gif = parse(data)
    if gif.error:
        raise ValueError(gif.error)
    payload = b"".join(f.indices for f in gif.frames)
    total = sum(histograms(gif))
    lasts = sum(f.delay_ms for f in gif.frames)
    bins = ",".join(f"{i}:{n}" for i, n in enumerate(total.tolist()) if n)
    return (
        doc_id, int(gif.comment.removeprefix(b"n_bytes=")), len(payload), hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={len(gif.frames)};ms={lasts};{bins}",
    )


def payload_features(media: DataFrame) -> DataFrame:
    """What the stored GIFs of `media_column` hold: digests of the payload and its frames' colours."""
    out = ddl_schema(STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "media"):
            rows = [_stored(i, m) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist())]
            yield record_batch(list(zip(*rows)), out)

    return media.select("doc_id", "media").mapInArrow(run, STORED)


def op4_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF, read back and described."""
    return payload_features(materialize(media_column(read_table(spark, sf_dir, "documents")), "media"))
