import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwell.llm import gif


def slow_encode(data, bits):
    """Textbook LZW with strings and one big integer."""
    clear = 1 << bits
    table = {bytes([i]): i for i in range(clear)}
    free, width, value, at = clear + 2, bits + 1, clear, bits + 1
    seen = 0  # codes since the clear code

    def put(code):
        nonlocal value, at, width, seen
        value |= code << at
        at += width
        seen += 1
        if clear + 2 + seen - 1 >= 1 << width and width < 12:
            width += 1

    word = b""
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = free
        free += 1
        word = bytes([b])
        if free == 4096:
            put(clear)
            table = {bytes([i]): i for i in range(clear)}
            free, width, seen = clear + 2, bits + 1, 0
    put(table[word])
    put(clear + 1)
    return value.to_bytes(-(-at // 8), "little")


@pytest.mark.parametrize("n", [1, 2, 255, 257, 800, 30_000])
def test_encoder_equals_textbook(n):
    rng = random.Random(n)
    for data in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.choices(b"abcde ", k=n)), b"a" * n):
        assert gif.lzw_encode(data) == slow_encode(data, 8)
        assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 8), st.binary(min_size=1, max_size=500))
def test_round_trip_of_any_depth(bits, raw):
    data = bytes(b & (1 << bits) - 1 for b in raw)
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def make(width, height, frames, palette=None):
    """frames: (left, top, w, h, disposal, transparent, indices, interlaced)"""
    palette = palette or [(i, i, i) for i in range(0, 256, 64)]
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), bytes(x for c in palette for x in c)]
    for left, top, w, h, disposal, transparent, indices, interlaced in frames:
        packed = disposal << 2 | (transparent is not None)
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", packed, 5, transparent or 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02")
        parts.append(gif._blocks(gif.lzw_encode(bytes(indices), 2)))
    return b"".join([*parts, b"\x3b"])


def test_disposal_and_transparency():
    data = make(
        2, 2,
        [
            (0, 0, 2, 2, 1, None, [0, 1, 2, 3], 0),
            (0, 0, 2, 1, 3, 1, [1, 3], 0),  # left is seen through; goes away afterwards
            (1, 1, 1, 1, 2, None, [0], 0),  # clears its area afterwards
            (0, 0, 1, 1, 0, 0, [0], 0),
        ],
    )
    seen = [np.flatnonzero(np.repeat(np.arange(64), h)).size and np.repeat(np.arange(64), h).tolist() for h in gif.histograms(gif.parse(data))]
    assert seen == [[0, 21, 42, 63], [0, 42, 63, 63], [0, 0, 21, 42], [0, 21, 42]]
    assert {f.delay_ms for f in gif.parse(data).frames} == {50}


def test_interlaced():
    rows = [[y % 4] * 2 for y in range(10)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    data = make(2, 10, [(0, 0, 2, 10, 0, None, [x for y in order for x in rows[y]], 1)])
    assert gif.parse(data).frames[0].indices == bytes(x for r in rows for x in r)


def test_damaged_stream():
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\xff\xff\xff", 8, 10)
    assert gif.lzw_decode(gif.lzw_encode(b"abc"), 8, 6) == b"abc\0\0\0"


def test_stored_against_brute_force(make_docs, odd_rows, monkeypatch):
    long = odd_rows + [(77, "long text " * 40_000)]
    got = gif.payload_features(gif.media_column(make_docs(long))).collect()
    want = []
    for doc_id, text in long:
        raw = (text or "").encode()
        padded = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        want.append((doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert len({tuple(r)[1:] for r in got if r.doc_id in (3, 7)}) == 1
    assert [r.feature.split(";")[0] for r in got if r.doc_id == 77] == ["frames=2"]


def test_frames(make_docs):
    rows = gif.frames(gif.media_column(make_docs([(1, "hello"), (2, None)]))).collect()
    assert [(r.doc_id, r.frame, r.width, r.height, r.delay_ms, sum(r.histogram)) for r in rows] == [(1, 0, 64, 1, 100, 64), (2, 0, 64, 1, 100, 64)]
    assert gif.frames(gif.media_column(make_docs([]))).count() == 0
