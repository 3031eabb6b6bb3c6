import random
import zlib

import numpy as np

from pairwell.llm import gif, warc
from test_gif import make
from test_warc import ids, records


def whole_member(parts):
    return warc.member(b"".join(parts)) + b"\0"


def test_a_broken_member_gives_the_records_before_the_break():
    parts, rng = records(50), random.Random(2)
    noise = [warc.record(100 + i, f"n{i}", rng.randbytes(4000), False, None) for i in range(20)]  # so that a break is seen soon
    data = whole_member(noise)
    cut = list(warc.salvage(data[: len(data) // 2] + whole_member(parts)))
    got = ids(cut)
    assert got[-50:] == list(range(50)) and 7 <= len(got) - 50 <= 10 and got[:7] == list(range(100, 107))
    assert [f[0] for f in cut].count("gap") == 1
    bad = bytearray(data)
    bad[len(data) // 2] ^= 255
    got = ids(warc.salvage(bytes(bad) + whole_member(parts)))
    assert got[:7] == list(range(100, 107)) and got[-50:] == list(range(50))


def test_a_damaged_record_in_a_whole_member_costs_itself_alone():
    parts = records(9)
    parts[4] = parts[4].replace(b"payload 4", b"pay1oad 4", 1)
    found = list(warc.salvage(whole_member(parts) + whole_member(records(2))))
    assert ids(found) == [0, 1, 2, 3, 5, 6, 7, 8, 0, 1]
    assert [f[3] for f in found if f[0] == "gap"] == ["payload digest"]


def deferred(data, bits):
    """A code stream that never clears its table once that is full."""
    clear = 1 << bits
    table, free, out, prefix = {}, clear + 2, [clear], data[0]
    for c in data[1:]:
        if (prefix, c) in table:
            prefix = table[prefix, c]
            continue
        out.append(prefix)
        if free < gif.TABLE:
            table[prefix, c] = free
            free += 1
        prefix = c
    out += [prefix, clear + 1]
    total, at, free = 0, 0, clear + 2
    for k, code in enumerate(out):
        width = bits + 1 if k == 0 else max(bits + 1, min(12, (clear + 2 + max(0, k - 2)).bit_length()))
        total |= code << at
        at += width
    return total.to_bytes(-(-at // 8), "little")


def test_a_clear_code_may_be_deferred():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(deferred(data, 8), 8, len(data)) == data
    assert gif.lzw_decode(deferred(b"ab" * 30_000, 8), 8, 60_000) == b"ab" * 30_000


def test_bad_files_are_rows(spark):
    good = make(2, 2, [(0, 0, 2, 2, 1, None, [0, 1, 2, 3], 0), (0, 0, 2, 2, 1, None, [3, 2, 1, 0], 0)])
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no gif")), (3, bytearray(good[:-6])), (4, None), (5, bytearray(b""))], "doc_id long, media binary")
    rows = gif.frames(media).collect()
    assert sorted((r.doc_id, -1 if r.frame is None else r.frame, r.error is None) for r in rows) == [(1, 0, True), (1, 1, True), (2, -1, False), (3, -1, False), (3, 0, True)]


def test_features_against_brute_force(make_docs):
    text = "Ein Text, ein Text. " * 9
    raw = text.encode()
    padded = raw + b"\0" * (-len(raw) % 64)
    bins = {}
    for byte in padded:
        r, g, b = (byte >> 5) * 255 // 7, (byte >> 2 & 7) * 255 // 7, (byte & 3) * 85
        key = (r >> 6) * 16 + (g >> 6) * 4 + (b >> 6)
        bins[key] = bins.get(key, 0) + 1
    row = gif.payload_features(gif.media_column(make_docs([(1, text)]))).first()
    assert row.feature == "frames=1;ms=100;" + ",".join(f"{k}:{bins[k]}" for k in sorted(bins))
    assert row.tail_crc32 == zlib.crc32(padded[-64:])
