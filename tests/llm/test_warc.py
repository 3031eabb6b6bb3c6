import gzip
import random
from collections import defaultdict

from pairwell.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    same = defaultdict(list)
    for page_id, _, html in rows:
        same[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        known = [i for i in same[html or ""] if i is not None]
        first = min(known, default=None)
        payload = (html or "").encode()
        role = ("response", None) if page_id == first else ("revisit", first)
        out.append((page_id, len(payload), warc.payload_digest(payload), *role))
    return sorted(out, key=str)


def read_back(spark, rows, path):
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), path)
    found = warc.read_warc(spark, path).collect()
    assert all(r.kind == "record" for r in found)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)


ROWS = [
    (5, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (9, None, None), (4, "u\r\nX: y", ""), (7, "http://c/", "é漢" * 9000),
    (8, "http://d", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (2, "http://b/", "<p>one</p>"),
    (11, "z", "\x1f\x00 bytes\r\n\r\n"), (None, "n", "<p>one</p>"),
]


def test_round_trip_against_brute_force(spark, tmp_path):
    assert read_back(spark, ROWS, f"file://{tmp_path}/w") == brute(ROWS)


def test_many_copies(spark, tmp_path):
    rows = [(i, f"u{i}", "same" if i % 3 else f"page {i}") for i in range(400)]
    assert read_back(spark, rows, f"file://{tmp_path}/w") == brute(rows)


def test_empty(spark, tmp_path):
    assert read_back(spark, [], f"file://{tmp_path}/w") == []


def test_files_are_plain_gzip(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part*"))
    assert text.count(b"WARC-Record-ID: ") == len(ROWS)


def records(n):
    return [warc.record(i, f"u{i}", f"payload {i} ".encode() * 50, False, None) for i in range(n)]


def ids(found):
    return [warc._page(f[3]["warc-record-id"]) for f in found if f[0] == "record"]


def test_salvage_of_damaged_members():
    rng = random.Random(3)
    members = [warc.member(r) + b"\0" for r in records(30)]
    starts = [sum(map(len, members[:i])) for i in range(31)]
    for _ in range(60):
        data, bad = bytearray(b"".join(members)), set()
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(30)
            at = starts[i] + rng.randrange(10, len(members[i]) - 1)  # bytes 3 to 9 of a gzip header are free
            data[at] ^= 1 << rng.randrange(8)
            bad.add(i)
        found = list(warc.salvage(bytes(data)))
        got = ids(found)
        assert [i for i in range(30) if i not in bad] == [i for i in got if i not in bad]
        covered = sorted({(f[1], f[2]) for f in found})
        for (_, a), (b, _) in zip(covered, covered[1:]):
            assert a <= b and not data[a:b].strip(b"\0")


def test_salvage_of_cut_and_joined_files():
    a, b = (b"".join(warc.member(r) + b"\0" for r in records(n)) for n in (5, 3))
    found = list(warc.salvage(a[:-40] + b))
    assert ids(found) == [0, 1, 2, 3, 0, 1, 2] and [f[0] for f in found].count("gap") == 1
    assert list(warc.salvage(b"")) == []
    assert [f[:3] for f in warc.salvage(b"junk")] == [("gap", 0, 4)]


def test_salvage_of_plain_records():
    parts = records(6)
    parts[2] = parts[2].replace(b"payload 2", b"pay1oad 2", 1)  # the digest no longer fits
    parts[4] = parts[4].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(warc.salvage(b"".join(parts)))
    assert ids(found) == [0, 1, 3, 5]
    assert [(f[1], f[2]) for f in found if f[0] == "gap"] == [
        (len(b"".join(parts[:k])), len(b"".join(parts[: k + 1]))) for k in (2, 4)
    ]


def test_gap_log(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(b"\x1f\x8b\x08broken" + warc.member(records(1)[0]) + b"\0")
    rows = warc.read_warc(spark, f"file://{tmp_path}", with_payload=True)
    gap = warc.gap_log(rows).collect()
    assert [(r.byte_from, r.byte_to) for r in gap] == [(0, 9)]
    assert bytes(rows.filter("kind = 'record'").first().payload) == b"payload 0 " * 50
