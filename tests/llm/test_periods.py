"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pairwell.llm import periods


def brute(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i + q - start >= max(12, 2 * q):
                    out.setdefault((start, i + q), q)
                start = i + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_row(doc_id, text):
    words = periods.WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None, None, None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(kept)))


def test_runs_equal_brute_force():
    r = random.Random(3)
    for case in range(1500):
        words = []
        while len(words) < r.randrange(140):
            block = [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randrange(1, 14))]
            words += block * r.randrange(1, 6)
        assert periods.runs(np.array(words, np.int64)) == brute(words), case


def test_known_words():
    words = list("abaababaabaababaababaabaababaabaab")  # a Fibonacci word has as many runs as any
    assert periods.runs(periods.interned(words)) == brute(words)
    assert periods.runs(periods.interned(["x"] * 12)) == [(0, 12, 1)] and periods.runs(periods.interned(["x"] * 11)) == []


def test_query_against_brute_force(spark, make_docs, odd_rows, tmp_path):
    r = random.Random(8)
    rows = [*odd_rows] + [(i, " ".join(r.choice("abc") for _ in range(r.randrange(90)))) for i in range(200, 330)]
    rows += [(i, " ".join(f"w{j}" for j in range(r.randrange(400)))) for i in (6, 29, 37, 40, 48, 81)] + [(6, "one two three four five six seven eight nine ten")]
    docs = make_docs(rows).withColumns({c: F.lit("clash") for c in ("start", "length", "period", "n_runs", "words")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.op13_main_lorentz(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*x) for x in rows), key=str)


def test_long_text_and_empty_table(make_docs):
    words = ["a", "b", "c"] * 20_000
    assert periods.runs(periods.interned(words)) == [(0, 60_000, 3)]
    assert periods.periodic_runs(make_docs([])).count() == 0
    assert [tuple(r) for r in periods.run_spans(make_docs([(1, "x " * 12)])).collect()] == [(1, 0, 12, 1)]
