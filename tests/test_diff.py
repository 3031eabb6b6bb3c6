"""Differences: patches give the other text back, and no script is shorter."""

import random
import re
import time

from pyspark.sql import functions as F

from pairwell.functions.diff import difference, hunks


def patched(a, lines):
    out, at, k = [], 0, 0
    while k < len(lines):
        m = re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", lines[k])
        start, n, to, size = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
        begin = start - (n > 0)
        out += a[at:begin]
        assert len(out) == to - (size > 0)
        at, k, before = begin, k + 1, (len(out), begin)
        while k < len(lines) and lines[k][0] != "@":
            sign, text = lines[k][0], lines[k][1:]
            if sign in " -":
                assert a[at] == text
                at += 1
            if sign in " +":
                out.append(text)
            k += 1
        assert (len(out) - before[0], at - before[1]) == (size, n)
    return out + a[at:]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_random_texts():
    r = random.Random(7)
    for case in range(3000):
        a, b = ([r.choice("abcdxyz@-+ "[: r.randrange(1, 12)]) for _ in range(r.randrange(25))] for _ in "ab")
        if case % 3 == 0:
            b = [x for x in a if r.random() < 0.8]
        found = hunks(a, b, r.randrange(4))
        assert patched(a, found) == b
        edits = sum(x[0] in "+-" for x in found)
        assert edits == len(a) + len(b) - 2 * longest(a, b)


def test_many_lines():
    r = random.Random(8)
    a = [str(r.randrange(1000)) for _ in range(100_000)]
    b = list(a)
    for _ in range(150):
        b[r.randrange(len(b))] = str(r.randrange(1000))
    began = time.time()
    assert patched(a, hunks(a, b)) == b and time.time() - began < 60
    assert len(hunks(["x"] * 100_000, ["y"] * 100_000)) == 200_001


def test_column(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "a\nB\nc"), ("same", "same"), (None, "x"), ("", "new"), ("@x", "-y")], "a string, b string").coalesce(1)
    got = [r.d and r.d[:] for r in df.select(difference(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [(1, 1, 1, "@@ -1,3 +1,3 @@\n a\n-b\n+B\n c"), (0, 0, 0, ""), None, (0, 1, 1, "@@ -0,0 +1 @@\n+new"), (1, 1, 1, "@@ -1 +1 @@\n-@x\n+-y")]
