"""The rendered view: composition, case folding, removed signs and positions; curves and trees."""

import hashlib
import random
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from pairwell.functions import text as tx
from pairwell.functions import view
from pairwell.operators import costs, estimates, trees

DECOMPOSED, COMPOSED = "café", "café"


@pytest.mark.parametrize(
    ("text", "value", "found"),
    [
        (DECOMPOSED, COMPOSED, True), (COMPOSED, DECOMPOSED, True), ("STRASSE", "straße", True), ("straße", "STRASSE", True), ("İstanbul", "i̇stanbul", True), ("ΣΊΣΥΦΟΣ", "σίσυφος", True),
        ("al​pha", "alpha", True), ("alpha", "al⁠pha﻿", True), ("Alpha", "aLPHA", True), ("cafe", COMPOSED, False), ("al pha", "alpha", False), (None, "x", None),
    ],
)
def test_contains_on_the_view(spark, text, value, found):
    df = spark.createDataFrame([(text, value)], "t string, v string")
    r = df.select(tx.contains(F.col("t"), F.col("v")).alias("a"), tx.contains_all(F.col("t"), [value]).alias("b"), tx.excludes_any(F.col("t"), [value, "zzz"]).alias("c"), view.located(F.col("t"), value).alias("p")).first()
    assert (r.a, r.b, r.c, r.p is not None) == (found, found, None if found is None else not found, bool(found))


def test_evidence(spark):
    rows = [("plain",), ("a​b﻿​",), (DECOMPOSED,), (COMPOSED,), (None,), ("e​́",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").coalesce(1).select(view.normalization(F.col("t")).alias("n")).collect()]
    assert got[0][:] == (False, False, {}, []) and got[4] is None
    assert got[1][:] == (True, False, {"U+200B": 2, "U+FEFF": 1}, [1, 3, 4])
    assert got[2][:] == (True, True, {}, []) and got[3][:] == (False, False, {}, [])
    assert got[5].canonical_normalized and got[5].removed_at == [1]


def test_positions_are_of_the_text_as_it_stands(spark):
    r = random.Random(4)
    bits = ["a", "B", "ß", "​", "⁠", "é", "é", "漢", "한", "한", "İ", "\n", "q̣̇", "́"]
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(9)))
        folds, starts, ends = view.positions(text)
        assert folds == view.fold_of(text) and len(folds) == len(starts) == len(ends)
        for i in range(len(folds)):
            assert folds[i] in view.fold_of(text[starts[i] : ends[i]])
    df = spark.createDataFrame([("xx AL​PHA",), ("alpha é",), ("no",)], "t string").coalesce(1)
    assert [r.p and tuple(r.p) for r in df.select(view.located(F.col("t"), "alpha").alias("p")).collect()] == [(3, 9), (0, 5), None]


def test_leaked_lengths_are_of_the_view(spark):
    df = spark.createDataFrame([("a", "a​​​"), ("say ALPHA", "al​pha")], "p string, v string")
    assert [r[0] for r in df.coalesce(1).select(costs.leaked(F.col("p"), F.col("v"), 4)).collect()] == [False, True]


def test_curves_for_a_thousand_runs(spark):
    rows = [("a", 1.0 if i < 37 else 0.25) for i in range(1000)] + [("b", 1.0)] * 3 + [("c", 0.0), ("c", None), ("c", 2.0)]
    got = estimates.reliability(spark.createDataFrame(rows, "g string, rate double"), ["g"])
    of = {(r.g, r.k): r for r in got.collect()}
    assert len(of) == 1004
    for k in (1, 2, 10, 100, 963, 964, 1000):
        miss = Fraction(comb(963, k), comb(1000, k))
        assert abs(of["a", k].pass_at_k - float(1 - miss)) < 1e-6 and abs(of["a", k].pass_hat_k - float(Fraction(comb(37, k), comb(1000, k)))) < 1e-6
    assert (of["b", 3].pass_hat_k, of["c", 1].pass_at_k, of["c", 1].n) == (1.0, 0.0, 1)


def test_tree_digests(spark):
    def sha(entries):
        d = hashlib.sha256()
        for path, content in sorted(entries, key=lambda e: tuple(e[0].split("/"))):
            d.update(path.encode() + b"\0" + content)
        return d.hexdigest()

    one = [("a-b", b"1"), ("a/b", b"2"), ("a/é", b""), ("z", b"\0\xff"), ("a/b.c/d", b"3")] + [(f"many/{i}", b"x" * i) for i in range(300)]
    rows = [("one", *e) for e in one] + [("twice", "a", b"1"), ("twice", "a", b"2"), ("empty", "", b"1"), ("null", None, b"1"), (None, "a", None)]
    got = {r.root: r for r in trees.tree_digest(spark.createDataFrame(rows, "root string, path string, content binary").repartition(5), ["root"], "path", "content").collect()}
    assert got["one"].tree_sha256 == sha(one) and got["one"].files == len(one)
    assert (got["twice"].tree_sha256, got["twice"].problem) == (None, "repeated path") and got["empty"].problem == got["null"].problem == "empty path"
    assert got[None].tree_sha256 == sha([("a", b"")])
