"""A curve leaves the worker in batches, whatever its length, and is the same in one batch or many."""

import pytest
from pyspark.sql import functions as F

from pairwell.operators import estimates


def test_curve_comes_in_batches(monkeypatch):
    whole = list(estimates._curve(1000, 300, None))
    assert len(whole) == 1
    monkeypatch.setattr(estimates, "CURVE_POINTS", 7)
    parts = list(estimates._curve(1000, 300, None))
    assert max(len(k) for k, _, _ in parts) == 7
    for j in range(3):
        assert [x for p in parts for x in p[j].tolist()] == whole[0][j].tolist()


@pytest.mark.parametrize("most", [None, 1, 5])
def test_points_of_all_groups(spark, monkeypatch, most):
    monkeypatch.setattr(estimates, "CURVE_POINTS", 4)
    rows = spark.range(60).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.5).alias("rate"))
    got = {(r.g, r.k): r for r in estimates.reliability(rows, ["g"], most).collect()}
    sizes = {g: len(range(g, 60, 7)) for g in range(7)}
    assert set(got) == {(g, k) for g, n in sizes.items() for k in range(1, min(n, most or n) + 1)}
    for (g, k), r in got.items():
        c = sum(i % 3 == 0 for i in range(g, 60, 7))
        miss = hit = 1.0
        for i in range(k):
            miss, hit = miss * max(r.n - c - i, 0) / (r.n - i), hit * max(c - i, 0) / (r.n - i)
        assert (r.c, r.pass_at_k, r.pass_hat_k) == (c, pytest.approx(1 - miss, abs=1e-6), pytest.approx(hit, abs=1e-6))
