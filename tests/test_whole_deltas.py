"""The pooled test is over the pass@1 deltas as they are, and exact for forty different ones, on whatever grid."""

import datetime
import itertools
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__
from pairwell.operators import estimates

NAME = "rel6_pooled_significance"


def brute_p(d, shift=0.0):
    x = np.array(d) - shift
    sums = np.array(list(itertools.product((1, -1), repeat=len(x)))) @ x
    return float(np.mean(np.abs(sums) >= abs(x.sum()) - 1e-12))


def events(passed, runs, control):
    """So many runs an arm: of case i so many pass with the skill, and `control` without."""
    rows = []
    for i, with_skill in enumerate(passed):
        for run in range(runs):
            for arm, c in enumerate((with_skill, control)):
                n = len(rows)
                rows.append((2 * n + arm, 3 * i, "click", datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=n), 100.0 if run < c else 0.0, '{"k": 7}'))
    return rows


#: The last has 79 of 640 without the skill, which is 0.1234375.
@pytest.mark.parametrize(
    "passed, runs, control", [([4] * 8, 10, 3), ([4, 4, 4, 4, 4, 4, 5, 2, 4, 3], 10, 3), ([2, 2, 2, 2, 2, 1, 2, 4, 2], 10, 3), ([3, 3, 4], 10, 3), ([100, 101, 64], 640, 79)]
)
def test_small_deltas_are_not_rounded_away(spark, tmp_path, passed, runs, control):
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(events(passed, runs, control), "event_id long, user_id long, event_type string, ts timestamp, value double, props string").write.parquet(path)
    r = __spark_entry__.queries()[NAME](spark, str(tmp_path)).collect()
    millionths = lambda c: (2_000_000 * c + runs) // (2 * runs)
    d = [(millionths(c) - millionths(control)) / 1_000_000 for c in passed]
    assert [(x.model, x.units) for x in r] == [("m0", len(d))]
    assert r[0].mean == pytest.approx(sum(d) / len(d), abs=1e-9) and r[0].p_value == pytest.approx(brute_p(d), abs=1e-9)
    assert r[0].bounded == (len(d) > 5 and len(set(d)) > 1)
    if r[0].bounded:
        for end, out in ((r[0].low, -1), (r[0].high, 1)):
            assert brute_p(d, end + out * 1.1e-5) <= 0.05 < brute_p(d, end - out * 1.1e-5)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    got = duck.execute(__spark_entry__.oracle_sql()[NAME])
    columns = [c[0] for c in got.description]
    assert [tuple(x[c] for c in columns) for x in r] == got.fetchall()


def test_off_every_grid_is_exact():
    rng = np.random.default_rng(7)
    d = rng.normal(0.2, 1, 13)
    found = estimates.sign_patterns(*np.unique(d, return_counts=True))
    assert found.exact
    for shift in (0.0, 0.3, -1.0, float(d.mean())):
        assert found.p(shift) == pytest.approx(brute_p(d, shift), abs=1e-12)


def test_halves_of_repeated_deltas():
    d = [0.1] * 5 + [-0.2] * 3 + [0.05, 0.3, 0.0, 0.0]
    found = estimates.SignHalves(*np.unique(d, return_counts=True))
    assert found.exact
    for shift in (0.0, 0.1, -0.15, 0.4):
        assert found.p(shift) == pytest.approx(brute_p(d, shift), abs=1e-12)


def test_forty_deltas_against_counting():
    rng = np.random.default_rng(8)
    steps = rng.choice(np.arange(-150, 260), 40, replace=False)
    reach = int(np.abs(steps).sum())
    ways = np.zeros(2 * reach + 1)
    ways[reach] = 1.0
    for k in np.abs(steps).tolist():
        ways = (np.roll(ways, k) + np.roll(ways, -k)) / 2
    want = ways[np.abs(np.arange(-reach, reach + 1)) >= abs(steps.sum())].sum()
    found = estimates.SignHalves(steps / 1000, np.ones(40, np.int64))
    assert found.exact and found.p() == pytest.approx(want, abs=1e-12)
    assert not estimates.SignHalves(rng.normal(0, 1, 42), np.ones(42, np.int64)).exact


def test_draws_decide_by_their_bound(monkeypatch):
    values, counts = np.array([0.1, 0.25, -0.05]), np.array([3, 2, 4])
    for draws, p, rejected in ((4096, 0.049, False), (4096, 0.02, True), (4096, 0.051, False), (0, 0.049, True)):
        found = estimates.SignPatterns(values, counts, draws)
        monkeypatch.setattr(found, "p", lambda shift, p=p: p)
        assert found.exact == (draws == 0) and found.rejects(0.0, 0.05) is rejected
    assert math.log(estimates.LOOKS / estimates.FAILURE) > 4096 * (0.049 * math.log(0.049 / 0.05) + 0.951 * math.log(0.951 / 0.95))
