import itertools
import random
import time

import numpy as np
import pytest

from pairwell.operators import contracts, estimates, traces


def brute_p(d, shift=0.0):
    x = [v - shift for v in d]
    sums = [abs(sum(s * v for s, v in zip(signs, x))) for signs in itertools.product((1, -1), repeat=len(x))]
    return sum(v >= abs(sum(x)) - 1e-12 for v in sums) / len(sums)


CASES = [
    [0.3, 0.1, -0.2, 0.4, 0.05, 0.25, -0.1, 0.2, 0.15, 0.33], [1, 0, 0, 1, -1, 1, 1, 1, 0, 1, 1], [0.25] * 6 + [0.5] * 4, [1 / 3, 2 / 3, 0.5, 0.25, 1, 1 / 7, 0, 0],
    [-1, -1, -0.5, -0.25, -1, -0.75, 0.25],
]


@pytest.mark.parametrize("d", CASES)
def test_table_and_interval_against_enumeration(d):
    d = [float(x) for x in d]
    found = estimates.sign_patterns(*np.unique(d, return_counts=True))
    assert found.exact
    for shift in (0.0, 0.1, -0.3, sum(d) / len(d), 1.5):
        assert found.p(shift) == pytest.approx(brute_p(d, shift), abs=1e-12)
    low, high, bounded = estimates.interval(np.array(d))
    assert bounded
    for end, out in ((low, -1), (high, 1)):
        assert brute_p(d, end + out * 2e-6) <= 0.05 < brute_p(d, end - out * 2e-6)


def test_three_hundred_cases_are_exact_and_quick():
    rng = random.Random(3)
    d = np.array([rng.choice([-1.0, 0.0, 0.0, 1.0, 1.0]) for _ in range(300)])
    estimates.interval(d)
    began = time.time()
    assert estimates.sign_patterns(*np.unique(d, return_counts=True)).exact
    low, high, bounded = estimates.interval(d)
    assert bounded and low < d.mean() < high and time.time() - began < 3


def test_draws_where_the_table_is_too_large(monkeypatch):
    rng = random.Random(4)
    d = [rng.gauss(0.1, 1) for _ in range(12)]
    want = brute_p(d)
    monkeypatch.setattr(estimates, "MOST_CELLS", 10)
    found = estimates.sign_patterns(*np.unique(d, return_counts=True))
    assert not found.exact and found.p() == pytest.approx(want, abs=0.03)
    assert estimates.interval(np.array(d))[:2] == estimates.interval(np.array(d))[:2]


def test_groups_send_counted_deltas(spark):
    rows = [("a", 0.5)] * 7 + [("a", -0.25)] * 2 + [("a", None)] + [("b", 1.0)] * 8 + [("c", None)]
    got = {r.g: r for r in estimates.sign_flip(spark.createDataFrame(rows, "g string, delta double"), ["g"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].units == 9
    assert got["a"].p_value == pytest.approx(brute_p([0.5] * 7 + [-0.25] * 2), abs=1e-12)
    assert not got["b"].bounded and got["b"].p_value == pytest.approx(2 / 2**8)


def test_published_vectors():
    assert estimates.p_value(np.array([1.0] * 8)) == pytest.approx(2 / 256)
    assert estimates.p_value(np.array([0.0] * 8)) == 1.0
    assert estimates.p_value(np.array([0.5, -0.5, 0.25, -0.25])) == 1.0
    assert estimates.minimum_units_note("query").startswith("p <= 0.05 needs at least 6 queries that move the same way (the smallest reachable p with 6 is 0.03125)")


def test_order_and_call_sets_against_brute_force(spark):
    rng, rows, want = random.Random(5), [], {}
    for run in range(40):
        names = [rng.choice("abc") for _ in range(rng.randrange(7))]
        status = [rng.choice(["completed", "completed", "failed"]) for _ in names]
        rows += [(run, i, "command", n, s) for i, (n, s) in enumerate(zip(names, status))]
        done = [n for n, s in zip(names, status) if s == "completed"]
        if done:
            rest = iter(done)
            want[run] = (all(n in rest for n in "aba"), {"a", "b"} <= set(done), sorted(done) == ["a", "a", "b"], len(done))
    e = spark.createDataFrame(rows, "run_id int, index int, type string, name string, status string")
    order = {r.run_id: r.in_order for r in traces.in_order(e, ["a", "b", "a"]).collect()}
    sets = {r.run_id: tuple(r)[1:] for r in traces.call_sets(e, ["b", "a", "a"]).collect()}
    assert {k: (order[k], *sets[k]) for k in order} == want and set(sets) == set(order)


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"passed": true}', ("boolean", None)), ('{"passed": true, "threshold": 0.5}', ("boolean", None)), ('{"score": 0.5, "threshold": 0.4}', ("scored", None)),
        ('{"score": null, "passed": false}', ("boolean", None)), ('{"criteria": [], "threshold": 1}', (None, "foreign fields: threshold")),
        ('{"dimension_scores": {}, "criteria": []}', (None, "dimensions and criteria")), ("{}", (None, "no payload")), ("[]", (None, "no object")),
        ('{"verdict_kind": "odd"}', (None, "unknown kind: odd")), ('{"judge_panel": [], "passed": true, "score": 1}', ("consensus", None)),
        ('{"verdict_kind": "boolean", "passed": true, "score": 1, "threshold": 1}', (None, "foreign fields: score, threshold")),
    ],
)
def test_verdict_kinds(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert tuple(df.select(contracts.verdict_kind(df.raw).alias("v")).select("v.*").first()) == want


def test_strict_equality(spark):
    pairs = [("1", "1", True), ("1", "true", False), ("1", "1.0", False), ('{"a":1,"b":2}', ' {"b": 2, "a": 1}', True), ("[1,2]", "[2,1]", False), ("NaN", "NaN", None), (None, "1", None), ('{"a":1,"a":1}', "1", None)]
    df = spark.createDataFrame(pairs, "l string, r string, want boolean")
    assert all(r.got == r.want for r in df.select("want", contracts.strictly_equal(df.l, df.r).alias("got")).collect())
