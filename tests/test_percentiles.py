"""Exact percentiles by selection, and gate policies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.operators import cohorts, registry
from pairwell.operators.percentiles import exact_percentiles


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_percentiles_equal_numpy(spark, ranges):
    r = random.Random(6)
    data = {
        "few": [3.0], "two": [1.0, 2.0], "same": [5.0] * 50, "spread": [r.gauss(0, 1e6) for _ in range(997)], "far": [0.0] * 30 + [1.0] * 3 + [1e300, -1e300],
        "steps": [float(r.randrange(5)) for _ in range(400)], None: [1.0, 4.0, 9.0],
    }
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None)]
    got = exact_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", {"low": 0.0, "mid": 0.5, "p90": 0.9, "high": 1.0}, ranges).collect()
    assert {r.g for r in got} == set(data) and len(got) == len(data)
    for row in got:
        assert np.allclose([row.low, row.mid, row.p90, row.high], np.quantile(data[row.g], [0, 0.5, 0.9, 1]), rtol=1e-12), row.g


def test_policies(spark):
    assert registry.fail_on([" blockers,", "required"])[0] == "fail-on:blockers,required"
    name, kinds, severities = registry.fail_on(["judge-robustness", "canary-hit,recommended"])
    assert "canary-hit" in kinds and len(kinds) == 5 and severities == {"recommended"}
    assert all(k in {x[0] for x in registry.KINDS} for kinds in registry.PRESETS.values() for k in kinds)
    for bad in ([], ["", ","], ["no-such-kind"], ["Required"]):
        with pytest.raises(ValueError):
            registry.fail_on(bad)
    df = spark.createDataFrame([("canary-hit", "required"), ("floor-eval", "recommended"), ("x", None)], "kind string, severity string")
    assert [r.kind for r in registry.gated(df, ["contamination"]).collect()] == ["canary-hit"]
    assert registry.gated(df, ["recommended"]).agg(F.max("policy")).first()[0] == "fail-on:recommended"


def test_slices_of_several_values(spark):
    rows = [(1.0, "a", ["x", "y", "x"]), (0.0, None, ["x"]), (0.5, "a", []), (None, "b", None)]
    df = spark.createDataFrame(rows, "delta double, d string, goals array<string>")
    got = {(r.kind, r.value): (r.units, r.lift, r.lift_concentration) for r in cohorts.slices(df, ["d"], ["goals"]).collect()}
    assert got == {
        ("d", "a"): (2, 0.75, 1.5), ("d", "unspecified"): (1, 0.0, 0.0), ("d", "b"): (1, None, None),
        ("goals", "x"): (2, 0.5, 1.0), ("goals", "y"): (1, 1.0, 2.0), ("goals", "unspecified"): (1, None, None),
    }
