"""Ablation verdicts by exact test."""

from pyspark.sql import functions as F

from pairwell.operators import ablations


def report(spark, cases, expected=1, verified=True):
    rows = [("a", c, s, d, f) for c, (pairs) in cases.items() for s, d, f in pairs]
    df = spark.createDataFrame(rows, "ablation string, case_id string, status string, drop double, flipped boolean")
    found = ablations.case_evidence(df, F.lit(expected))
    gates = spark.createDataFrame([("a", verified)], "ablation string, provenance_verified boolean")
    return ablations.ablation_report(found, gates).first()


DROP, SAME, RISE = ("pair", 1.0, True), ("pair", 0.0, False), ("pair", -1.0, False)


def test_one_significant_case_confirms_beside_an_underpowered_one(spark):
    r = report(spark, {"strong": [DROP] * 6, "weak": [DROP] * 2, "still": [SAME] * 3})
    assert r.verdict == "confirmed_causal" and r.confirming == ["strong"]


def test_seen_but_not_significant_is_open(spark):
    assert report(spark, {"c": [DROP] * 5}).verdict == "indeterminate"
    assert report(spark, {"c": [DROP] * 8 + [RISE] * 4}).verdict == "indeterminate"


def test_a_rise_within_the_test_does_not_undo_it(spark):
    r = report(spark, {"c": [DROP] * 10 + [RISE]})  # p = 24 / 2048
    assert r.verdict == "confirmed_causal"


def test_no_regression_is_refuted(spark):
    assert report(spark, {"c": [SAME] * 9}).verdict == "refuted"
    assert report(spark, {"c": [("pair", 1.0, False)] * 9}).verdict == "refuted"
    assert report(spark, {"drops": [("pair", 1.0, False)] * 9, "flips": [("pair", -0.5, True)] * 9}).verdict == "refuted"


def test_gates(spark):
    assert report(spark, {"c": [DROP] * 9}, verified=False).verdict == "indeterminate"
    assert report(spark, {"c": [DROP] * 9}, verified=None).verdict == "indeterminate"
    assert report(spark, {"c": [DROP] * 9}, expected=10).verdict == "indeterminate"
    assert report(spark, {"c": [DROP] * 9 + [("blocked", 1.0, True)]}).verdict == "indeterminate"
    r = report(spark, {"c": [DROP] * 9, "gone": [("missing_control", None, None)]})
    assert r.verdict == "indeterminate" and r.cases == 2
