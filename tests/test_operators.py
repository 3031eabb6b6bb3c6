"""Operators on small tables: edge rows, and statistics against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.functions import text as tx
from pairwell.operators import cohorts, costs, estimates, grading, pairing, reports, traces

RUNS = "case_id string, model string, variant string, run_number int, rate double, effort string, missing_output boolean, execution_valid boolean"


def runs(spark, rows):
    return spark.createDataFrame(rows, RUNS)


def test_pairs_on_a_null_model(spark):
    rows = [("a", None, "with_skill", 1, 1.0, None, False, True), ("a", None, "without_skill", 1, 0.5, None, False, True)]
    assert [(r.status, r.reason) for r in pairing.pairs(runs(spark, rows)).collect()] == [("pair", None)]


def test_mismatched_repetition_gives_two_blocked(spark):
    rows = [("a", "m", "with_skill", 1, 1.0, "low", None, None), ("a", "m", "without_skill", 2, 0.5, "low", None, None), ("a", "m", "old_skill", 1, 0.5, "low", None, None)]
    assert sorted(r.reason for r in pairing.pairs(runs(spark, rows)).collect()) == ["missing_control", "missing_treatment"]


def test_effort_and_eligibility_in_order(spark):
    rows = [
        ("a", "m", "with_skill", 1, 1.0, "low", False, True), ("a", "m", "without_skill", 1, 1.0, "high", False, True),
        ("b", "m", "with_skill", 1, 1.0, "low", False, True), ("b", "m", "without_skill", 1, 1.0, None, False, True),
        ("c", "m", "with_skill", 1, 1.0, "low", True, True), ("c", "m", "without_skill", 1, 1.0, None, False, False),
        ("d", "m", "with_skill", 1, 1.0, "low", False, True), ("d", "m", "without_skill", 1, 1.0, None, False, False),
    ]
    got = {r.case_id: r.reason for r in pairing.pairs(runs(spark, rows)).collect()}
    assert got == {"a": "effort_mismatch", "b": "effort_unrecorded_on_one_arm", "c": "treatment_ineligible", "d": "control_ineligible"}
    assert pairing.duplicate_arms(runs(spark, rows + rows[:1])).count() == 1
    assert pairing.pairs(runs(spark, [])).count() == 0


def test_undeclared_contrast():
    assert pairing.contrast("with_skill", "ablation:x") == "ablation:x"
    with pytest.raises(ValueError):
        pairing.contrast("without_skill", "with_skill")


@pytest.mark.parametrize("rate", [-0.001, 1.001, float("nan"), float("inf")])
def test_bad_rates(spark, rate):
    rows = runs(spark, [("a", "m", "with_skill", 1, rate, None, False, True)])
    assert rows.filter(pairing.valid_rate()).count() == 0
    with pytest.raises(Exception, match="outside"):
        cohorts.mean_rate(rows, ["variant"], F.lit(True)).collect()


def test_partial_total_is_no_total(spark):
    rows = [("x", "complete", 2, "a"), ("x", "unavailable", None, "a"), ("y", "complete", 3, "a"), ("z", "complete", 3, "a"), ("z", "complete", 3, "b"), ("n", "not_applicable", None, "a")]
    df = spark.createDataFrame(rows, "g string, availability string, v long, basis string")
    got = {r.g: (r.state, r.value, r.known_subtotal) for r in cohorts.aggregate_numeric(df, ["g"], "v", ["basis"]).collect()}
    assert got == {"x": ("partial", None, 2), "y": ("complete", 3, None), "z": ("unavailable", None, None), "n": ("not_applicable", None, None)}


def brute_p(d):
    sums = [abs(sum(s * x for s, x in zip(signs, d))) for signs in itertools.product((1, -1), repeat=len(d))]
    return sum(v >= abs(sum(d)) - 1e-12 for v in sums) / len(sums)


@pytest.mark.parametrize("d", [[1.0] * 8, [0.0] * 8, [0.5, -0.5, 0.25, -0.25], [0.25, 0.5, 0.75, -0.25, 0.0, 1.0], [0.1, 0.2, -0.05]])
def test_sign_flip_against_enumeration(spark, d):
    assert estimates.exact_p(np.array(d)) == pytest.approx(brute_p(d), abs=1e-12)
    units = spark.createDataFrame([("g", x) for x in d], "g string, delta double")
    assert estimates.sign_flip_exact(units, ["g"]).first().p_value == pytest.approx(brute_p(d), abs=1e-12)


def test_sampled_p_and_interval():
    d = np.array([0.3, 0.1, -0.2, 0.4, 0.05, 0.25, -0.1, 0.2, 0.15, 0.33])
    assert estimates.sampled_p(d) == pytest.approx(brute_p(d.tolist()), abs=0.02)
    low, high, bounded = estimates.interval(d)
    assert bounded and low < d.mean() < high
    assert (low > 0 or high < 0) == (estimates.p_value(d) <= 0.05)
    assert estimates.interval(np.array([1.0, 0.5, 0.2])) == (None, None, False)
    assert estimates.interval(np.ones(20))[2] is False
    assert estimates.cases_needed(0.05) == 6


def test_pass_at_k(spark):
    rows = [(10, 3, 5, 0.916667, None), (5, 5, 5, 1.0, 1.0), (5, 0, 3, 0.0, 0.0), (3, 1, 1, 0.333333, 0.333333), (3, 1, 4, None, None), (3, 1, 0, None, None)]
    df = spark.createDataFrame([r[:3] for r in rows], "n int, c int, k int")
    n, c, k = F.col("n"), F.col("c"), F.col("k")
    got = df.select(F.round(estimates.pass_at_k(n, c, k), 6), F.round(estimates.pass_hat_k(n, c, k), 6)).collect()
    assert [g[0] for g in got] == [r[3] for r in rows]
    assert [g[1] for g, r in zip(got, rows) if r[4] is not None] == [r[4] for r in rows if r[4] is not None]


def test_text_functions(spark):
    df = spark.createDataFrame([("A​bc STRASSE", "straße", "é")], "a string, b string, c string")
    r = df.select(tx.contains(F.col("a"), F.col("b")), tx.removed(F.col("a"), "​"), tx.nfc(F.col("c")), tx.casefold(F.col("b")), tx.similarity(F.col("a"), F.col("a"))).first()
    assert tuple(r) == (True, 1, "é", "strasse", 1.0)


@pytest.mark.parametrize(
    ("text", "ok"),
    [('{"a": 1}', True), ('{"a": 1, "a": 2}', False), ("NaN", False), ("[" * 101 + "]" * 101, False), ("", False), (None, False), ('"\\ud800"', False)],
)
def test_strict_json(text, ok):
    assert (tx.parse_strict(text)[1] is None) == ok


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"enum": [1]}, "b": {"type": "array", "minItems": 2, "items": {"type": "string"}}}}
    assert tx._schema_errors({"a": 1, "b": ["x", "y"]}, schema) == []
    assert len(tx._schema_errors({"a": True, "b": [1]}, schema)) == 3
    assert tx._schema_errors([], schema) and tx._schema_errors({}, schema)


def test_regex_that_runs_out_of_time(spark):
    df = spark.createDataFrame([("a" * 60 + "!",), ("ab",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.bounded_regex(r"(a|aa)+$", 0.05)(F.col("t"))).collect()]
    assert got == [None, False, None]


def test_dependencies_are_transitive(spark):
    results = spark.createDataFrame([(1, "a", False, False), (1, "b", True, False), (1, "c", True, False), (1, "d", True, False)], "run_id int, name string, passed boolean, skipped boolean")
    needs = spark.createDataFrame([("c", "b"), ("b", "a")], "name string, prerequisite string")
    got = {r.name: r.skipped for r in grading.skip_dependents(results, needs).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}


def test_order_and_multiset(spark):
    e = spark.createDataFrame([(1, 1, "a", "completed"), (1, 2, "b", "failed"), (1, 3, "a", "completed"), (1, 4, "b", "completed")], "run_id int, index int, name string, status string")
    assert traces.in_order(e, ["a", "b"]).first().in_order and not traces.in_order(e, ["b", "a"]).first().in_order
    r = traces.call_sets(e, ["a", "b"]).first()
    assert (r.required_calls, r.call_set, r.tool_count) == (True, False, 3)
    assert traces.longest_repeat(e).first().repeated_command_max == 1


def test_kappa_bands_and_perfect_agreement(spark):
    both = spark.createDataFrame([(1, True), (2, True)], "k int, human boolean")
    r = grading.alignment(both, both.withColumnRenamed("human", "judge"), "k").first()
    assert (r.kappa, r.f1, r.agreement) == (1.0, 1.0, 1.0)
    bands = spark.createDataFrame([(0.81,), (0.8,), (0.5,), (0.3,), (0.1,), (0.0,)], "k double").select(grading.kappa_band(F.col("k"))).collect()
    assert [b[0] for b in bands] == ["almost-perfect", "substantial", "moderate", "fair", "slight", "poor"]


def test_consensus_ties(spark):
    v = spark.createDataFrame([("t", True, 0.9), ("t", False, 0.3), ("u", True, 0.9), ("u", True, 0.6), ("u", False, 0.1)], "task string, passed boolean, score double")
    got = {r.task: (r.passed, r.unanimous) for r in grading.consensus(v, "task", 0.5).collect()}
    assert got == {"t": (True, False), "u": (True, False)}


def test_containment_of_short_answers(spark):
    outputs = spark.createDataFrame([(1, "a b c d e f"), (2, ""), (3, None)], "o int, text string")
    answers = spark.createDataFrame([(1, "b c d x"), (2, "b")], "a int, text string")
    got = costs.containment(outputs, answers, 2, "o", "a", 0.1).collect()
    assert [(r.o, r.a, r.containment) for r in got] == [(1, 1, 0.666667)]


def test_cutoffs(spark):
    df = spark.createDataFrame([("2024", "2024-03"), ("2024-04", "2024-03"), ("2024-03-31", "2024-03"), ("x", "2024")], "r string, c string")
    assert [r[0] for r in df.select(costs.before_cutoff(F.col("r"), F.col("c"))).collect()] == [True, False, True, False]


def test_flags_need_both_arms(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (None, 0.5), (0.5, 0.5)], "w double, n double")
    got = [r[0] for r in df.select(reports.case_flags(F.col("w"), F.col("n"))).collect()]
    assert got == [["saturated"], ["floor", "with-skill failure"], [], ["no objective lift", "with-skill failure"]]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0


def test_dependencies_over_many_paths_and_cycles(spark):
    layers = [(f"n{i}{x}", f"n{i - 1}{y}") for i in range(1, 24) for x in "ab" for y in "ab"]  # 2 ** 23 paths
    needs = spark.createDataFrame([*layers, ("far", "n23a"), ("alone", "root"), (None, "n0a"), ("n1a", "n0a")], "name string, prerequisite string")
    results = spark.createDataFrame([(1, "n0a", False, False), (1, "far", True, False), (1, "alone", True, False), (2, "far", True, False)], "run_id int, name string, passed boolean, skipped boolean")
    got = {(r.run_id, r.name): r.skipped for r in grading.skip_dependents(results, needs).collect()}
    assert got == {(1, "n0a"): False, (1, "far"): True, (1, "alone"): False, (2, "far"): False}
    with pytest.raises(ValueError, match="cycle through a"):
        grading.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "name string, prerequisite string"))
    assert grading.closure(spark.createDataFrame([], "name string, prerequisite string")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 40, 5])  # one block, several, a shuffle of both sides
def test_containment_by_blocks_is_the_same(spark, block):
    words = [f"w{i * i % 37}" for i in range(200)]
    outputs = spark.createDataFrame([(i, " ".join(words[i : i + 60])) for i in range(0, 140, 7)], "o int, text string")
    answers = spark.createDataFrame([(i, " ".join(words[i * 9 : i * 9 + 12])) for i in range(12)] + [(99, "a b"), (100, None)], "a int, text string")
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} if t else set()
    want = {}
    for o in outputs.collect():
        for a in answers.collect():
            if (mine := grams(a.text)) and (share := len(mine & grams(o.text)) / len(mine)) >= 0.3:
                want[o.o, a.a] = round(share, 6)
    got = costs.containment(outputs, answers, 3, "o", "a", 0.3, block_grams=block)
    assert {(r.o, r.a): r.containment for r in got.collect()} == want and want
