"""Audits of suites and of their runs: the edge rows."""

from pairwell.operators import audits

CASE = (
    "suite string, id string, split string, kind string, domain string, difficulty string, success_goals array<string>, should_trigger boolean, source string, "
    "reference_answer string, reference_answer_ref string"
)


def case(suite, id="a", split="tune", kind="behavior", domain="d", difficulty="core", goals=("g",), trigger=None, source="production", answer=None, ref=None):
    return (suite, id, split, kind, domain, difficulty, None if goals is None else list(goals), trigger, source, answer, ref)


def test_findings_of_a_suite(spark):
    whole = [
        case("whole", "pos-1"), case("whole", "neg-1", "holdout"), case("whole", "x", kind="negative"), case("whole", "adv", kind="adversarial", source="synthesized"),
        case("whole", "t", kind="trigger", trigger=True, domain=None, difficulty=None, goals=()), case("whole", "u", kind="trigger", trigger=False, domain=None, goals=None),
    ]
    rows = [*whole, case("bare", domain=" ", difficulty=None, goals=(), source=None), case("made", "neg-1", source="synthesized"), case(None, None, None, None, None, None, None, None, "vibes")]
    got = {r.suite: r for r in audits.suite_audit(spark.createDataFrame(rows, CASE), ["suite"]).collect()}
    w = got["whole"]
    assert w.findings == [] and w.case_sources == {"production": 5, "synthesized": 1}
    assert (w.cases, w.positive, w.negative, w.adversarial, w.hidden, w.triggers, w.no_triggers) == (6, 1, 2, 1, 1, 1, 1)
    rest = ["missing-adversarial-evals", "missing-hidden-splits", "missing-trigger-no-trigger-cases"]
    taxonomy = ["missing-domain-taxonomy", "missing-difficulty-taxonomy", "missing-success-goals"]
    assert got["bare"].findings == [*taxonomy, "missing-negative-evals", *rest, "case-source-unrecorded"]
    assert got["made"].findings == ["missing-positive-evals", *rest, "synthesized-cases-only"]
    assert got[None].positive == 1 and got[None].findings == [*taxonomy, "missing-negative-evals", *rest, "case-source-unrecorded"] and got[None].case_sources == {}
    assert audits.suite_audit(spark.createDataFrame([], CASE), ["suite"]).count() == 0


def test_malformed_cases(spark):
    rows = [
        case("s", "fine", answer="alpha"), case("s", "h", "holdout", answer="alpha"), case("s", "private", "holdback", ref="a.md"), case("s", "t", kind="trigger", trigger=True, answer="alpha"),
        case("s", "p", kind="trigger"), case("s", "src", source="vibes"), case("s", "both", answer="alpha", ref="a.md"), case("s", "two"), case("s", "two"), case("other", "two"), case("s", "none", source=None),
        case("s", None, "dev", " "),
    ]
    got = {(r.suite, r.id): r.problems for r in audits.case_problems(spark.createDataFrame(rows, CASE), ["suite"]).collect()}
    assert got == {
        ("s", "h"): ["known answer of a held-out case is not private"], ("s", "t"): ["known answer of a trigger case"], ("s", "p"): ["trigger case without polarity"], ("s", "src"): ["unknown source"],
        ("s", "both"): ["two known answers"], ("s", "two"): ["repeated id"], ("s", None): ["blank id", "blank kind", "unknown split"],
    }


def test_what_runs_say(spark):
    row = lambda g, rate, variant="without_skill", intent="capability", missing=False: (g, rate, variant, intent, missing, True)
    rows = [row("full", 1.0)] * 3 + [row("full", 0.0, "with_skill"), row("full", 0.0, missing=True), row("full", float("nan")), row("guard", 1.0, intent="regression"), row("low", 0.94), row("quiet", 0.1)]
    runs = spark.createDataFrame(rows, "g string, rate double, variant string, intent string, missing_output boolean, execution_valid boolean")
    verdicts = spark.createDataFrame([("full", "too-few-cases-moved", 2, 1, 2), ("low", "resolvable", 0, 0, 0), ("guard", "unbounded", 0, 0, 0)], "g string, verdict string, blocked int, mismatched int, mixed int")
    got = {r.g: (r.baseline, r.findings) for r in audits.run_findings(runs, verdicts, ["g"], runs.intent == "regression").collect()}
    assert got == {
        "full": (1.0, ["suite-headroom-exhausted", "underpowered-eval", "arm-conditions-differ", "served-model-mismatch", "served-model-mixed"]),
        "guard": (None, ["underpowered-eval"]), "low": (0.94, []), "quiet": (0.1, []),
    }
