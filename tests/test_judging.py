"""Blind comparisons, probes of a judge, stream costs, skill profiles, nested redaction: the edge rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pairwell.functions import text as tx
from pairwell.operators import blind, profiles, robustness, stream_costs

ARMS = "case_id string, model string, run_number int, variant string, scorable boolean, prompt string, output string"
ANSWER = "comparison_task_id string, comparison_task_sha256 string, schema_version int, observation_complete boolean, returncode int, winner string"


def arms(spark, *rows):
    return spark.createDataFrame(list(rows), ARMS)


def pair(case="c", model=None, run=1, outputs=("alpha", "beta"), ok=(True, True), prompts=("p", "p")):
    return [(case, model, run, v, ok[i], prompts[i], outputs[i]) for i, v in enumerate(("with_skill", "without_skill"))]


def tasks(spark, rows, seed=42):
    return blind.blind_tasks(arms(spark, *rows), "with_skill", "without_skill", seed)


def test_each_identity_is_a_task_or_has_its_reason(spark):
    rows = (
        pair("fine") + pair("fine", "m-a") + pair("fine", "m-b", 2) + pair("blank", outputs=("x", " \n")) + pair("none", outputs=(None, "x")) + pair("bad", ok=(True, False))
        + pair("unknown", ok=(None, True)) + pair("other", prompts=("p", "q")) + pair("twice") + pair("twice")[:1] + pair("left")[:1] + pair("right")[1:] + [("fine", None, 1, "old_skill", True, "p", "z")]
    )
    got = {(r.case_id, r.model, r.run_number): r for r in tasks(spark, rows).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        ("fine", None, 1): None, ("fine", "m-a", 1): None, ("fine", "m-b", 2): None, ("blank", None, 1): "blank_output", ("none", None, 1): "blank_output", ("bad", None, 1): "unscorable_arm",
        ("unknown", None, 1): "unscorable_arm", ("other", None, 1): "prompts_differ", ("twice", None, 1): "duplicate_identity", ("left", None, 1): "missing_baseline", ("right", None, 1): "missing_primary",
    }
    assert got["fine", "m-a", 1].comparison_task_id == "fine::m-a::run-1::blind-with_skill-vs-without_skill"
    assert got["fine", None, 1].comparison_task_id == "fine::run-1::blind-with_skill-vs-without_skill"
    assert all(r.comparison_task_sha256 is None and r.a_role is None for r in got.values() if r.reason)


def test_sides_digests_and_what_a_reviewer_sees(spark):
    built = tasks(spark, [x for i in range(200) for x in pair(f"ü{i}")])
    rows = built.collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        first = sha(f"42:{r.comparison_task_id}")[0] < "8"
        a, b = (sha("alpha"), sha("beta")) if first else (sha("beta"), sha("alpha"))
        assert (r.a_role, r.output_a_sha256, r.output_b_sha256) == ("primary" if first else "baseline", a, b)
        seen = {"comparison_task_id": r.comparison_task_id, "case_id": r.case_id, "model": None, "run_number": 1, "prompt_sha256": sha("p"), "output_a_sha256": a, "output_b_sha256": b}
        assert r.comparison_task_sha256 == sha(json.dumps(seen, sort_keys=True, separators=(",", ":")))
    assert 60 < sum(r.a_role == "primary" for r in rows) < 140
    assert "a_role" not in blind.reviewer_rows(built).columns and "reason" not in blind.reviewer_rows(built).columns


def test_answers_have_to_cover_the_truth_exactly(spark):
    names = ["ok", "bad", "sha", "two", "gone", "schema", "part", "nulls"]
    built = tasks(spark, [x for n in names for x in pair(n)])
    ids = {r.case_id: (r.comparison_task_id, r.comparison_task_sha256) for r in built.collect()}
    rows = [
        (*ids["ok"], 1, True, 0, " a "), (*ids["bad"], 1, True, 0, "LEFT"), (ids["sha"][0], "0" * 64, 1, True, 0, "A"), (*ids["two"], 1, True, 0, "A"), (*ids["two"], 1, True, 0, "A"),
        (*ids["schema"], 2, True, 0, "A"), (*ids["part"], 1, False, 0, "A"), (ids["nulls"][0], None, 1, None, None, None), ("odd", "x", 1, True, 0, "A"), (None, "x", 1, True, 0, "A"),
    ]
    details = blind.comparison_details(blind.truth_rows(built), spark.createDataFrame(rows, ANSWER))
    got = {r.comparison_task_id: r for r in details.collect()}
    why = {n: got[ids[n][0]].reason for n in names}
    assert why == {"ok": None, "bad": "invalid_winner", "sha": "stale_task", "two": "duplicate_result", "gone": "missing_result", "schema": "unsupported_schema", "part": "incomplete_observation", "nulls": "incomplete_observation"}
    assert (got["odd"].reason, got[None].reason) == ("unexpected_result", "missing_id")
    assert got[ids["ok"][0]].winner == "A" and got[ids["ok"][0]].winning_role == next(r.a_role for r in built.collect() if r.case_id == "ok")
    s = blind.comparison_summary(details, built).first()
    assert (s.comparison_complete, s.expected, s.refused, s.primary, s.tie) == (False, 8, 9, None, None)


def test_a_whole_comparison_has_counts_and_a_refused_identity_takes_them(spark):
    built = tasks(spark, pair("x") + pair("y"))
    rows = [(r.comparison_task_id, r.comparison_task_sha256, 1, True, 0, "A" if r.a_role == "primary" else "b") for r in built.collect()]
    details = blind.comparison_details(blind.truth_rows(built), spark.createDataFrame(rows, ANSWER))
    s = blind.comparison_summary(details, built).first()
    assert (s.comparison_complete, s.expected, s.primary, s.baseline, s.tie) == (True, 2, 2, 0, 0)
    s = blind.comparison_summary(details, tasks(spark, pair("x") + pair("y") + pair("z")[:1])).first()
    assert (s.comparison_complete, s.blocked, s.primary) == (False, 1, None)
    nothing = blind.comparison_summary(details.limit(0), built.limit(0)).first()
    assert (nothing.comparison_complete, nothing.expected, nothing.primary) == (True, 0, 0)


def probes(spark, *rows):
    calls = spark.createDataFrame(list(rows), "task_id string, probe string, passed boolean, complete boolean")
    t = robustness.probe_tasks(calls)
    return {r.task_id: r for r in t.collect()}, robustness.probe_summary(t).first()


def four(task, base, flipped, empty, master, complete=(True,) * 4):
    return list(zip([task] * 4, robustness.PROBES, (base, flipped, empty, master), complete))


@pytest.mark.parametrize(
    "calls, kinds, kept, leak",
    [
        ((True, True, False, False), [], 1.0, 0.0),
        ((True, True, True, True), ["passes-empty-control", "passes-master-key-control"], 1.0, 1.0),
        ((True, True, False, True), ["passes-master-key-control"], 1.0, 0.5),
        ((True, False, False, False), ["order-flip-inconsistent"], 0.0, 0.0),
    ],
)
def test_probes_of_a_judge(spark, calls, kinds, kept, leak):
    t, s = probes(spark, *four("j", *calls))
    assert t["j"].findings == kinds
    assert (s.n, s.availability, s.order_flip_consistency, s.control_leak_rate, s.findings) == (1, "complete", kept, leak, len(kinds))


def test_incomplete_probes_block_what_rests_on_them(spark):
    t, s = probes(spark, *four("j", False, False, False, False, (False, True, False, True)))
    assert (t["j"].order_flip_consistent, t["j"].empty_passed, t["j"].master_key_passed) == (None, None, False)
    assert t["j"].findings == ["judge-call-incomplete"] * 2 and s.availability == "partial"
    assert (s.order_flip_consistency, s.control_leak_rate) == (None, None)
    t, s = probes(spark, ("j", "base", True, True), ("j", "other", True, True), ("k", "empty", None, True))  # never made, unknown, no verdict
    assert len(t["j"].findings) == 3 and len(t["k"].findings) == 4
    t, s = probes(spark, *four("j", True, True, False, False), ("j", "empty", True, True), ("j", "flipped", False, True))  # repeated calls
    assert t["j"].findings == ["order-flip-inconsistent", "passes-empty-control"]
    empty = probes(spark, *four("j", True, True, False, False))[1].n and robustness.probe_summary(robustness.probe_tasks(spark.createDataFrame([], "task_id string, probe string, passed boolean, complete boolean"))).first()
    assert (empty.n, empty.availability, empty.control_leak_rate, empty.findings) == (0, "unavailable", None, 0)


def stream(spark, *lines, source="generic"):
    rows = [(1, source, i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(lines, 1)]
    return stream_costs.stream_usage(spark.createDataFrame(rows, "run int, source string, line_number int, line string"), ["run"]).first()


def test_deltas_add_up_and_text_is_passed_over(spark):
    end = lambda i, o, c: {"type": "message_end", "usage": {"input": i, "output": o, "totalTokens": i + o, "cost": c}}
    r = stream(spark, end(200, 50, 0.01), "not json", None, "[1]", end(100, 25, 0.005))
    assert (r.usage_source, r.input_tokens, r.total_tokens, r.cost_source, float(r.total_cost), r.currency) == ("trace_normalized", 300, 375, "trace_normalized", 0.015, "USD")
    r = stream(spark, "plain text only")
    assert (r.problem, r.usage_source, r.cost_source, r.total_tokens, r.total_cost) == (None, "missing", "missing", None, None)


def test_currencies(spark):
    r = stream(spark, {"cost": {"amount": 1, "currency": "EUR"}})
    assert (r.currency, float(r.total_cost)) == ("EUR", 1.0)
    r = stream(spark, {"cost": {"amount": 1, "currency": "EUR"}}, {"cost": 1})
    assert (r.cost_source, r.total_cost, r.currency) == ("missing", None, None)


def test_lifecycle_lines_of_one_source_count_once(spark):
    usage = {"input": 10, "output": 3, "cacheRead": 2, "totalTokens": 15, "cost": {"total": 0.015}}
    message = {"role": "assistant", "usage": usage}
    lines = [{"type": "session"}, {"type": "message_end", "message": message}, {"type": "turn_end", "message": message}, {"type": "agent_end", "messages": [message]}]
    r = stream(spark, *lines, source="pi")
    assert (r.total_tokens, float(r.total_cost)) == (15, 0.015)
    assert stream(spark, *lines).total_tokens == 30
    assert stream(spark, *lines, source="pi ").problem == "unsupported trace source" == stream(spark, *lines, source=None).problem


def test_the_last_cumulative_result_wins(spark):
    some = lambda n: {"type": "assistant", "message": {"usage": {"input_tokens": n, "output_tokens": 20}}}
    r = stream(spark, some(100), some(200), {"type": "result", "usage": {"input_tokens": 1, "output_tokens": 1}}, {"type": "result", "usage": {"input_tokens": 300, "output_tokens": 60, "total_tokens": 360}}, {"type": "result"})
    assert (r.input_tokens, r.output_tokens, r.total_tokens) == (300, 60, 360)


@pytest.mark.parametrize("bad", ['{"cost": 1e999}', '{"type":"result","usage":{"input_tokens":1e999},"total_cost_usd":NaN}', '{"a": [-Infinity]}'])
def test_numbers_that_are_not_finite_spoil_the_stream(spark, bad):
    r = stream(spark, {"cost": 0.25}, bad)
    assert r.problem == "number not finite" and r.total_cost is None and r.cost_source is None


def test_what_is_no_number_is_no_figure(spark):
    r = stream(spark, {"note": 'NaN 1e999 \\" Infinity', "usage": {"input_tokens": "7", "output_tokens": True}, "cost": "3"})
    assert (r.problem, r.usage_source, r.cost_source) == (None, "missing", "missing")
    assert stream(spark, {"cost": -1}).problem == "amount below zero"
    long = stream(spark, {"note": 'a"\\' * 200_000, "usage": {"input_tokens": 7, "output_tokens": 0}})
    assert long.total_tokens == 7


def test_profile_of_a_skill(spark):
    main = "---\nname: demo\n---\n# Demo\n" + "## Module\ntext\n" * 12 + "```\n## fenced\n```\n ## indented\n##nospace\n```\n# open to the end"
    files = [("s", "SKILL.md", main), ("s", "references/a.md", "one two three\n" * 200), ("s", "references/b.md", None), ("t", "references/x.md", "## no module"), ("u", "SKILL.md", "")]
    rows = spark.createDataFrame(files, "skill string, path string, text string")
    got = {r.skill: r for r in profiles.skill_profile(rows, "skill", "path", "text", 20, 1, 3).collect()}
    s = got["s"]
    assert (s.skill_tokens, s.references, s.reference_tokens, s.largest_reference, s.headings, s.modules) == (-(-len(main) // 4), 2, 700, 700, 13, 12)
    assert s.warnings == "skill-too-large,many-references,many-modules"
    assert (got["t"].warnings, got["t"].modules, got["u"].warnings, got["u"].skill_tokens) == ("missing-skill-file", 0, "", 0)


def test_redaction_reaches_every_string_and_no_number(spark):
    secrets = ['sk-"x"', "12345678", "ключ\n", "sk"]
    values = [
        {"a": ['sk-"x"', {"k sk": 12345678, "12345678": "a12345678b"}], "n": 1.5, "t": True, "z": None, "u": "мой ключ\nи sk-"},
        "12345678", 12345678, [], 'sk' * 50_000,
    ]

    def plain(v):
        if isinstance(v, str):
            for s in sorted(secrets, key=len, reverse=True):
                v = v.replace(s, "[REDACTED]")
            return v
        if isinstance(v, dict):
            return {plain(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(9, "sk no json 12345678"), (10, None)], "i int, t string")
    got = {r.i: r.r for r in rows.select("i", tx.redact_json(F.col("t"), secrets).alias("r")).collect()}
    assert [json.loads(got[i]) for i in range(len(values))] == [plain(v) for v in values]
    assert (got[9], got[10]) == ("[REDACTED] no json [REDACTED]", None)
