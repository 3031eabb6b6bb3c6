"""Trace folders read by line, dialects, and run folders that are committed or not."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from pairwell.operators import artifacts, dialects
from pairwell.sources.folders import RunFolders, TraceLines


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(TraceLines)
    spark.dataSource.register(RunFolders)
    return spark


def test_lines_keep_physical_numbers(sources, tmp_path):
    (tmp_path / "c1/with_skill").mkdir(parents=True)
    (tmp_path / "c1/with_skill/trace.jsonl").write_bytes(b'{"a": 1}\r\n\n  \nbad\xff\n{"b": 2}')
    (tmp_path / "c1/empty.jsonl").write_bytes(b"")
    (tmp_path / "c1/other.txt").write_bytes(b"no")
    big = "\n".join(json.dumps({"n": i}) for i in range(100_000))
    (tmp_path / "big.jsonl").write_text(big)
    for root in (f"file://{tmp_path}", str(tmp_path)):
        got = sources.read.format("trace_lines").load(root)
        small = [tuple(r) for r in got.filter("path LIKE 'c1/%'").orderBy("line_number").collect()]
        assert small == [("c1/with_skill/trace.jsonl", 1, '{"a": 1}'), ("c1/with_skill/trace.jsonl", 4, "bad�"), ("c1/with_skill/trace.jsonl", 5, '{"b": 2}')]
        assert got.filter("path = 'big.jsonl'").agg(F.count("*"), F.max("line_number")).first()[:] == (100_000, 100_000)


def claude(*blocks, role="assistant"):
    return json.dumps({"type": role, "message": {"content": list(blocks)}})


def use(call, name="Read", given=None):
    return {"type": "tool_use", "id": call, "name": name, "input": {} if given is None else given}


def done(call, **more):
    return {"type": "tool_result", "tool_use_id": call, **more}


def calls(spark, lines, dialect="claude"):
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines, 1)], "trace string, line_number long, line string")
    actions = dialects.trace_actions(df, ["trace"], F.lit(dialect))
    problems = [r.problem for r in actions.filter("phase = 'bad'").orderBy("line_number", "place").collect()]
    return {r.call_id: (r.name, r.opened_line, r.closed_line, r.status, r.problem) for r in dialects.trace_calls(actions, ["trace"]).collect()}, problems


def test_claude_calls(spark):
    got, problems = calls(spark, [
        claude(use("a"), use("b", "Write")), claude(done("a"), role="user"), claude(use("same", "Read")), claude(use("same", "Write")), claude(done("same"), role="user"),
        claude(done("missing"), role="user"), claude(use("f", "Bash")), claude(done("f", is_error=True), done("f"), role="user"), '{"type": "result", "is_error": false}', "{bad", "",
    ])
    assert got == {
        "a": ("Read", 1, 2, "completed", None), "b": ("Write", 1, None, "in_progress", None), "same": ("Read", 3, 5, "completed", "opened twice"),
        "missing": (None, None, None, "unknown", "unmatched close"), "f": ("Bash", 7, 8, "failed", "closed twice"),
    }
    assert problems == ["invalid JSON", "invalid JSON"]


def test_malformed_fields_are_rows_in_order(spark):
    _, problems = calls(spark, [
        json.dumps({"type": "assistant", "message": {"content": {"type": "tool_use"}}}),
        claude(use(1), use("x", ""), use("y", given=[])), claude(done("x", is_error="false"), role="user"),
    ])
    assert problems == [
        "message content must be a string or list", "tool_use id must be a non-empty string", "tool_use name must be a non-empty string",
        "tool_use input must be an object", "tool_result is_error must be boolean",
    ]


@pytest.mark.parametrize("dialect", ["unknown", "pi ", " vibes", "", None])
def test_unknown_dialects_are_rows(spark, dialect):
    df = spark.createDataFrame([("t", 1, "{}", dialect)], "trace string, line_number long, line string, d string")
    assert [r.problem for r in dialects.trace_actions(df, ["trace"], F.col("d")).collect()] == ["unknown dialect"]


def test_other_dialects(spark):
    got, problems = calls(spark, ['{"type":"tool_use","tool_id":"g","tool_name":"n","parameters":{}}', '{"type":"tool_result","tool_id":"g","status":"odd"}', '{"type":"tool_result","tool_id":"g","status":"error"}'], "gemini")
    assert got == {"g": ("n", 1, 3, "failed", None)} and problems == ["tool_result status must be success or error"]
    got, _ = calls(spark, ['{"type":"item.started","item":{"id":"i","command":"ls"}}', '{"type":"item.completed","item":{"id":"i","command":"ls","exit_code":1}}'], "codex")
    assert got == {"i": ("ls", 1, 2, "failed", None)}
    got, _ = calls(spark, ['{"role":"assistant","tool_calls":[{"id":"v","function":{"name":"f"}}]}', '{"role":"tool","tool_call_id":"v"}'], "vibe")
    assert got == {"v": ("f", 1, 2, "completed", None)}
    got, _ = calls(spark, ['{"id":"j","name":"x","status":"running"}'], "JETTY")
    assert got == {"j": ("x", 1, None, "in_progress", None)}


FILES = ("output.md", "events.json", "metrics.json", "metadata.json", "extra/é.txt")


def states(spark, root):
    """The state of each run folder by what lies on the disk."""
    files, runs = [], []
    for run in sorted(os.listdir(root)):
        for top, _, names in os.walk(f"{root}/{run}"):
            files += [(run, os.path.relpath(f"{top}/{n}", f"{root}/{run}"), hashlib.sha256(open(f"{top}/{n}", "rb").read()).hexdigest()) for n in names if not n.endswith(".part")]
        at = f"{root}/{run}/artifact-commit.json"
        runs.append((run, 1, open(at).read() if os.path.exists(at) else None))
    found = artifacts.artifact_states(
        spark.createDataFrame(runs, "run string, declared int, marker string"), spark.createDataFrame(files, "run string, path string, sha string"), "run", "declared", "marker", "path", "sha"
    )
    return {r.run: r.state for r in found.collect()}


def test_commit_writes_the_inventory_last(sources, tmp_path):
    rows = [(f"r{i}", name, f"{i} {name}".encode()) for i in range(5) for name in FILES if (i, name) != (3, "events.json")]
    df = sources.createDataFrame(rows, "run string, path string, content binary").repartition(7)
    df.write.format("run_folders").mode("append").save(f"file://{tmp_path}")
    assert states(sources, tmp_path) == {"r0": "complete", "r1": "complete", "r2": "complete", "r3": "missing_commit", "r4": "complete"}
    (tmp_path / "r1/output.md").write_text("changed")
    (tmp_path / "r2/new.txt").write_text("new")
    assert {k: v for k, v in states(sources, tmp_path).items() if k in ("r1", "r2")} == {"r1": "incomplete", "r2": "incomplete"}


@pytest.mark.parametrize("bad", [("r0", "../../x"), ("r0", "artifact-commit.json"), (None, "output.md"), ("r0", "output.md")])
def test_a_failed_job_commits_nothing(sources, tmp_path, bad):
    rows = [("r0", name, b"x") for name in FILES] + [(*bad, b"y")]
    df = sources.createDataFrame(rows, "run string, path string, content binary").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017
        df.write.format("run_folders").mode("append").save(f"file://{tmp_path}")
    assert states(sources, tmp_path) == {"r0": "missing_commit"} and not os.path.exists(tmp_path.parent.parent / "x")
