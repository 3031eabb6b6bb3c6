import json

import pytest

from pairwell.operators.contracts import fan_out
from pairwell.sources import files
from pairwell.streaming import rates


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 2, "skill_name": "s", "cases": [{"id": "a", "split": "tune", "success_goals": ["x"]}, {"id": "b"}]}, indent=1))
    assert [(r.skill_name, r.id, r.split) for r in files.manifest(spark, str(tmp_path)).collect()] == [("s", "a", "tune"), ("s", "b", None)]
    (tmp_path / "m.json").write_text('{"version": 3, "cases": [{"id": "a"}]}')
    with pytest.raises(Exception, match="unknown manifest version"):
        files.manifest(spark, str(tmp_path)).collect()


def test_run_folders_and_traces(spark, tmp_path):
    for run in ("c1/m1/with_skill/run-2", "c1/without_skill", "c2/old_skill/run-1"):
        (tmp_path / run).mkdir(parents=True)
        (tmp_path / run / "trace.jsonl").write_text('{"type": "item.command", "name": "ls", "status": "success"}\n\n{"type": "thread.started"}\n')
    found = files.run_files(spark, f"file://{tmp_path}", "trace.jsonl")
    got = sorted((r.case_id, r.model or "", r.variant, r.run_number) for r in found.collect())
    assert got == [("c1", "", "without_skill", 1), ("c1", "m1", "with_skill", 2), ("c2", "", "old_skill", 1)]
    events = files.trace_lines(found, "generic").filter("case_id = 'c2'").orderBy("line_number").collect()
    assert [(e.line_number, e.type, e.name, e.status) for e in events] == [(1, "command", "ls", "completed"), (3, "event", None, "unknown")]
    with pytest.raises(ValueError):
        files.trace_lines(found, "other")


def test_history_and_annotations(spark, tmp_path):
    report = spark.createDataFrame([("a", 0.5)], "case_id string, rate double")
    for n in (1, 2):
        files.append_report(report, n, f"file://{tmp_path}/h")
    assert sorted(r.ordinal for r in files.history(spark, f"file://{tmp_path}/h").collect()) == [1, 2]
    line = files.annotations(spark.createDataFrame([("k", "error", "two\nlines")], "kind string, severity string, message string")).first().line
    assert line == "::error title=k::two lines"


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", True, True), ("2024-01-01 00:06:00", "a", None, True), ("2024-01-01 05:00:00", "a", False, True)]
    df = spark.createDataFrame(rows, "ts string, agent string, triggered boolean, should_trigger boolean").selectExpr("to_timestamp(ts) AS ts", "agent", "triggered", "should_trigger")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = rates.trigger_rates(stream).writeStream.format("memory").queryName("rates").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.measured, r.passed) for r in spark.table("rates").collect()) == [(1, 0), (1, 1)]


def test_yaml_manifest_and_dataset_rows(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("version: 1\nskill_name: s\ncases:\n  - id: a\n    prompt: Say {word}\n    dataset: d.jsonl\n    split: tune\n  - {id: b, should_trigger: false}\n")
    cases = files.yaml_manifest(spark, str(tmp_path / "m.yaml"))
    assert [(r.version, r.id, r.split, r.should_trigger, r.dataset) for r in cases.orderBy("id").collect()] == [(1, "a", "tune", None, "d.jsonl"), (1, "b", None, False, None)]
    (tmp_path / "d.jsonl").write_text('{"id": 1, "word": "x"}\n{"id": 2, "word": "y"}\n')
    rows = files.dataset_rows(spark, str(tmp_path), ["d.jsonl"])
    out = fan_out(cases, rows, "dataset", "id", "prompt", "row_id", ["word"])
    assert sorted(map(tuple, out.collect())) == [("a-1", "Say x"), ("a-2", "Say y")]
    (tmp_path / "m.yaml").write_text("version: 3\ncases: []\n")
    with pytest.raises(ValueError, match="unknown manifest version"):
        files.yaml_manifest(spark, str(tmp_path / "m.yaml"))
