"""Report history, markdown and run folders on the disk: the edge rows."""

import pytest

from pairwell.sources import files
from pairwell.sources.folders import RunFolders, write_runs


def test_a_history_is_append_only(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    report = spark.createDataFrame([("a", 1)], "k string, n int")
    for ordinal in (3, 1):
        files.append_report(report, ordinal, path)
    with pytest.raises(ValueError, match="has a report 3"):
        files.append_report(report, 3, path)
    assert sorted(r.ordinal for r in files.history(spark, path).collect()) == [1, 3]


def test_markdown(spark):
    rows = spark.createDataFrame([("g", "a|b\nc", None), ("h", "x", 2)], "g string, t string, n int")
    got = sorted((r.g, r.place, r.line) for r in files.markdown(rows, ["t", "n"], ["g"]).collect())
    head = ["| t | n |", "| --- | --- |"]
    assert got == [("g", 0, head[0]), ("g", 1, head[1]), ("g", 2, "| a\\|b<br>c | - |"), ("h", 0, head[0]), ("h", 1, head[1]), ("h", 2, "| x | 2 |")]
    assert sorted((r.place, r.line) for r in files.markdown(rows.limit(0), ["t", "n"]).collect()) == [(0, head[0]), (1, head[1])]


def test_states_of_run_folders_on_the_disk(spark, tmp_path):
    spark.dataSource.register(RunFolders)
    places = ("c 1/with_skill/run-2", "é/m/ablation:x", "c/old_skill", "c/without_skill/run-1")
    names = ("output.md", "events.json", "metrics.json", "metadata.json", "deep/with_skill/run-9/é.txt")
    rows = [(p, n, f"{p} {n}".encode()) for p in places for n in names]
    spark.createDataFrame(rows, "run string, path string, content binary").repartition(3).write.format("run_folders").mode("append").save(f"file://{tmp_path}")
    (tmp_path / "c/old_skill/output.md").write_text("changed")
    (tmp_path / "c/without_skill/run-1/artifact-commit.json").unlink()
    (tmp_path / "stray.txt").write_text("no run")
    got = {r.run: (r.files, r.state) for r in files.run_folder_states(spark, f"file://{tmp_path}").collect()}
    assert got == {places[0]: (6, "complete"), places[1]: (6, "complete"), places[2]: (6, "incomplete"), places[3]: (5, "missing_commit")}


def sent_to_driver(spark):
    """Bytes of all task results so far, as Spark counts them."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).resultSize() for i in range(stages.size()))


def test_a_commit_sends_no_digests_to_the_driver(spark, tmp_path):
    """The bytes sent do not follow the number of files, nor are they in the listing."""
    names = ("output.md", "events.json", "metrics.json", "metadata.json")
    sent = []
    for runs in (20, 400):
        root = f"file://{tmp_path}/{runs}"
        rows = spark.range(runs, numPartitions=2).selectExpr("concat('c', id, '/with_skill') AS run", f"explode(array{names}) AS path", "encode(CAST(id AS STRING), 'UTF-8') AS content")
        before = sent_to_driver(spark)
        write_runs(rows, root)
        states = files.run_folder_states(spark, root)
        assert states.filter("state = 'complete' AND files = 5").count() == runs
        sent.append(sent_to_driver(spark) - before)
    assert sent[1] < sent[0] * 1.3


@pytest.mark.parametrize("bad", [("r/with_skill", "../../x"), ("r/with_skill", "artifact-commit.json"), (None, "output.md"), ("r/with_skill", "output.md")])
def test_a_failed_job_of_many_commits_nothing(spark, tmp_path, bad):
    rows = [("r/with_skill", n, b"x") for n in ("output.md", "events.json", "metrics.json", "metadata.json")] + [(*bad, b"y")]
    with pytest.raises(Exception):  # noqa: B017
        write_runs(spark.createDataFrame(rows, "run string, path string, content binary").repartition(3), f"file://{tmp_path}")
    assert not list(tmp_path.rglob("artifact-commit.json")) and not (tmp_path.parent / "x").exists()
