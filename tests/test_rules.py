"""Rules on single rows: trigger rows, measurements, odd JSON, call names."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pairwell.functions import text as tx
from pairwell.operators import contracts, costs, filters, grading, measures, models, traces, triggers


def test_numbers_out_of_range_are_refused_not_fatal(spark):
    rows = spark.createDataFrame([("1e400",), ('{"a": [1, -1e999]}',), ('{"a": 1}',), (None,)], "t string")
    got = rows.select(contracts.canonical_json("t").alias("c"), tx.strict_json("t").alias("s"), tx.structured_output({"type": "object"})("t").alias("e")).collect()
    assert [r.c for r in got] == [None, None, '{"a":1}', None]
    assert [r.s.ok for r in got] == [False, False, True, False]
    assert [bool(r.e) for r in got] == [True, True, False, True]


def test_constants_are_typed_at_every_depth():
    assert tx._schema_errors({"a": 1}, {"const": {"a": True}})
    assert tx._schema_errors([1.0], {"enum": [[1]]}) and not tx._schema_errors([1], {"enum": [[1]]})


def test_call_names_keep_their_case(spark):
    e = spark.createDataFrame([(1, 1, "Read", "completed"), (1, 2, "Bash", "completed")], "run_id int, index int, name string, status string")
    r = traces.call_sets(e, ["Bash", "Read"]).first()
    assert r.required_calls and r.call_set
    assert not traces.call_sets(e, ["bash"]).first().required_calls


def test_verdict_words_are_exact(spark):
    rows = spark.createDataFrame([("good",), (" good",), ("Fail",), ("",), (None,)], "v string")
    assert [(r.judgement, r.parsed) for r in filters.judgements(rows, "v").collect()] == [("pass", True), (None, False), (None, False), (None, True), (None, True)]


def test_trigger_ids_and_errors(spark):
    text = 'say "hi" ß\n/'
    rows = [
        ("s", 1, text, True, None), ("s", 2, text, True, None), ("s", 3, text, False, None), ("s", 4, " other", True, "x"), ("s", 5, "other", True, "y"),
        ("s", 6, "new", True, "x"), ("s", 7, " ", True, "z"), ("s", 8, "q", None, "z"), ("t", 1, "other", True, "x"), ("s", 9, "w", True, "  "),
    ]
    df = spark.createDataFrame(rows, "source string, row long, query string, should_trigger boolean, query_id string")
    got = {(r.source, r.row): (r.valid_id, r.error) for r in triggers.validated(df).collect()}
    want = "query-" + hashlib.sha256(json.dumps([text, True], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert got["s", 1] == (want, None)
    assert got["s", 2] == (want, "duplicate query_id")
    assert got["s", 3][1] == got["s", 5][1] == "aliases of one query must share one id and polarity"
    assert got["s", 6][1] == "query_id identifies conflicting queries"
    assert got["s", 7][1].startswith("query must") and got["s", 8][1].startswith("should_trigger") and got["s", 9][1].startswith("query_id must")
    assert got["s", 4][1] is None and got["t", 1][1] is None


RECORD = {"runner": "r", "model": "m", "case_id": "c", "run_number": 1, "cost_normalized": {"source": "provider_reported", "total_cost": 2.5}}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"cost_normalized": {"source": "provider_reported", "total_cost": True}}, "missing_right"),
        ({"cost_normalized": {"source": "not_applicable"}}, "not_applicable"),
        ({"cost_normalized": None, "cost_usd": 1}, "legacy_unverified"),
        ({"cost_normalized": {"source": "price_table_estimated", "total_cost": 1}}, "provenance_mismatch"),
        ({"cost_normalized": {"source": "provider_reported", "total_cost": 1, "currency": "EUR"}}, "currency_mismatch"),
        ({"cost_normalized": {"source": "provider_reported", "total_cost": 1, "currency": "usd"}}, "missing_right"),
        ({"population": "judge"}, "population_mismatch"),
        ({"provider": "p"}, "basis_mismatch"),
        ({"model": None}, "basis_missing"),
        ({"run_number": 2}, "pair_key_mismatch"),
        ({"manifest_revision": "a"}, "basis_missing"),
    ],
)
def test_cost_pairs(spark, change, reason):
    texts = [(1, json.dumps(RECORD)), (2, json.dumps(RECORD | change))]
    x = spark.createDataFrame(texts, "arm int, t string").select("arm", F.lit("k").alias("k"), F.lit(True).alias("scorable"), measures.read_run(F.col("t")).alias("run"))
    x = x.select("arm", "k", "scorable", measures.cost_measure(F.col("run")).alias("cost"))
    r = measures.compare_cost(x.filter("arm = 1"), x.filter("arm = 2"), ["k"]).first()
    assert r.reason == reason and (reason is not None or r.delta == 0)
    barred = measures.compare_cost(x.filter("arm = 1"), x.filter("arm = 2").withColumn("scorable", F.lit(False)), ["k"]).first()
    assert barred.reason == "unscorable_arm"


def test_model_ids_are_parsed(spark):
    ids = ["us.anthropic.claude-sonnet-4-5-20250929-v1:0", "claude-3-5-haiku-latest", "claude-sonnet-4-0[1m]", "x/odd-1", " Claude-Opus-4-1@20250805 "]
    got = spark.createDataFrame([(i,) for i in ids], "t string").select(models.model_id(F.col("t")).alias("m")).collect()
    assert [(r.m.family, r.m.version, r.m.snapshot, r.m.latest) for r in got] == [
        ("sonnet", [4, 5], "20250929", False), ("haiku", [3, 5], None, True), ("sonnet", [4], None, False), (None, None, None, False), ("opus", [4, 1], "20250805", False),
    ]


def test_dates_are_of_the_calendar(spark):
    rows = ["2024-02-29", "2023-02-29", "2024-02-31", "2024-13", "2024-00", "2024", "2024-02", "24", "2024-1-1", "2024-04-31", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(costs.period(F.col("t"), False).alias("a"), costs.period(F.col("t"), True).alias("b")).collect()
    none = (None, None)
    assert [r[:] for r in got] == [(20240229, 20240229), none, none, none, none, (20240101, 20241231), (20240201, 20240229), none, none, none, none]


def test_task_ids_refuse_the_joint_in_a_part(spark):
    df = spark.createDataFrame([("c", None, "n"), ("c::d", "m", "n"), ("c", "m", "a:b")], "c string, m string, n string").coalesce(1)
    got = [r[0] for r in df.select(grading.judge_task_id(F.col("c"), F.col("m"), F.lit("v"), F.lit(1), F.col("n"))).collect()]
    assert got == ["c::v::run-1::n", None, "c::m::v::run-1::a:b"]
