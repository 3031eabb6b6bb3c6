"""A stored verdict is read once a row, not once for each place that looks at it."""

from pyspark.sql import functions as F

from pairwell.operators import contracts, measures


def test_keys_are_read_once(spark):
    df = spark.createDataFrame([('{"passed": true}',), ("[1]",), (None,)], "t string")
    found = df.select(F.inline(F.array(contracts.verdict_kind(F.concat("t", F.lit(""))))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("static_invoke(JsonExpress") == 1
    assert sorted(map(str, found.collect())) == ["Row(kind='boolean', error=None)", "Row(kind=None, error='no object')", "Row(kind=None, error='no object')"]


def test_a_filter_on_a_cost_does_not_parse_again(spark):
    texts = ['{"cost_usd": 1.5, "runner": "r"}', '{"cost_usd": -1}', '{"cost_normalized": {"source": "not_applicable"}}', "{}", "{bad", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = measures.with_cost(df, F.concat("t", F.lit("")))
    plan = found.filter("cost.availability = 'available'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert found.columns == ["i", "t", "cost"]
    assert [r.cost.reason for r in found.orderBy("i").collect()] == [None, "invalid_legacy_cost", "not_applicable", "missing", "missing", "missing"]
    assert [r.i for r in found.filter("cost.availability = 'available'").collect()] == [0]
