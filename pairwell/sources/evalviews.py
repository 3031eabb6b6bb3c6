"""Evaluation relations derived from the driver's tables, in Spark and as DuckDB CTEs.

runs: one row per (case_id, model, variant, run_number). Rates are multiples of
one quarter, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = e.select(
        F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("case_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(F.col("event_id") % 2 == 0, "with_skill").otherwise("without_skill").alias("variant"),
        F.least(F.lit(1.0), F.floor(F.col("value") / 25) / 4.0).alias("rate"),
        (F.col("event_type") != "error").alias("execution_valid"),
        ((F.col("event_type") == "signup") & (k % 25 == 0)).alias("missing_output"),
        F.when(k % 20 == 0, "low").when(k % 20 != 1, "high").alias("effort"),
        "event_id",
        "user_id",
        "event_type",
        "ts",
        k.alias("k"),
        "value",
    )
    order = Window.partitionBy("case_id", "model", "variant").orderBy("ts", "event_id")
    return base.withColumn("run_number", F.row_number().over(order))


RUNS = """
runs AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, model, variant ORDER BY ts, event_id)::INT AS run_number FROM (
    SELECT 'c' || (user_id % 40) AS case_id, 'm' || (user_id % 3) AS model,
      CASE WHEN event_id % 2 = 0 THEN 'with_skill' ELSE 'without_skill' END AS variant,
      least(1.0::DOUBLE, floor(value / 25) / 4) AS rate, event_type <> 'error' AS execution_valid,
      event_type = 'signup' AND k % 25 = 0 AS missing_output,
      CASE WHEN k % 20 = 0 THEN 'low' WHEN k % 20 <> 1 THEN 'high' END AS effort,
      event_id, user_id, event_type, ts, k, value
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)))"""

#: Half-open sources for verdict and telemetry operators.
MEASUREMENTS = """
measurements AS (
  SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN l_tax = 0 THEN 'not_applicable' WHEN l_discount = 0 THEN 'unavailable' ELSE 'complete' END AS availability,
    CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END AS currency,
    CASE WHEN l_returnflag = 'R' THEN 'with_skill' WHEN l_returnflag = 'A' THEN 'without_skill' ELSE 'old_skill' END AS variant,
    'c' || (l_suppkey % 20) AS case_id, CAST(l_quantity AS BIGINT) AS tokens
  FROM lineitem)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telemetry value per line item; only `complete` ones may carry their number."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("l_tax") == 0, "not_applicable").when(F.col("l_discount") == 0, "unavailable").otherwise("complete").alias("availability"),
        F.when(F.col("l_linestatus") == "F", "USD").otherwise("EUR").alias("currency"),
        F.when(F.col("l_returnflag") == "R", "with_skill").when(F.col("l_returnflag") == "A", "without_skill").otherwise("old_skill").alias("variant"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 20).cast("string")).alias("case_id"),
        F.col("l_quantity").cast("bigint").alias("tokens"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events: a run per user, a name per event type, ordered by time."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "command")
        .when(F.col("event_type") == "view", "file_read")
        .when(F.col("event_type") == "purchase", "file_write")
        .when(F.col("event_type") == "signup", "skill_load")
        .otherwise("tool_call")
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("run_id"),
        F.row_number().over(order).alias("index"),
        kind.alias("type"),
        F.concat(F.lit("cmd"), (k % 7).cast("string")).alias("name"),
        F.when(k % 10 == 0, "started").when(k % 10 == 1, "failed").otherwise("completed").alias("status"),
        F.floor("value").cast("bigint").alias("duration_ms"),
        k.alias("k"),
    )


TRACE = """
trace AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS index,
    CASE event_type WHEN 'click' THEN 'command' WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'file_write'
      WHEN 'signup' THEN 'skill_load' ELSE 'tool_call' END AS type,
    'cmd' || (k % 7) AS name,
    CASE WHEN k % 10 = 0 THEN 'started' WHEN k % 10 = 1 THEN 'failed' ELSE 'completed' END AS status,
    CAST(floor(value) AS BIGINT) AS duration_ms, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def assertion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded assertions: a run per order, an assertion per line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_linenumber").alias("ordinal"),
        F.when(F.col("l_tax") != 0.08, F.col("l_quantity") > 10).alias("passed"),
        (F.col("l_discount") == 0.1).alias("skipped"),
        F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "soft").otherwise("gate").alias("severity"),
        F.when(F.col("l_returnflag") == "A", F.floor(F.col("l_quantity") / 13) / 4.0).alias("score"),
    )


ASSERTIONS = """
assertion_results AS (
  SELECT l_orderkey AS run_id, 'a' || l_linenumber AS name, l_linenumber AS ordinal,
    CASE WHEN l_tax <> 0.08 THEN l_quantity > 10 END AS passed, l_discount = 0.1 AS skipped,
    CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'soft' ELSE 'gate' END AS severity,
    CASE WHEN l_returnflag = 'A' THEN floor(l_quantity / 13) / 4 END AS score
  FROM lineitem)"""
