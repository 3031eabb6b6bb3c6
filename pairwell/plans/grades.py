"""Grading and judging over assertion results and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import grading
from pairwell.plans.registry import query
from pairwell.sources.evalviews import ASSERTIONS, RUNS, assertion_results, runs, table

STATE = "CASE WHEN skipped THEN 'skipped' WHEN passed IS NULL THEN 'unavailable' WHEN passed THEN 'satisfied' ELSE 'failed' END"


def graded_sql(severity: str) -> str:
    return f"""WITH {ASSERTIONS}, m AS (SELECT *, {STATE} AS state, {severity} AS sev FROM assertion_results),
g AS (SELECT run_id, count(*) FILTER (WHERE sev IN ('gate', 'critical') AND state IN ('satisfied', 'failed')) AS counted,
  count(*) FILTER (WHERE sev IN ('gate', 'critical') AND state = 'satisfied') AS satisfied, bool_or(sev = 'critical' AND state = 'failed') AS critical_failure,
  avg(score) FILTER (WHERE sev = 'soft' AND state IN ('satisfied', 'failed')) AS soft FROM m GROUP BY run_id)
SELECT run_id, counted, satisfied, critical_failure, CASE WHEN counted > 0 THEN CASE WHEN critical_failure THEN 0.0 ELSE satisfied / counted END END AS pass_rate,
  CASE WHEN NOT critical_failure THEN soft END AS graded_score FROM g"""


@query("grd1_state", f"WITH {ASSERTIONS} SELECT run_id, name, {STATE} AS state FROM assertion_results")
def grd1(spark, sf_dir):
    return assertion_results(spark, sf_dir).select("run_id", "name", grading.assertion_state(F.col("passed"), F.col("skipped")).alias("state"))


@query("grd2_grade", graded_sql("severity"))
def grd2(spark, sf_dir):
    return grading.grade(assertion_results(spark, sf_dir))


@query("grd4_strict", graded_sql("CASE WHEN severity = 'soft' THEN 'gate' ELSE severity END"))
def grd4(spark, sf_dir):
    return grading.grade(assertion_results(spark, sf_dir), strict=True)


@query("grd5_dependencies", f"""WITH RECURSIVE {ASSERTIONS}, needs(name, prerequisite) AS (VALUES ('a2', 'a1'), ('a3', 'a2'), ('a5', 'a3'), ('a7', 'a6')),
reach AS (SELECT * FROM needs UNION SELECT r.name, n.prerequisite FROM reach r JOIN needs n ON n.name = r.prerequisite),
hit AS (SELECT DISTINCT run_id, r.name FROM assertion_results a JOIN reach r ON a.name = r.prerequisite WHERE skipped OR NOT passed)
SELECT a.run_id, a.name, coalesce(h.name IS NOT NULL OR skipped, skipped) AS skipped FROM assertion_results a LEFT JOIN hit h ON a.run_id = h.run_id AND a.name = h.name""")
def grd5(spark, sf_dir):
    needs = spark.sql("SELECT * FROM VALUES ('a2', 'a1'), ('a3', 'a2'), ('a5', 'a3'), ('a7', 'a6') AS t(name, prerequisite)")
    return grading.skip_dependents(assertion_results(spark, sf_dir), needs).select("run_id", "name", "skipped")


TASKS = f"""{RUNS}, tasks AS (SELECT concat_ws('::', case_id, CASE WHEN model <> 'm2' THEN model END, variant, 'run-' || run_number, 'a1') AS task_id, event_id, md5(event_type) AS digest FROM runs)"""


def tasks(spark, sf_dir):
    r = runs(spark, sf_dir)
    task = grading.judge_task_id(F.col("case_id"), F.when(F.col("model") != "m2", F.col("model")), F.col("variant"), F.col("run_number"), F.lit("a1"))
    return r.select(task.alias("task_id"), "event_id", F.md5("event_type").alias("digest"))


@query("grd9_task_id", f"WITH {TASKS} SELECT task_id, event_id FROM tasks")
def grd9(spark, sf_dir):
    return tasks(spark, sf_dir).select("task_id", "event_id")


@query("grd8_merge_verdicts", f"""WITH {TASKS}, v AS (SELECT task_id, event_id % 2 = 0 AS verdict, CASE WHEN event_id % 5 = 0 THEN md5('old') ELSE digest END AS verdict_digest FROM tasks WHERE event_id % 3 > 0)
SELECT t.task_id, CASE WHEN verdict IS NULL THEN 'missing' WHEN digest = verdict_digest THEN 'merged' ELSE 'stale' END AS status FROM tasks t LEFT JOIN v USING (task_id)""")
def grd8(spark, sf_dir):
    t = tasks(spark, sf_dir)
    old = F.when(F.col("event_id") % 5 == 0, F.md5(F.lit("old"))).otherwise(F.col("digest"))
    v = t.filter("event_id % 3 > 0").select("task_id", (F.col("event_id") % 2 == 0).alias("verdict"), old.alias("verdict_digest"))
    return grading.merge_verdicts(t, v).select("task_id", "status")


@query("grd10_pending", f"WITH {TASKS} SELECT task_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE event_id % 3 > 0)")
def grd10(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return t.join(t.filter("event_id % 3 > 0").select("task_id"), "task_id", "left_anti").select("task_id")


@query("grd6_floor_flags", f"WITH {ASSERTIONS} SELECT run_id, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE score < 0.5), '') AS below FROM assertion_results GROUP BY 1")
def grd6(spark, sf_dir):
    a = assertion_results(spark, sf_dir).groupBy("run_id").agg(F.collect_list(F.when(F.col("score") < 0.5, F.col("name"))).alias("b"))
    return a.select("run_id", F.array_join(F.array_sort("b"), ", ").alias("below"))


@query("grd7_multi_turn", """WITH t AS (SELECT conv_id, turn, bool_or(length(text) > 20) AS ok FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
n AS (SELECT conv_id, count(DISTINCT turn) AS turns FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT n.conv_id, turns, count(t.turn) AS graded, coalesce(bool_and(ok), false) AND count(t.turn) >= turns AS passed FROM n LEFT JOIN t USING (conv_id) GROUP BY 1, 2""")
def grd7(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = c.filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.bool_or(F.length("text") > 20).alias("ok"))
    n = c.filter("role = 'user'").groupBy("conv_id").agg(F.countDistinct("turn").alias("turns"))
    g = n.join(t, "conv_id", "left").groupBy("conv_id", "turns").agg(F.count("turn").alias("graded"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("all_ok"))
    return g.select("conv_id", "turns", "graded", (F.col("all_ok") & (F.col("graded") >= F.col("turns"))).alias("passed"))


@query("jdg2_scored", "SELECT l_orderkey, l_linenumber, (l_quantity > 25) = (l_quantity / 50 >= 0.5) AS consistent FROM lineitem")
def jdg2(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((q > 25) == (q / 50 >= 0.5)).alias("consistent"))


@query("jdg3_dimensions", "SELECT p_partkey, CASE WHEN p_size % 6 BETWEEN 1 AND 5 THEN round(((p_size % 6 - 1) / 4 + (p_partkey % 5) / 4) / 2, 4) END AS score FROM part")
def jdg3(spark, sf_dir):
    values = F.array((F.col("p_size") % 6).cast("double"), (F.col("p_partkey") % 5 + 1).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", grading.dimensions_score(values).alias("score"))


@query("jdg4_criteria", "SELECT p_partkey, round((p_size % 4)::DOUBLE / 4, 4) AS score, p_size % 4 >= p_partkey % 6 AND p_partkey % 6 <= 4 AS passed FROM part")
def jdg4(spark, sf_dir):
    score, passed = grading.criteria_passed(F.col("p_size") % 4, F.lit(4), F.col("p_partkey") % 6)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), passed.alias("passed"))


@query("jdg5_step_minimum", "SELECT p_partkey, CAST(ceil(0.35::DECIMAL(10,6) * p_size::DECIMAL(10,0)) AS INT) AS minimum FROM part")
def jdg5(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", grading.step_minimum(F.lit(0.35), F.col("p_size")).alias("minimum"))


VOTES = "votes AS (SELECT l_orderkey AS task_id, l_quantity > 25 AS passed, l_quantity / 50 AS score FROM lineitem)"


def votes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_quantity") > 25).alias("passed"), (F.col("l_quantity") / 50).alias("score"))


@query("jdg6_consensus", f"""WITH {VOTES}, g AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE passed) AS passes, median(score) AS med FROM votes GROUP BY 1)
SELECT task_id, n, passes, CASE WHEN passes * 2 > n THEN true WHEN passes * 2 < n THEN false ELSE med >= 0.5 END AS passed, round(greatest(passes, n - passes) / n, 4) AS agreement, greatest(passes, n - passes) = n AS unanimous FROM g""")
def jdg6(spark, sf_dir):
    return grading.consensus(votes(spark, sf_dir), "task_id", 0.5)


@query("jdg6_quorum", f"""WITH {VOTES} SELECT task_id, count(*) AS n, count(*) FILTER (WHERE passed) AS passes, count(*) FILTER (WHERE passed) >= 2 AS passed,
  round(greatest(count(*) FILTER (WHERE passed), count(*) FILTER (WHERE NOT passed)) / count(*), 4) AS agreement, bool_and(passed) OR NOT bool_or(passed) AS unanimous FROM votes GROUP BY 1""")
def jdg6_quorum(spark, sf_dir):
    return grading.consensus(votes(spark, sf_dir), "task_id", 0.5, quorum=2)


@query("jdg8_incomplete_members", "SELECT l_orderkey AS task_id, bool_and(l_tax > 0) AND count(DISTINCT l_returnflag) = 1 AS ready FROM lineitem GROUP BY 1")
def jdg8(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg((F.bool_and(F.col("l_tax") > 0) & (F.countDistinct("l_returnflag") == 1)).alias("ready"))


@query("jdg9_alignment", """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn FROM labels),
d AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS po FROM c), e AS (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM d)
SELECT tp, fp, fn, tn, 0 AS unmatched, round(po, 6) AS observed_agreement, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((po - pe) / (1 - pe), 6) AS kappa, round(po, 6) AS agreement,
  CASE WHEN (po - pe) / (1 - pe) > 0.8 THEN 'almost-perfect' WHEN (po - pe) / (1 - pe) > 0.6 THEN 'substantial' WHEN (po - pe) / (1 - pe) > 0.4 THEN 'moderate'
    WHEN (po - pe) / (1 - pe) > 0.2 THEN 'fair' WHEN (po - pe) / (1 - pe) > 0 THEN 'slight' ELSE 'poor' END AS band FROM e""")
def jdg9(spark, sf_dir):
    l = table(spark, sf_dir, "labels")  # noqa: E741
    human, judge = l.select("doc_id", (F.col("quality") == 1).alias("human")), l.select("doc_id", (F.col("toxic") == 0).alias("judge"))
    return grading.alignment(human, judge, "doc_id").withColumn("band", grading.kappa_band(F.col("kappa")))


@query("jdg11_kappa_band", "SELECT c_custkey, CASE WHEN c_acctbal / 10000 > 0.8 THEN 'almost-perfect' WHEN c_acctbal / 10000 > 0.6 THEN 'substantial' WHEN c_acctbal / 10000 > 0.4 THEN 'moderate' WHEN c_acctbal / 10000 > 0.2 THEN 'fair' WHEN c_acctbal / 10000 > 0 THEN 'slight' ELSE 'poor' END AS band FROM customer")
def jdg11(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", grading.kappa_band(F.col("c_acctbal") / 10000).alias("band"))


@query("jdg12_judge_sensitivity", """WITH l AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_nationkey % 5 > 0 OR c_mktsegment <> 'BUILDING' THEN round(avg(c_acctbal) / 10000 - 0.45, 6) END AS lift FROM customer GROUP BY 1, 2)
SELECT c_nationkey, count(*) AS judges, CASE WHEN count(*) = count(lift) THEN count(DISTINCT sign(lift)) > 1 END AS sign_sensitive, CASE WHEN count(*) = count(lift) THEN max(lift) - min(lift) > 0.1 END AS magnitude_sensitive FROM l GROUP BY 1""")
def jdg12(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal") / 10000 - 0.45, 6).alias("lift"))
    shown = F.when((F.col("c_nationkey") % 5 > 0) | (F.col("c_mktsegment") != "BUILDING"), F.col("lift"))
    return grading.judge_sensitivity(c.withColumn("lift", shown), ["c_nationkey"])


@query("jdg13_order_flips", "SELECT count(*) AS tasks, count(*) FILTER (WHERE (quality = 1) = (toxic = 0)) AS consistent FROM labels")
def jdg13(spark, sf_dir):
    l = table(spark, sf_dir, "labels")  # noqa: E741
    a = l.select(F.col("doc_id").alias("task_id"), F.lit("original").alias("probe"), (F.col("quality") == 1).alias("passed"))
    b = l.select(F.col("doc_id").alias("task_id"), F.lit("flipped").alias("probe"), (F.col("toxic") == 0).alias("passed"))
    return grading.probe_flips(a.union(b))


@query("jdg14_human_labels", "SELECT d.source, count(*) AS labelled, count(*) FILTER (WHERE quality = 1) AS passed, (SELECT count(*) FROM labels) AS labels FROM documents d JOIN labels USING (doc_id) GROUP BY 1")
def jdg14(spark, sf_dir):
    l = table(spark, sf_dir, "labels")  # noqa: E741
    g = table(spark, sf_dir, "documents").select("doc_id", "source").join(l, "doc_id").groupBy("source")
    return g.agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("passed")).crossJoin(F.broadcast(l.agg(F.count("*").alias("labels"))))


@query("jdg15_scaled", "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 45 THEN (p_size - 5)::DOUBLE / 40 END AS score FROM part")
def jdg15(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", grading.scaled(F.col("p_size").cast("double"), 5, 45).alias("score"))


@query("jdg16_self_judging", f"WITH {RUNS} SELECT case_id, count(*) AS n FROM runs WHERE model = 'm' || (event_id % 5) GROUP BY 1")
def jdg16(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("judge", F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")))
    return r.filter("model = judge").groupBy("case_id").agg(F.count("*").alias("n"))
