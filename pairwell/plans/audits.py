"""Audits of suites: documents as cases, labels as their kinds; runs as what was measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import audits, estimates, pairing
from pairwell.plans.core import OK, PAIRS
from pairwell.plans.registry import query
from pairwell.sources.evalviews import runs, table

#: A suite for each source and language, a case for each document; the same text in both engines.
CASES = """SELECT d.source || '-' || d.lang AS suite, CASE WHEN l.quality = 0 THEN 'neg-' ELSE 'c-' END || CAST(CASE WHEN d.n_chars % 211 = 7 THEN d.n_chars ELSE -d.doc_id END AS STRING) AS id,
  CASE WHEN d.n_chars % 97 = 5 THEN 'dev' WHEN d.n_chars > 4000 THEN 'holdout' WHEN d.n_chars > 3500 THEN 'holdback' ELSE 'tune' END AS split, CASE WHEN l.toxic = 1 THEN 'adversarial' WHEN l.quality IS NULL AND d.n_chars % 3 = 0 THEN 'trigger' WHEN d.n_chars % 89 = 3 THEN ' ' ELSE 'behavior' END AS kind,
  CASE WHEN d.n_chars % 500 <> 1 THEN d.lang END AS domain, CASE WHEN d.n_chars < 100 THEN ' ' WHEN d.n_chars < 2000 THEN 'core' ELSE 'extended' END AS difficulty, d.n_chars % 700 <> 2 AS has_goals,
  CASE WHEN d.n_chars % 6 < 4 THEN d.n_chars % 2 = 0 END AS should_trigger, CASE WHEN l.quality IS NULL THEN 'production' WHEN l.toxic = 1 THEN 'bug-report' WHEN d.n_chars % 101 = 9 THEN 'vibes' WHEN d.n_chars % 103 = 9 THEN NULL ELSE 'synthesized' END AS source,
  CASE WHEN d.n_chars % 5 = 0 THEN 'x' END AS reference_answer, CASE WHEN d.n_chars % 35 = 0 THEN 'a.md' END AS reference_answer_ref FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def cases(spark, sf_dir):
    for name in ("documents", "labels"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"pairwell_{name}")
    rows = spark.sql(CASES.replace("FROM documents", "FROM pairwell_documents").replace("JOIN labels", "JOIN pairwell_labels"))
    return rows.withColumn("success_goals", F.when(F.col("has_goals"), F.array(F.lit("done"))).otherwise(F.array().cast("array<string>")))


@query("fnd6_suite_audit", f"""WITH c AS ({CASES}), p AS (SELECT *, kind = 'trigger' AS t, CASE WHEN kind = 'trigger' THEN 't' WHEN id LIKE 'neg-%' THEN 'n' WHEN kind = 'adversarial' THEN 'a' ELSE 'p' END AS pol,
  CASE WHEN source IN ('production', 'bug-report', 'hand-written', 'synthesized', 'imported') THEN source END AS src FROM c),
g AS (SELECT suite, count(*) AS cases, count(*) FILTER (WHERE pol = 'p') AS positive, count(*) FILTER (WHERE pol = 'n') AS negative, count(*) FILTER (WHERE pol = 'a') AS adversarial, count(*) FILTER (WHERE split LIKE 'hold%') AS hidden,
  count(*) FILTER (WHERE t AND should_trigger) AS triggers, count(*) FILTER (WHERE t AND NOT should_trigger) AS no_triggers, bool_or(NOT t AND domain IS NULL) AS d, bool_or(NOT t AND difficulty = ' ') AS f, bool_or(NOT t AND NOT has_goals) AS o,
  bool_or(src IS NULL) AS u, bool_and(coalesce(src = 'synthesized', false)) AS y FROM p GROUP BY 1),
s AS (SELECT suite, string_agg(src || '=' || n, ',' ORDER BY src) AS case_sources FROM (SELECT suite, src, count(*) AS n FROM p WHERE src IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT g.suite, cases, positive, negative, adversarial, hidden, triggers, no_triggers, coalesce(case_sources, '') AS case_sources, concat_ws(',', CASE WHEN d THEN 'missing-domain-taxonomy' END, CASE WHEN f THEN 'missing-difficulty-taxonomy' END, CASE WHEN o THEN 'missing-success-goals' END,
  CASE WHEN positive = 0 THEN 'missing-positive-evals' END, CASE WHEN negative = 0 THEN 'missing-negative-evals' END, CASE WHEN adversarial = 0 THEN 'missing-adversarial-evals' END, CASE WHEN hidden = 0 THEN 'missing-hidden-splits' END,
  CASE WHEN triggers * no_triggers = 0 THEN 'missing-trigger-no-trigger-cases' END, CASE WHEN u THEN 'case-source-unrecorded' END, CASE WHEN y THEN 'synthesized-cases-only' END) AS findings FROM g LEFT JOIN s ON g.suite IS NOT DISTINCT FROM s.suite""")
def fnd6(spark, sf_dir):
    a = audits.suite_audit(cases(spark, sf_dir), ["suite"])
    sources = F.array_join(F.array_sort(F.transform(F.map_entries("case_sources"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))), ",")
    return a.withColumn("case_sources", sources).withColumn("findings", F.array_join("findings", ","))


@query("fnd6_case_problems", f"""WITH c AS ({CASES}), p AS (SELECT *, count(*) OVER (PARTITION BY suite, id) AS copies FROM c),
w AS (SELECT suite, id, concat_ws('; ', CASE WHEN copies > 1 THEN 'repeated id' END, CASE WHEN kind = ' ' THEN 'blank kind' END, CASE WHEN split = 'dev' THEN 'unknown split' END, CASE WHEN source = 'vibes' THEN 'unknown source' END,
  CASE WHEN kind = 'trigger' AND should_trigger IS NULL THEN 'trigger case without polarity' END, CASE WHEN kind = 'trigger' AND coalesce(reference_answer, reference_answer_ref) IS NOT NULL THEN 'known answer of a trigger case' END,
  CASE WHEN split IN ('holdout', 'holdback') AND reference_answer IS NOT NULL THEN 'known answer of a held-out case is not private' END, CASE WHEN reference_answer IS NOT NULL AND reference_answer_ref IS NOT NULL THEN 'two known answers' END) AS problems FROM p)
SELECT * FROM w WHERE problems <> ''""")
def fnd6_problems(spark, sf_dir):
    return audits.case_problems(cases(spark, sf_dir), ["suite"]).withColumn("problems", F.array_join("problems", "; "))


@query("fnd7_run_findings", f"""WITH {PAIRS}, b AS (SELECT case_id, model, avg(rate) FILTER (WHERE {OK} AND variant = 'without_skill' AND k % 4 > 0) AS baseline, count(*) FILTER (WHERE event_type = 'error') AS mismatched, count(*) FILTER (WHERE missing_output) AS mixed FROM runs GROUP BY 1, 2),
p AS (SELECT case_id, model, count(*) FILTER (WHERE reason LIKE 'effort%') AS blocked, count(*) FILTER (WHERE reason IS NULL) AS n, count(*) FILTER (WHERE reason IS NULL AND treatment_rate <> control_rate) AS moved,
  max(treatment_rate - control_rate) FILTER (WHERE reason IS NULL) - min(treatment_rate - control_rate) FILTER (WHERE reason IS NULL) AS half, 1 - avg(control_rate) FILTER (WHERE reason IS NULL) AS headroom FROM paired GROUP BY 1, 2)
SELECT b.case_id, b.model, round(baseline, 9) AS baseline, concat_ws(',', CASE WHEN baseline >= 0.95 THEN 'suite-headroom-exhausted' END,
  CASE WHEN NOT (n > 0 AND moved >= 6 AND half IS NOT NULL AND half <= headroom AND half <= 0.5) THEN 'underpowered-eval' END, CASE WHEN blocked > 0 THEN 'arm-conditions-differ' END,
  CASE WHEN mismatched > 3 THEN 'served-model-mismatch' END, CASE WHEN mixed > 0 THEN 'served-model-mixed' END) AS findings FROM b LEFT JOIN p ON b.case_id = p.case_id AND b.model = p.model""")
def fnd7(spark, sf_dir):
    r, by = runs(spark, sf_dir), ["case_id", "model"]
    ok, delta = F.col("reason").isNull(), F.when(F.col("reason").isNull(), F.col("treatment_rate") - F.col("control_rate"))
    p = pairing.pairs(r).groupBy(*by).agg(
        F.count_if(F.startswith("reason", F.lit("effort"))).alias("blocked"), F.count_if(ok).alias("n"), F.count_if(delta != 0).alias("moved"),
        (F.max(delta) - F.min(delta)).alias("half"), (1 - F.avg(F.when(ok, F.col("control_rate")))).alias("headroom"),
    )
    verdict = estimates.noise_verdict(F.col("n"), F.col("moved"), F.col("half"), F.col("headroom"), F.lit(0.5))
    conditions = r.groupBy(*by).agg(F.greatest(F.count_if(F.col("event_type") == "error") - 3, F.lit(0)).alias("mismatched"), F.count_if("missing_output").alias("mixed"))
    verdicts = p.select(*by, "blocked", verdict.alias("verdict")).join(conditions, by)
    return audits.run_findings(r, verdicts, by, F.col("k") % 4 == 0).withColumn("findings", F.array_join("findings", ","))
