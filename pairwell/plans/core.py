"""Filters, pairing, cohorts, estimates and reliability over the runs relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import cohorts, estimates, pairing
from pairwell.plans.registry import query
from pairwell.sources.evalviews import MEASUREMENTS, RUNS, measurements, runs

OK = "(NOT coalesce(missing_output, false) AND coalesce(execution_valid, true))"

PAIRS = f"""{RUNS}, arms AS (SELECT *, {OK} AS ok FROM runs),
paired AS (SELECT coalesce(l.case_id, r.case_id) AS case_id, coalesce(l.model, r.model) AS model,
  coalesce(l.run_number, r.run_number) AS run_number, l.rate AS treatment_rate, l.effort AS treatment_effort,
  r.rate AS control_rate, r.effort AS control_effort,
  CASE WHEN l.case_id IS NULL THEN 'missing_treatment' WHEN r.case_id IS NULL THEN 'missing_control'
    WHEN NOT l.ok THEN 'treatment_ineligible' WHEN NOT r.ok THEN 'control_ineligible'
    WHEN l.effort IS NULL AND r.effort IS NULL THEN NULL
    WHEN l.effort IS NULL OR r.effort IS NULL THEN 'effort_unrecorded_on_one_arm'
    WHEN l.effort <> r.effort THEN 'effort_mismatch' END AS reason
  FROM (SELECT * FROM arms WHERE variant = 'with_skill') l FULL OUTER JOIN (SELECT * FROM arms WHERE variant = 'without_skill') r
  ON l.case_id = r.case_id AND l.model IS NOT DISTINCT FROM r.model AND l.run_number = r.run_number)"""

UNITS = f"""{PAIRS}, units AS (SELECT case_id, model, count(*) AS pairs, avg(treatment_rate) AS with_rate,
  avg(control_rate) AS without_rate, avg(treatment_rate) - avg(control_rate) AS delta
  FROM paired WHERE reason IS NULL GROUP BY ALL)"""


def units(spark, sf_dir):
    return estimates.unit_deltas(pairing.pairs(runs(spark, sf_dir)), ["case_id", "model"])


@query("flt1_scorable", f"WITH {RUNS} SELECT event_id, {OK} AS scorable FROM runs")
def flt1(spark, sf_dir):
    return runs(spark, sf_dir).select("event_id", pairing.scorable().alias("scorable"))


@query("flt6_where", f"WITH {RUNS} SELECT event_id, case_id, rate FROM runs WHERE variant = 'with_skill' AND model = 'm1' AND {OK}")
def flt6(spark, sf_dir):
    kept = runs(spark, sf_dir).filter("variant = 'with_skill' AND model = 'm1'").filter(pairing.scorable())
    return kept.select("event_id", "case_id", "rate")


@query("pair1_construct", f"WITH {PAIRS} SELECT *, CASE WHEN reason IS NULL THEN 'pair' ELSE 'blocked' END AS status FROM paired")
def pair1(spark, sf_dir):
    return pairing.pairs(runs(spark, sf_dir))


@query("pair2_duplicate_arms", "SELECT user_id % 40 AS case_id, event_type AS variant, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1")
def pair2(spark, sf_dir):
    from pairwell.sources.evalviews import table

    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("case_id"), F.col("event_type").alias("variant"))
    return pairing.duplicate_arms(rows, key=["case_id"])


@query("pair3_effort_reason", f"""WITH {RUNS}, x AS (SELECT event_id, effort, lead(effort) OVER (PARTITION BY user_id ORDER BY event_id) AS other FROM runs)
SELECT event_id, CASE WHEN effort IS NULL AND other IS NULL THEN NULL WHEN effort IS NULL OR other IS NULL
  THEN 'effort_unrecorded_on_one_arm' WHEN effort <> other THEN 'effort_mismatch' END AS reason FROM x""")
def pair3(spark, sf_dir):
    x = runs(spark, sf_dir).selectExpr("event_id", "effort", "lead(effort) OVER (PARTITION BY user_id ORDER BY event_id) AS other")
    return x.select("event_id", pairing.effort_reason(F.col("effort"), F.col("other")).alias("reason"))


@query("pair4_not_applicable", f"""WITH {RUNS}, arms AS (SELECT *, {OK} AS ok, case_id IN ('c0', 'c1') AS na FROM runs)
SELECT CASE WHEN l.na AND r.na THEN 'not_applicable' WHEN l.case_id IS NULL THEN 'missing_treatment' WHEN r.case_id IS NULL THEN 'missing_control'
  WHEN NOT l.ok THEN 'treatment_ineligible' WHEN NOT r.ok THEN 'control_ineligible' END AS reason, count(*) AS identities
FROM (SELECT * FROM arms WHERE variant = 'with_skill') l FULL OUTER JOIN (SELECT * FROM arms WHERE variant = 'without_skill') r
  ON l.case_id = r.case_id AND l.model = r.model AND l.run_number = r.run_number GROUP BY ALL""")
def pair4(spark, sf_dir):
    paired = pairing.pairs(runs(spark, sf_dir), not_applicable=F.col("case_id").isin("c0", "c1"), payload=["rate"])
    return pairing.diagnostics(paired).select("reason", "identities")


@query("pair5_diagnostics", f"WITH {PAIRS} SELECT CASE WHEN reason IS NULL THEN 'pair' ELSE 'blocked' END AS status, reason, count(*) AS identities FROM paired GROUP BY ALL")
def pair5(spark, sf_dir):
    return pairing.diagnostics(pairing.pairs(runs(spark, sf_dir)))


@query("pair7_mismatched_repetition", f"""WITH {RUNS}, shifted AS (SELECT variant, case_id, model,
  CASE WHEN variant = 'with_skill' AND case_id = 'c5' THEN run_number + 1000000 ELSE run_number END AS n FROM runs)
SELECT coalesce(l.case_id, r.case_id) AS case_id, CASE WHEN l.n IS NULL THEN 'missing_treatment' WHEN r.n IS NULL THEN 'missing_control' END AS reason, count(*) AS identities
FROM (SELECT * FROM shifted WHERE variant = 'with_skill') l FULL OUTER JOIN (SELECT * FROM shifted WHERE variant = 'without_skill') r
  ON l.case_id = r.case_id AND l.model = r.model AND l.n = r.n GROUP BY ALL""")
def pair7(spark, sf_dir):
    moved = F.when((F.col("variant") == "with_skill") & (F.col("case_id") == "c5"), F.col("run_number") + 1_000_000).otherwise(F.col("run_number"))
    rows = runs(spark, sf_dir).withColumn("run_number", moved)
    paired = pairing.pairs(rows, eligible=F.lit(True), payload=["rate"])
    return paired.groupBy("case_id", "reason").agg(F.count("*").alias("identities"))


@query("agg1_report_cohort", f"""WITH {RUNS} SELECT variant, count(*) AS attempted, count(*) FILTER (WHERE {OK}) AS runs, count(*) FILTER (WHERE NOT {OK}) AS blocked,
  coalesce(string_agg(DISTINCT CASE WHEN {OK} THEN NULL WHEN missing_output THEN 'missing_output' ELSE 'execution_error' END, ', ' ORDER BY CASE WHEN {OK} THEN NULL WHEN missing_output THEN 'missing_output' ELSE 'execution_error' END), '') AS reason,
  CASE WHEN count(*) FILTER (WHERE NOT {OK}) > 0 THEN 'partial' ELSE 'complete' END AS availability FROM runs GROUP BY variant""")
def agg1(spark, sf_dir):
    why = F.when(F.col("missing_output"), "missing_output").otherwise("execution_error")
    return cohorts.cohort(runs(spark, sf_dir), ["variant"], pairing.scorable(), why)


@query("agg2_metric_cohort", f"""WITH {RUNS}, m AS (SELECT case_id, CASE WHEN NOT {OK} THEN 'ineligible' WHEN model = 'm2' THEN 'na' WHEN effort IS NULL THEN 'missing' ELSE 'ok' END AS s, k FROM runs),
g AS (SELECT case_id, count(*) FILTER (WHERE s = 'ok') AS observed, count(*) FILTER (WHERE s IN ('ineligible', 'missing')) AS unavailable,
  count(*) FILTER (WHERE s = 'na') AS not_applicable, avg(k) FILTER (WHERE s = 'ok') AS observed_mean FROM m GROUP BY case_id)
SELECT *, CASE WHEN observed + unavailable + not_applicable = 0 THEN 'empty' WHEN observed + unavailable = 0 THEN 'not_applicable'
  WHEN unavailable > 0 THEN CASE WHEN observed > 0 THEN 'partial' ELSE 'unavailable' END ELSE 'complete' END AS state,
  CASE WHEN unavailable = 0 AND observed > 0 THEN observed_mean END AS mean FROM g""")
def agg2(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("k", F.when(F.col("effort").isNotNull(), F.col("k").cast("double")))
    return cohorts.metric_cohort(rows, ["case_id"], "k", pairing.scorable(), F.col("model") != "m2")


@query("agg5_aggregate_numeric", f"""WITH {MEASUREMENTS}, g AS (SELECT case_id, count(*) FILTER (WHERE availability = 'complete') AS observed,
  count(*) FILTER (WHERE availability = 'unavailable') AS unavailable, count(*) FILTER (WHERE availability = 'not_applicable') AS not_applicable,
  count(DISTINCT currency) FILTER (WHERE availability = 'complete') AS bases, CAST(sum(tokens) FILTER (WHERE availability = 'complete') AS BIGINT) AS known FROM measurements GROUP BY case_id),
s AS (SELECT *, CASE WHEN bases > 1 THEN 'unavailable' WHEN observed + unavailable = 0 THEN 'not_applicable' WHEN unavailable > 0 THEN CASE WHEN observed > 0 THEN 'partial' ELSE 'unavailable' END ELSE 'complete' END AS state FROM g)
SELECT case_id, observed, unavailable, not_applicable, bases, state, CASE WHEN bases > 1 THEN 'basis_mismatch' END AS reason,
  CASE WHEN state = 'complete' THEN known END AS value, CASE WHEN state = 'partial' THEN known END AS known_subtotal FROM s""")
def agg5(spark, sf_dir):
    return cohorts.aggregate_numeric(measurements(spark, sf_dir), ["case_id"], "tokens", ["currency"])


@query("agg6_money_by_currency", f"""WITH {MEASUREMENTS}, miss AS (SELECT variant, count(*) FILTER (WHERE availability = 'unavailable') AS unavailable FROM measurements GROUP BY 1),
known AS (SELECT variant, currency, count(*) AS observed, sum(amount) AS known FROM measurements WHERE availability = 'complete' GROUP BY 1, 2)
SELECT m.variant, coalesce(currency, 'unknown') AS currency, unavailable, coalesce(observed, 0) AS observed,
  CAST(CASE WHEN unavailable = 0 THEN known END AS DECIMAL(28,2)) AS value, CAST(CASE WHEN unavailable > 0 THEN known END AS DECIMAL(28,2)) AS known_subtotal
FROM miss m LEFT JOIN known k ON m.variant = k.variant""")
def agg6(spark, sf_dir):
    return cohorts.aggregate_money(measurements(spark, sf_dir), ["variant"])


@query("agg7_mean_rate", f"WITH {RUNS} SELECT case_id, variant, count(*) AS n, avg(rate) AS mean_rate FROM runs WHERE {OK} GROUP BY 1, 2")
def agg7(spark, sf_dir):
    return cohorts.mean_rate(runs(spark, sf_dir), ["case_id", "variant"], pairing.scorable())


@query("agg9_variant_summary", f"""WITH {RUNS} SELECT variant, count(*) FILTER (WHERE {OK}) AS n, count(*) FILTER (WHERE NOT {OK}) AS execution_errors, avg(rate) FILTER (WHERE {OK}) AS mean_rate,
  round(avg(k) FILTER (WHERE {OK}), 6) AS k_mean, round(median(k::DOUBLE) FILTER (WHERE {OK}), 6) AS k_median, round(quantile_cont(k::DOUBLE, 0.9) FILTER (WHERE {OK}), 6) AS k_p90 FROM runs GROUP BY variant""")
def agg9(spark, sf_dir):
    return cohorts.variant_summary(runs(spark, sf_dir), pairing.scorable(), ["k"])


#: Attributes of a case: two plain ones, a trigger type that some lack, and goals of which a case has none, one or two.
@query("agg10_slices", f"""WITH {UNITS}, n AS (SELECT *, CAST(substr(case_id, 2) AS INT) AS n FROM units), s AS (
  SELECT delta, 'domain' AS kind, CAST(n % 4 AS VARCHAR) AS value FROM n UNION ALL SELECT delta, 'difficulty', CAST(n % 3 AS VARCHAR) FROM n
  UNION ALL SELECT delta, 'trigger_type', CASE n % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'implicit' ELSE 'unspecified' END FROM n
  UNION ALL SELECT delta, 'success_goals', 'g' || (n % 5) FROM n WHERE n % 7 > 0 UNION ALL SELECT delta, 'success_goals', 'g' || (n % 2) FROM n WHERE n % 7 > 0 AND n % 5 <> n % 2)
SELECT kind, value, count(*) AS units, round(avg(delta), 9) AS lift, round(round(avg(delta), 9) / (SELECT round(avg(delta), 9) FROM n), 6) AS lift_concentration FROM s GROUP BY 1, 2""")
def agg10(spark, sf_dir):
    n = F.substring("case_id", 2, 9).cast("int")
    goal = lambda k: F.concat(F.lit("g"), (n % k).cast("string"))
    s = units(spark, sf_dir).withColumns({
        "domain": n % 4, "difficulty": n % 3, "trigger_type": F.when(n % 3 == 0, "explicit").when(n % 3 == 1, "implicit"),
        "success_goals": F.when(n % 7 > 0, F.array(goal(5), goal(2))).otherwise(F.array().cast("array<string>")),
    })
    return cohorts.slices(s, ["domain", "difficulty", "trigger_type"], ["success_goals"])


@query("agg12_run_endings", f"WITH {RUNS} SELECT variant, coalesce(effort, 'unrecorded') AS ending, count(*) AS runs FROM runs GROUP BY 1, 2")
def agg12(spark, sf_dir):
    return cohorts.run_endings(runs(spark, sf_dir), "effort")


@query("agg13_visibility", f"WITH {RUNS} SELECT variant, round(avg(rate) FILTER (WHERE CAST(substr(case_id, 2) AS INT) % 5 = 0), 9) AS held_out_rate, round(avg(rate) FILTER (WHERE CAST(substr(case_id, 2) AS INT) % 5 <> 0), 9) AS tune_rate FROM runs WHERE {OK} GROUP BY 1")
def agg13(spark, sf_dir):
    hidden = F.substring("case_id", 2, 9).cast("int") % 5 == 0
    return runs(spark, sf_dir).filter(pairing.scorable()).groupBy("variant").agg(
        F.round(F.avg(F.when(hidden, F.col("rate"))), 9).alias("held_out_rate"), F.round(F.avg(F.when(~hidden, F.col("rate"))), 9).alias("tune_rate")
    )


TRIGGERS = f"""{RUNS}, t AS (SELECT 'a' || (user_id % 4) AS agent, model, case_id AS query_id, event_id % 2 = 0 AS should_trigger,
  CASE WHEN NOT (event_type = 'error' AND user_id % 4 = 0) THEN value > 120 END AS triggered FROM runs)"""


def triggers(spark, sf_dir):
    return runs(spark, sf_dir).select(
        F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("agent"),
        "model",
        F.col("case_id").alias("query_id"),
        (F.col("event_id") % 2 == 0).alias("should_trigger"),
        F.when(~((F.col("event_type") == "error") & (F.col("user_id") % 4 == 0)), F.col("value") > 120).alias("triggered"),
    )


@query("agg14_trigger_cohort", f"""WITH {TRIGGERS}, g AS (SELECT agent, model, count(*) AS observations, count(triggered) AS measured, count(*) FILTER (WHERE triggered = should_trigger) AS passed FROM t GROUP BY 1, 2)
SELECT *, CASE WHEN measured < observations THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN measured = observations THEN passed / observations END AS pass_rate FROM g""")
def agg14(spark, sf_dir):
    return cohorts.trigger_cohort(triggers(spark, sf_dir), ["agent", "model"])


@query("agg15_trigger_matrix", f"""WITH {TRIGGERS} SELECT agent, model, should_trigger, query_id, CAST(grouping(agent, model, should_trigger, query_id) AS INT) AS level, count(*) AS observations,
  count(triggered) AS measured, count(*) FILTER (WHERE triggered = should_trigger) AS passed FROM t GROUP BY GROUPING SETS ((agent, model), (agent, model, should_trigger), (agent, model, query_id))""")
def agg15(spark, sf_dir):
    return cohorts.trigger_matrix(triggers(spark, sf_dir))


@query("trg5_polarity", f"WITH {TRIGGERS} SELECT should_trigger, triggered = should_trigger AS passed, count(*) AS n FROM t GROUP BY 1, 2")
def trg5(spark, sf_dir):
    return triggers(spark, sf_dir).groupBy("should_trigger", (F.col("triggered") == F.col("should_trigger")).alias("passed")).agg(F.count("*").alias("n"))


@query("est1_unit_deltas", f"WITH {UNITS} SELECT * FROM units")
def est1(spark, sf_dir):
    return units(spark, sf_dir)


@query("est2_summary", f"""WITH {UNITS}, g AS (SELECT model, count(*) AS units, round(avg(with_rate), 9) AS with_rate, round(avg(without_rate), 9) AS without_rate, round(avg(delta), 9) AS observed_delta, count(*) FILTER (WHERE delta < 0) AS negative_delta_units FROM units GROUP BY model)
SELECT *, CAST(NULL AS DOUBLE) AS absolute_delta, CASE WHEN with_rate >= without_rate AND without_rate < 1 THEN round((with_rate - without_rate) / (1 - without_rate), 6) END AS normalized_gain FROM g""")
def est2(spark, sf_dir):
    return estimates.summary(units(spark, sf_dir), ["model"], blocked=1)


@query("est3_sign_flip", f"""WITH RECURSIVE {UNITS}, d AS (SELECT model, CAST(round(delta * 4) AS INT) AS step, row_number() OVER (PARTITION BY model ORDER BY case_id) AS i FROM units),
dp AS (SELECT DISTINCT model, 0::BIGINT AS i, 0 AS s, 1.0::DOUBLE AS p FROM d
  UNION ALL SELECT dp.model, dp.i + 1, dp.s + g.sign * d.step, sum(dp.p) / 2 FROM dp JOIN d ON d.model = dp.model AND d.i = dp.i + 1 CROSS JOIN (VALUES (1), (-1)) g(sign) GROUP BY 1, 2, 3),
w AS (SELECT model, count(*) AS units, abs(sum(step)) AS whole FROM d GROUP BY 1)
SELECT w.model, w.units, round(sum(dp.p) FILTER (WHERE abs(dp.s) >= whole), 9) AS p_value FROM w JOIN dp ON dp.model = w.model AND dp.i = w.units GROUP BY 1, 2""")
def est3(spark, sf_dir):
    quarters = units(spark, sf_dir).select("model", (F.round(F.col("delta") * 4) / 4).alias("delta"))
    return estimates.sign_flip(quarters, ["model"], ends=False).select("model", "units", F.round("p_value", 9).alias("p_value"))


def signs_sql(before: str, source: str, by: str) -> str:
    """SQL for test and interval of quarter deltas: sums of signed deltas and of signs by recursion, and as ends the last shifts that are not rejected."""
    return f"""WITH RECURSIVE {before}, d AS (SELECT {by}, CAST(round(delta * 4) AS INT) AS step, row_number() OVER (PARTITION BY {by} ORDER BY delta) AS i FROM {source} WHERE delta IS NOT NULL),
dp AS (SELECT DISTINCT {by}, 0::BIGINT AS i, 0 AS s, 0 AS b, 1.0::DOUBLE AS p FROM d
  UNION ALL SELECT dp.{by}, dp.i + 1, dp.s + g.sign * d.step, dp.b + g.sign, sum(dp.p) / 2 FROM dp JOIN d ON d.{by} = dp.{by} AND d.i = dp.i + 1 CROSS JOIN (VALUES (1), (-1)) g(sign) GROUP BY 1, 2, 3, 4),
w AS (SELECT {by}, count(*) AS n, sum(step)::INT AS s, count(*) >= 6 AND min(step) < max(step) AS bounded FROM d GROUP BY 1),
cells AS (SELECT dp.{by}, dp.s, dp.b, dp.p FROM dp JOIN w ON dp.{by} = w.{by} AND dp.i = w.n),
shifts AS (SELECT {by}, (w.s - c.s)::DOUBLE / (w.n - c.b) AS t FROM cells c JOIN w USING ({by}) WHERE bounded AND w.n <> c.b UNION SELECT {by}, (w.s + c.s)::DOUBLE / (w.n + c.b) FROM cells c JOIN w USING ({by}) WHERE bounded AND w.n <> -c.b),
kept AS (SELECT t.{by}, t.t FROM shifts t JOIN cells c ON c.{by} = t.{by} JOIN w ON w.{by} = t.{by} WHERE abs(c.s - t.t * c.b) >= abs(w.s - t.t * w.n) - 1e-9 GROUP BY 1, 2 HAVING sum(c.p) > 0.05),
ends AS (SELECT {by}, min(t) / 4 AS low, max(t) / 4 AS high FROM kept GROUP BY 1),
zero AS (SELECT c.{by}, sum(c.p) FILTER (WHERE abs(c.s) >= abs(w.s)) AS p FROM cells c JOIN w USING ({by}) GROUP BY 1)
SELECT w.{by}, w.n AS units, round(w.s / 4 / w.n, 9) AS mean, round(zero.p, 9) AS p_value, round(low, 5) AS low, round(high, 5) AS high, bounded FROM w JOIN zero USING ({by}) LEFT JOIN ends USING ({by})"""


def signs(deltas, by):
    """The same with the operator, of deltas in quarters."""
    found = estimates.sign_flip(deltas.select(by, (F.round(F.col("delta") * 4) / 4).alias("delta")), [by])
    return found.select(by, "units", F.round("mean", 9).alias("mean"), F.round("p_value", 9).alias("p_value"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "bounded")


@query("est5_interval", signs_sql(UNITS, "units", "model"))
def est5(spark, sf_dir):
    return signs(units(spark, sf_dir), "model")


@query("est6_smallest_p", "SELECT c_custkey, least(1.0, 2.0 / pow(2, c_custkey % 20)) AS p FROM customer")
def est6(spark, sf_dir):
    from pairwell.sources.evalviews import table

    return table(spark, sf_dir, "customer").select("c_custkey", estimates.smallest_achievable_p(F.col("c_custkey") % 20).alias("p"))


@query("est7_noise_verdict", f"""WITH {UNITS}, g AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE delta <> 0) * 3 AS moved, round(max(delta) - min(delta), 9) AS half, 1 - round(avg(without_rate), 9) AS headroom FROM units GROUP BY case_id)
SELECT case_id, CASE WHEN n = 0 THEN 'no-data' WHEN moved < 6 THEN 'too-few-cases-moved' WHEN half IS NULL THEN 'unbounded' WHEN half > headroom THEN 'noise-exceeds-headroom' WHEN half > 0.2 THEN 'noise-exceeds-min-lift' ELSE 'resolvable' END AS verdict,
  CAST(ceil(n * pow(half / 0.05, 2.0)) AS BIGINT) AS projected_cases FROM g""")
def est7(spark, sf_dir):
    g = units(spark, sf_dir).groupBy("case_id").agg(
        F.count("*").alias("n"),
        (F.count_if(F.col("delta") != 0) * 3).alias("moved"),
        F.round(F.max("delta") - F.min("delta"), 9).alias("half"),
        (1 - F.round(F.avg("without_rate"), 9)).alias("headroom"),
    )
    verdict = estimates.noise_verdict(F.col("n"), F.col("moved"), F.col("half"), F.col("headroom"), F.lit(0.2))
    return g.select("case_id", verdict.alias("verdict"), estimates.projected_cases(F.col("n"), F.col("half"), F.lit(0.05)).alias("projected_cases"))


@query("est8_extreme", f"WITH {RUNS} SELECT event_id, CASE WHEN rate >= 1 - 1e-9 AND k >= 50 THEN 'ceiling' WHEN rate <= 1e-9 AND k < 50 THEN 'floor' END AS kind FROM runs")
def est8(spark, sf_dir):
    other = F.when(F.col("k") >= 50, 1.0).otherwise(0.0)
    return runs(spark, sf_dir).select("event_id", estimates.extreme(F.col("rate"), other).alias("kind"))


@query("est10_model_analysis", f"""WITH {UNITS}, m AS (SELECT model, round(avg(delta), 9) AS lift FROM units GROUP BY 1)
SELECT model, lift, CAST(rank() OVER (ORDER BY lift DESC) AS INT) AS rank, lift <= 0 AND (SELECT avg(delta) FROM units) > 0 AS lift_loser FROM m""")
def est10(spark, sf_dir):
    from pyspark.sql.window import Window

    u = units(spark, sf_dir)
    pooled = u.agg(F.avg("delta").alias("pooled"))
    m = u.groupBy("model").agg(F.round(F.avg("delta"), 9).alias("lift"))  # a row per model
    ranked = m.withColumn("rank", F.rank().over(Window.orderBy(F.desc("lift"))))
    return ranked.crossJoin(F.broadcast(pooled)).select("model", "lift", "rank", ((F.col("lift") <= 0) & (F.col("pooled") > 0)).alias("lift_loser"))


REL = f"""{RUNS}, g AS (SELECT case_id, model, variant, count(*)::INT AS n, (count(*) FILTER (WHERE rate = 1))::INT AS c FROM runs WHERE {OK} GROUP BY ALL),
e AS (SELECT *, unnest(range(1, n + 1))::INT AS k FROM g),
rel AS (SELECT *, round(1 - list_product(list_transform(range(0, k), lambda i: greatest(n - c - i, 0)::DOUBLE / (n - i))), 6) AS pass_at_k,
  round(list_product(list_transform(range(0, k), lambda i: greatest(c - i, 0)::DOUBLE / (n - i))), 6) AS pass_hat_k FROM e)"""


def rel(spark, sf_dir, most=None):
    return estimates.reliability(runs(spark, sf_dir).filter(pairing.scorable()), ["case_id", "model", "variant"], most)


@query("rel3_reliability", f"WITH {REL} SELECT * FROM rel")
def rel3(spark, sf_dir):
    return rel(spark, sf_dir)


@query("rel4_by_variant", f"""WITH {REL} SELECT variant, round(avg(pass_at_k) FILTER (WHERE k = 1), 6) AS mean_pass_at_1, round(avg(CASE WHEN n = c THEN 1.0 ELSE 0.0 END) FILTER (WHERE k = 1), 6) AS all_runs_pass_rate FROM rel GROUP BY variant""")
def rel4(spark, sf_dir):
    first = rel(spark, sf_dir, 1)
    return first.groupBy("variant").agg(
        F.round(F.avg("pass_at_k"), 6).alias("mean_pass_at_1"), F.round(F.avg(F.when(F.col("n") == F.col("c"), 1.0).otherwise(0.0)), 6).alias("all_runs_pass_rate")
    )


@query("rel5_paired_lift", f"""WITH {REL} SELECT w.case_id || '@' || w.model AS unit, w.k, round(w.pass_at_k - o.pass_at_k, 6) AS lift FROM rel w JOIN rel o
  ON w.case_id = o.case_id AND w.model = o.model AND w.k = o.k WHERE w.variant = 'with_skill' AND o.variant = 'without_skill'""")
def rel5(spark, sf_dir):
    r = rel(spark, sf_dir).select("case_id", "model", "variant", "k", "pass_at_k")
    w = r.filter("variant = 'with_skill'").drop("variant")
    o = r.filter("variant = 'without_skill'").drop("variant").withColumnRenamed("pass_at_k", "other")
    return w.join(o, ["case_id", "model", "k"]).select(
        F.concat_ws("@", "case_id", "model").alias("unit"), "k", F.round(F.col("pass_at_k") - F.col("other"), 6).alias("lift")
    )
