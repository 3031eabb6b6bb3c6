"""Blind comparisons, probes of a judge, stream costs, skill profiles and nested redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.functions import text as tx
from pairwell.operators import blind, profiles, robustness, stream_costs
from pairwell.plans.registry import query
from pairwell.sources.evalviews import RUNS, runs, table

#: The runs as arms of a comparison: the text of a run is its event, and the prompt its case.
TASKS = f"""{RUNS}, arms AS (SELECT *, CASE WHEN missing_output THEN ' ' ELSE event_type || ' ' || k END AS output FROM runs),
j AS (SELECT coalesce(p.case_id, b.case_id) AS case_id, coalesce(p.model, b.model) AS model, coalesce(p.run_number, b.run_number) AS run_number, sha256(coalesce(p.case_id, b.case_id)) AS prompt, sha256(p.output) AS po, sha256(b.output) AS bo,
    CASE WHEN p.case_id IS NULL THEN 'missing_primary' WHEN b.case_id IS NULL THEN 'missing_baseline' WHEN NOT (p.execution_valid AND b.execution_valid) THEN 'unscorable_arm' WHEN p.output = ' ' OR b.output = ' ' THEN 'blank_output' END AS reason
  FROM (SELECT * FROM arms WHERE variant = 'with_skill') p FULL OUTER JOIN (SELECT * FROM arms WHERE variant = 'without_skill') b ON p.case_id = b.case_id AND p.model = b.model AND p.run_number = b.run_number),
named AS (SELECT *, case_id || '::' || model || '::run-' || run_number || '::blind-with_skill-vs-without_skill' AS id FROM j),
sided AS (SELECT *, sha256('11:' || id)[1] < '8' AS first FROM named),
placed AS (SELECT *, CASE WHEN first THEN po ELSE bo END AS a, CASE WHEN first THEN bo ELSE po END AS b FROM sided),
tasks AS (SELECT case_id, model, run_number, id AS comparison_task_id, reason, CASE WHEN reason IS NULL THEN prompt END AS prompt_sha256, CASE WHEN reason IS NULL THEN CASE WHEN first THEN 'primary' ELSE 'baseline' END END AS a_role,
    CASE WHEN reason IS NULL THEN a END AS output_a_sha256, CASE WHEN reason IS NULL THEN b END AS output_b_sha256,
    CASE WHEN reason IS NULL THEN sha256('{{"case_id":"' || case_id || '","comparison_task_id":"' || id || '","model":"' || model || '","output_a_sha256":"' || a || '","output_b_sha256":"' || b || '","prompt_sha256":"' || prompt || '","run_number":' || run_number || '}}') END AS comparison_task_sha256,
    (run_number * 7 + CAST(substr(case_id, 2) AS INT)) % 50 AS q FROM placed)"""


def tasks(spark, sf_dir):
    output = F.when(F.col("missing_output"), " ").otherwise(F.concat_ws(" ", "event_type", F.col("k").cast("string")))
    arms = runs(spark, sf_dir).select("case_id", "model", "run_number", "variant", F.col("execution_valid").alias("scorable"), F.col("case_id").alias("prompt"), output.alias("output"))
    return blind.blind_tasks(arms, "with_skill", "without_skill", 11)


@query("cmp1_blind_truth", f"WITH {TASKS} SELECT * EXCLUDE (q) FROM tasks")
def cmp1(spark, sf_dir):
    return tasks(spark, sf_dir)


def answers(shown):
    """A reviewer's answers to the tasks shown, with most of the faults that an answer can have."""
    q = (F.col("run_number") * 7 + F.substring("case_id", 2, 9).cast("int")) % 50
    return shown.filter(q != 7).select(
        F.when(q == 14, F.concat(F.lit("odd-"), "comparison_task_id")).otherwise(F.col("comparison_task_id")).alias("comparison_task_id"),
        F.when(q == 11, "x").otherwise(F.col("comparison_task_sha256")).alias("comparison_task_sha256"),
        F.when(q == 13, 2).otherwise(1).alias("schema_version"),
        F.when(q != 10, True).alias("observation_complete"),
        F.when(q == 9, 1).otherwise(0).alias("returncode"),
        F.when(q == 12, "LEFT").when(q % 3 == 0, " a").when(q % 3 == 1, "B ").otherwise("Tie").alias("winner"),
        F.explode(F.sequence(F.lit(1), F.when(q == 8, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


ROLE = "CASE q % 3 WHEN 2 THEN 'tie' WHEN 0 THEN a_role ELSE CASE a_role WHEN 'primary' THEN 'baseline' ELSE 'primary' END END"


@query("cmp2_details", f"""WITH {TASKS} SELECT comparison_task_id, CASE q WHEN 7 THEN 'missing_result' WHEN 8 THEN 'duplicate_result' WHEN 9 THEN 'failed_reviewer' WHEN 10 THEN 'incomplete_observation' WHEN 11 THEN 'stale_task'
    WHEN 12 THEN 'invalid_winner' WHEN 13 THEN 'unsupported_schema' WHEN 14 THEN 'missing_result' END AS reason,
  CASE WHEN q NOT BETWEEN 7 AND 14 THEN ['A', 'B', 'TIE'][q % 3 + 1] END AS winner, CASE WHEN q NOT BETWEEN 7 AND 14 THEN {ROLE} END AS winning_role FROM tasks WHERE reason IS NULL
UNION ALL SELECT 'odd-' || comparison_task_id, 'unexpected_result', NULL, NULL FROM tasks WHERE reason IS NULL AND q = 14""")
def cmp2_details(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return blind.comparison_details(blind.truth_rows(t), answers(blind.reviewer_rows(t)))


@query("cmp2_summary", f"""WITH {TASKS} SELECT true AS comparison_complete, count(*) AS expected, 0::BIGINT AS blocked, 0::BIGINT AS refused, count(*) FILTER (WHERE {ROLE} = 'primary') AS "primary",
  count(*) FILTER (WHERE {ROLE} = 'baseline') AS baseline, count(*) FILTER (WHERE {ROLE} = 'tie') AS tie FROM tasks WHERE reason IS NULL AND q NOT BETWEEN 7 AND 14""")
def cmp2_summary(spark, sf_dir):
    q = (F.col("run_number") * 7 + F.substring("case_id", 2, 9).cast("int")) % 50
    whole = tasks(spark, sf_dir).filter(F.col("reason").isNull() & ~q.between(7, 14))  # a suite without refusals
    return blind.comparison_summary(blind.comparison_details(blind.truth_rows(whole), answers(blind.reviewer_rows(whole))), whole)


@query("jdg13_probe_tasks", """WITH c AS (SELECT l_orderkey AS task_id, l_linenumber % 4 AS probe, bool_and(l_tax > 0.01 AND l_discount < 0.1) AS whole, bool_or(l_quantity > 25) AS hi, bool_and(l_quantity > 25) AS lo FROM lineitem GROUP BY 1, 2),
t AS (SELECT DISTINCT l_orderkey AS task_id FROM lineitem),
w AS (SELECT t.task_id, coalesce(b.whole, false) AS bw, coalesce(f.whole, false) AS fw, coalesce(e.whole, false) AS ew, coalesce(m.whole, false) AS mw, b.hi = b.lo AND f.hi = f.lo AND b.hi = f.hi AS kept, e.hi AS e, m.hi AS m
  FROM t LEFT JOIN c b ON b.task_id = t.task_id AND b.probe = 1 LEFT JOIN c f ON f.task_id = t.task_id AND f.probe = 2 LEFT JOIN c e ON e.task_id = t.task_id AND e.probe = 3 LEFT JOIN c m ON m.task_id = t.task_id AND m.probe = 0)
SELECT task_id, CASE WHEN bw AND fw THEN kept END AS order_flip_consistent, CASE WHEN ew THEN e END AS empty_passed, CASE WHEN mw THEN m END AS master_key_passed,
  concat_ws(',', CASE WHEN NOT bw THEN 'judge-call-incomplete' END, CASE WHEN NOT fw THEN 'judge-call-incomplete' END, CASE WHEN NOT ew THEN 'judge-call-incomplete' END, CASE WHEN NOT mw THEN 'judge-call-incomplete' END,
    CASE WHEN bw AND fw AND NOT kept THEN 'order-flip-inconsistent' END, CASE WHEN ew AND e THEN 'passes-empty-control' END, CASE WHEN mw AND m THEN 'passes-master-key-control' END) AS findings FROM w""")
def jdg13_tasks(spark, sf_dir):
    probe = F.element_at(F.array(*map(F.lit, ("master-key", "base", "flipped", "empty"))), F.col("l_linenumber") % 4 + 1)
    passed = F.when(F.col("l_discount") < 0.1, F.col("l_quantity") > 25)
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), probe.alias("probe"), passed.alias("passed"), (F.col("l_tax") > 0.01).alias("complete"))
    return robustness.probe_tasks(calls).withColumn("findings", F.array_join("findings", ","))


@query("jdg13_probe_summary", """SELECT count(*) AS n, 'complete' AS availability, round(count(*) FILTER (WHERE (quality = 1) = (toxic = 0)) / count(*), 6) AS order_flip_consistency,
  round((count(*) FILTER (WHERE quality = 1 AND toxic = 1) + count(*) FILTER (WHERE toxic = 1)) / (2 * count(*)), 6) AS control_leak_rate,
  count(*) FILTER (WHERE (quality = 1) <> (toxic = 0)) + count(*) FILTER (WHERE quality = 1 AND toxic = 1) + count(*) FILTER (WHERE toxic = 1) AS findings FROM labels""")
def jdg13_summary(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    verdict = lambda probe, passed: F.struct(F.lit(probe).alias("probe"), passed.alias("passed"))
    each = F.explode(F.array(verdict("base", q), verdict("flipped", ~t), verdict("empty", q & t), verdict("master-key", t)))
    calls = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), each.alias("c")).select("task_id", "c.*", F.lit(True).alias("complete"))
    return robustness.probe_summary(robustness.probe_tasks(calls))


#: A stream for each user, a raw line for each event; the same text in both engines.
LINES = """SELECT user_id, event_id + 1 AS line_number, CASE WHEN user_id % 11 = 7 THEN 'pi ' WHEN user_id % 3 = 0 THEN 'pi' WHEN user_id % 3 = 1 THEN 'generic' ELSE 'claude' END AS source,
  CASE WHEN k % 20 = 3 THEN 'no json' WHEN k % 20 = 4 THEN '[1]' WHEN k = 50 AND user_id % 5 = 3 THEN '{"cost": 1e999}' WHEN k = 51 AND user_id % 5 = 3 THEN '{"usage": {"input": NaN}}' WHEN k = 52 AND user_id % 5 = 4 THEN '{"cost": -1}'
    WHEN event_type = 'purchase' AND user_id % 4 = 0 THEN '{"type": "result", "usage": {"input_tokens": ' || CAST(k AS STRING) || ', "output_tokens": 7}, "total_cost_usd": 0.' || CAST(k AS STRING) || '}'
    WHEN event_type = 'click' THEN '{"type": "message_end", "message": {"usage": {"input": ' || CAST(k AS STRING) || ', "output": 2, "totalTokens": ' || CAST(k + 3 AS STRING) || ', "cost": {"total": 0.015}}}}'
    WHEN event_type = 'view' THEN '{"type": "turn_end", "message": {"usage": {"input": ' || CAST(k AS STRING) || ', "output": 2, "totalTokens": ' || CAST(k + 3 AS STRING) || ', "cost": {"total": 0.015}}}}'
    WHEN event_type = 'signup' THEN '{"note": "NaN 1e999", "cost": {"amount": 1.25, "currency": "' || CASE WHEN user_id % 4 = 1 THEN 'EUR' ELSE 'USD' END || '"}}'
    ELSE '{"message": {"usage": {"prompt_tokens": ' || CAST(k AS STRING) || ', "completion_tokens": "5"}}}' END AS line FROM """


@query("trc6_stream_usage", f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), lines AS ({LINES} e),
o AS (SELECT *, CASE WHEN source = 'pi ' THEN 'unsupported trace source' WHEN line = '{{"cost": 1e999}}' OR line = '{{"usage": {{"input": NaN}}}}' THEN 'number not finite' WHEN line = '{{"cost": -1}}' THEN 'amount below zero' END AS problem,
  CASE WHEN line LIKE '{{%' AND line <> '{{"cost": 1e999}}' AND line <> '{{"usage": {{"input": NaN}}}}' THEN CAST(line AS JSON) END AS j FROM lines),
f AS (SELECT user_id, line_number, problem, j->>'$.type' IS NOT DISTINCT FROM 'result' AS final, NOT (source = 'pi' AND coalesce(j->>'$.type', '') = 'turn_end') AS counted,
  coalesce(j->>'$.usage.input_tokens', j->>'$.message.usage.input', j->>'$.message.usage.prompt_tokens')::BIGINT AS inp, coalesce(j->>'$.usage.output_tokens', j->>'$.message.usage.output')::BIGINT AS out,
  (j->>'$.message.usage.totalTokens')::BIGINT AS tot, coalesce(j->>'$.message.usage.cost.total', j->>'$.cost.amount', j->>'$.total_cost_usd')::DECIMAL(28,9) AS cost, coalesce(j->>'$.cost.currency', 'USD') AS currency FROM o),
c AS (SELECT user_id, line_number, problem, final, inp, out, coalesce(tot, inp + out) AS tot, cost, CASE WHEN cost IS NOT NULL THEN currency END AS currency FROM f WHERE counted
  UNION ALL SELECT user_id, line_number, problem, final, NULL, NULL, NULL, NULL, NULL FROM f WHERE NOT counted),
g AS (SELECT user_id, min(problem) AS problem, coalesce(arg_max(inp, line_number) FILTER (WHERE final), sum(inp) FILTER (WHERE NOT final))::BIGINT AS inp, coalesce(arg_max(out, line_number) FILTER (WHERE final), sum(out) FILTER (WHERE NOT final))::BIGINT AS out,
  coalesce(arg_max(tot, line_number) FILTER (WHERE final), sum(tot) FILTER (WHERE NOT final))::BIGINT AS tot, coalesce(arg_max(cost, line_number) FILTER (WHERE final), sum(cost) FILTER (WHERE NOT final)) AS cost,
  coalesce(count(DISTINCT currency) FILTER (WHERE final AND currency IS NOT NULL), 0) AS fc, count(DISTINCT currency) FILTER (WHERE NOT final) AS dc, coalesce(min(currency) FILTER (WHERE final), min(currency) FILTER (WHERE NOT final)) AS currency FROM c GROUP BY 1),
p AS (SELECT *, cost IS NOT NULL AND CASE WHEN fc > 0 THEN fc ELSE dc END = 1 AS priced FROM g)
SELECT user_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN coalesce(inp, out, tot) IS NULL THEN 'missing' ELSE 'trace_normalized' END END AS usage_source, CASE WHEN problem IS NULL THEN inp END AS input_tokens, CASE WHEN problem IS NULL THEN out END AS output_tokens,
  CASE WHEN problem IS NULL THEN tot END AS total_tokens, CASE WHEN problem IS NULL THEN CASE WHEN priced THEN 'trace_normalized' ELSE 'missing' END END AS cost_source, CASE WHEN problem IS NULL AND priced THEN cost::DECIMAL(28,9) END AS total_cost, CASE WHEN problem IS NULL AND priced THEN currency END AS currency FROM p""")
def trc6(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    table(spark, sf_dir, "events").withColumn("k", k).createOrReplaceTempView("pairwell_stream_events")
    return stream_costs.stream_usage(spark.sql(LINES + "pairwell_stream_events"), ["user_id"])


@query("cst14_skill_profile", r"""WITH f AS (SELECT conv_id, turn, replace(text, '.' || chr(10), '.' || chr(10) || '## ') AS t FROM conversations),
m AS (SELECT conv_id, turn, CAST(ceil(length(t) / 4.0) AS BIGINT) AS tokens, len(string_split(chr(10) || t, chr(10) || '## ')) - 1 AS modules FROM f),
g AS (SELECT conv_id, coalesce(sum(tokens) FILTER (WHERE turn = 0), 0)::BIGINT AS skill_tokens, count(*) FILTER (WHERE turn > 0) AS "references", coalesce(sum(tokens) FILTER (WHERE turn > 0), 0)::BIGINT AS reference_tokens,
  coalesce(max(tokens) FILTER (WHERE turn > 0), 0)::BIGINT AS largest_reference, coalesce(sum(modules) FILTER (WHERE turn = 0), 0)::BIGINT AS modules, count(*) FILTER (WHERE turn = 0) AS mains FROM m GROUP BY 1)
SELECT * EXCLUDE (mains), modules AS headings, concat_ws(',', CASE WHEN mains = 0 THEN 'missing-skill-file' END, CASE WHEN skill_tokens > 60 THEN 'skill-too-large' END, CASE WHEN "references" > 3 THEN 'many-references' END, CASE WHEN modules > 2 THEN 'many-modules' END) AS warnings FROM g""")
def cst14(spark, sf_dir):
    path = F.when(F.col("turn") == 0, profiles.MAIN).otherwise(F.concat(F.lit(profiles.REFERENCES), F.col("turn").cast("string"), F.lit(".md")))
    files = table(spark, sf_dir, "conversations").select("conv_id", path.alias("path"), F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n## ")).alias("text"))
    return profiles.skill_profile(files, "conv_id", "path", "text", 60, 3, 2)


@query("flt9_nested_redaction", """WITH r AS (SELECT *, replace(replace(replace(p_name, 'red widget', '[REDACTED]'), 'ring', '[REDACTED]'), '11', '[REDACTED]') AS n, replace(replace(p_brand, 'ring', '[REDACTED]'), '11', '[REDACTED]') AS b FROM part)
SELECT p_partkey, '{"deep":{"keys":{"' || n || '":' || p_size || '},"list":["' || b || '",' || p_size || ']},"name":"' || n || ' \\"quoted\\""}' AS redacted FROM r""")
def flt9(spark, sf_dir):
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit('{"name": "'), "p_name", F.lit(' \\u0022quoted\\"", "deep": {"list": ["'), "p_brand", F.lit('", '), size, F.lit('], "keys": {"'), "p_name", F.lit('": '), size, F.lit("}}}"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.redact_json(raw, ["ring", "11", "red widget"]).alias("redacted"))
