"""Verdict kinds, canonical JSON, dataset fan-out, known answers and event states."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import contracts, estimates, provider_streams, traces
from pairwell.plans.registry import query
from pairwell.plans.reporting import FINDINGS, findings
from pairwell.sources import files
from pairwell.sources.evalviews import TRACE, table, trace

#: A stored verdict for each line item, the same text in both engines.
RAW = """CASE WHEN l_orderkey % 41 = 0 THEN '[1]' ELSE '{' || concat_ws(', ', CASE WHEN l_tax > 0.01 THEN '"passed": true' END,
  CASE WHEN l_quantity > 40 THEN '"score": null' WHEN l_quantity > 20 THEN '"score": 0.5' END, CASE WHEN l_discount > 0.05 THEN '"threshold": 0.4' END,
  CASE WHEN l_linenumber IN (2, 7) THEN '"dimension_scores": {"a": 3}' END, CASE WHEN l_linenumber IN (3, 7) THEN '"criteria": []' END,
  CASE WHEN l_linenumber = 3 THEN '"minimum_criteria": 1' END, CASE WHEN l_orderkey % 13 = 0 THEN '"judge_model": "consensus"' END,
  CASE WHEN l_orderkey % 17 = 0 THEN '"judge_panel": []' END,
  CASE l_orderkey % 19 WHEN 0 THEN '"verdict_kind": "scored"' WHEN 1 THEN '"verdict_kind": "boolean"' WHEN 2 THEN '"verdict_kind": "odd"' END) || '}' END"""


@query("jdg1_verdict_kind", f"""WITH r AS (SELECT l_orderkey, l_linenumber, {RAW} AS raw FROM lineitem),
f AS (SELECT *, raw = '[1]' AS no_object, CASE WHEN raw <> '[1]' THEN json_keys(raw) ELSE [] END AS keys, raw->>'$.verdict_kind' AS stated, (raw->>'$.score') IS NOT NULL AS scored FROM r),
k AS (SELECT *, coalesce(stated, CASE WHEN (raw->>'$.judge_model') = 'consensus' OR list_contains(keys, 'judge_panel') THEN 'consensus' WHEN list_contains(keys, 'dimension_scores') THEN 'dimensions'
  WHEN list_contains(keys, 'criteria') THEN 'dynamic' WHEN scored THEN 'scored' WHEN list_contains(keys, 'passed') THEN 'boolean' END) AS guess FROM f),
a AS (SELECT *, CASE guess WHEN 'boolean' THEN ['passed'] WHEN 'scored' THEN ['passed', 'score', 'threshold'] WHEN 'dimensions' THEN ['passed', 'score', 'threshold', 'dimension_scores']
  WHEN 'dynamic' THEN ['passed', 'score', 'criteria', 'minimum_criteria'] ELSE ['passed', 'score'] END AS allowed FROM k),
g AS (SELECT *, list_filter(['criteria', 'dimension_scores', 'minimum_criteria', 'passed', 'score', 'threshold'],
  lambda x: list_contains(keys, x) AND NOT (x = 'score' AND NOT scored) AND NOT (x = 'threshold' AND coalesce(guess, '') = 'boolean' AND NOT scored) AND NOT list_contains(allowed, x)) AS alien FROM a),
e AS (SELECT *, CASE WHEN no_object THEN 'no object' WHEN stated NOT IN ('boolean', 'scored', 'dimensions', 'dynamic', 'consensus') THEN 'unknown kind: ' || stated
  WHEN list_contains(keys, 'dimension_scores') AND list_contains(keys, 'criteria') THEN 'dimensions and criteria' WHEN guess IS NULL THEN 'no payload'
  WHEN len(alien) > 0 THEN 'foreign fields: ' || array_to_string(alien, ', ') END AS error FROM g)
SELECT l_orderkey, l_linenumber, CASE WHEN error IS NULL THEN guess END AS kind, error FROM e""")
def jdg1(spark, sf_dir):
    found = contracts.verdict_kind(F.expr(RAW))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.array(found)))  # a generator is evaluated once a row


@query("dig2_canonical_digest", """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN sha256('{"a":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE '[1,2.5]' END || ',"name":"' || c_name || '","z":{"k":' || c_custkey || '}}') END AS digest FROM customer""")
def dig2(spark, sf_dir):
    raw = F.expr("""CASE WHEN c_custkey % 7 = 0 THEN '{"a": 1, "a": 2}' ELSE concat('{ "z" : {"k": ', c_custkey, '},\n "name": "', c_name, '", "a":', CASE WHEN c_custkey % 2 = 0 THEN ' true' ELSE ' [ 1, 2.50 ]' END, '}') END""")
    return table(spark, sf_dir, "customer").select("c_custkey", contracts.json_digest(raw).alias("digest"))


@query("src7_strict_equality", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 4 THEN true WHEN 5 THEN NULL ELSE false END AS equal FROM part")
def src7(spark, sf_dir):
    k = F.col("p_partkey") % 6
    left = F.when(k == 4, '{"a": 1, "b": [1.0]}').when(k == 3, '"1"').otherwise("1")
    right = F.when(k == 0, " 1 ").when(k == 1, "true").when(k == 2, "1.0").when(k == 3, "1").when(k == 4, '{"b":[1.0],"a":1}').otherwise("NaN")
    return table(spark, sf_dir, "part").select("p_partkey", contracts.strictly_equal(left, right).alias("equal"))


@query("src3_fan_out", r"""SELECT 'case' || n_nationkey || '-' || s_suppkey AS id, 'Nation ' || n_name || ' buys from ' || s_name || ' of ' || s_nationkey || ' {output_dir} \d{2,4}' AS prompt
FROM nation JOIN supplier ON n_regionkey = s_nationkey % 5""")
def src3_fan_out(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    template = F.concat(F.lit("Nation "), "n_name", F.lit(" buys from {s_name} of {s_nationkey} {output_dir} \\d{2,4}"))
    cases = n.select(F.col("n_regionkey").alias("dataset"), F.concat(F.lit("case"), F.col("n_nationkey").cast("string")).alias("case_id"), template.alias("template"))
    rows = table(spark, sf_dir, "supplier").withColumn("dataset", F.col("s_nationkey") % 5)
    return contracts.fan_out(cases, rows, "dataset", "case_id", "template", "s_suppkey", ["s_name", "s_nationkey"])


@query("lek3_known_answer", "SELECT doc_id, CASE WHEN NOT (contains(lower(text), 'the') AND contains(lower(text), 'of ')) THEN 'reference-answer-fails' WHEN contains(lower(source), 'the') AND contains(lower(source), 'of ') OR doc_id % 9 = 0 THEN 'null-answer-passes' ELSE 'ok' END AS finding FROM documents")
def lek3(spark, sf_dir):
    prompt = F.when(F.col("doc_id") % 9 == 0, F.col("text")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", contracts.known_answer(F.col("text"), prompt, ["The", "of "]).alias("finding"))


@query("trc1_state_words", f"""WITH {TRACE}, s AS (SELECT run_id, index, k % 32 AS n FROM trace)
SELECT run_id, index, CASE WHEN n < 6 THEN 'completed' WHEN n < 11 THEN 'in_progress' WHEN n < 19 THEN 'failed' WHEN n IN (19, 20) THEN 'unknown' WHEN n IN (21, 22) THEN 'completed' WHEN n = 23 THEN 'in_progress' ELSE 'unknown' END AS state,
  CASE WHEN n < 19 THEN 'provider_status' WHEN n BETWEEN 21 AND 23 THEN 'provider_event_kind' ELSE 'unknown' END AS source FROM s""")
def trc1_state_words(spark, sf_dir):
    """Every status word, an odd and a blank status that is there, and events that only their kind tells of."""
    words = "completed complete succeeded success done finished in_progress started running pending queued failed failure error errored cancelled canceled timed_out timeout odd".split()
    n = F.col("k") % 32
    status = F.get(F.array(*map(F.lit, words)), n)
    kind = F.when(n.isin(20, 21), " Result ").when(n == 22, "tool_execution_end").when(n == 23, "agent_start").otherwise("message")
    found = traces.state_and_source(F.concat(F.lit(" "), F.upper(status)), kind, present=n <= 20)
    return trace(spark, sf_dir).select("run_id", "index", found.alias("f")).select("run_id", "index", "f.state", "f.source")


@query("prc5_call_count", f"WITH {TRACE} SELECT run_id, count(*) FILTER (WHERE status = 'completed' AND name IN ('cmd1', 'cmd4')) BETWEEN 10 AND 15 AS calls_ok FROM trace GROUP BY 1")
def prc5(spark, sf_dir):
    return traces.calls_between(trace(spark, sf_dir), "^cmd[14]$", 10, 15)


@query("est13_note", """SELECT a AS alpha, 'p <= ' || a || ' needs at least ' || CAST(ceil(log2(2 / a)) AS INT) || ' cases that move the same way (the smallest reachable p with ' || CAST(ceil(log2(2 / a)) AS INT) || ' is ' || (2 / pow(2, ceil(log2(2 / a)))) || '); more repetitions sharpen each case''s rate but do not add cases' AS note
FROM (VALUES (0.05::DOUBLE), (0.2::DOUBLE)) t(a)""")
def est13(spark, sf_dir):
    return spark.createDataFrame([(a, estimates.minimum_units_note("case", a)) for a in (0.05, 0.2)], "alpha double, note string")


#: A stream of up to ten lines for each tenth of a run: kinds and lines, the same in both engines.
STREAM_KIND = """CASE WHEN pos = 1 THEN CASE WHEN k % 23 = 0 THEN 'user' ELSE 'init' END WHEN pos = n THEN 'result' WHEN k % 41 = 0 THEN 'odd'
  WHEN pos % 2 = 0 AND k % 3 = 0 THEN 'tool_use' WHEN pos % 2 = 1 AND pk % 3 = 0 AND pk % 41 <> 0 AND k % 29 <> 0 THEN 'tool_result' WHEN k % 7 = 0 THEN 'error' WHEN k % 5 = 0 THEN 'user' ELSE 'assistant' END"""
STREAM_LINE = """concat('{"timestamp": "t", "type": "', CASE WHEN kind IN ('user', 'assistant') THEN 'message' ELSE kind END, '"', CASE kind WHEN 'init' THEN ', "session_id": "s", "model": "m"'
  WHEN 'user' THEN ', "role": "user", "content": "u"' WHEN 'assistant' THEN concat(', "role": "assistant", "content": "a', k, ' "') WHEN 'tool_use' THEN concat(', "tool_name": "t", "tool_id": "', pos, '", "parameters": {}')
  WHEN 'tool_result' THEN concat(', "tool_id": "', pos - 1, '", "status": "', CASE WHEN k % 2 = 0 THEN 'success' ELSE 'error' END, '"')
  WHEN 'error' THEN concat(', "severity": "', CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'error' END, '", "message": "e', k, '"') WHEN 'result' THEN concat(', "status": "', CASE WHEN k % 4 = 0 THEN 'error' ELSE 'success' END, '"') ELSE '' END, '}')"""


@query("src13_stream_lifecycle", f"""WITH {TRACE}, p AS (SELECT run_id * 100 + (index - 1) // 10 AS stream, (index - 1) % 10 + 1 AS pos, k FROM trace),
q AS (SELECT *, count(*) OVER (PARTITION BY stream) AS n, lag(k) OVER (PARTITION BY stream ORDER BY pos) AS pk FROM p), r AS (SELECT *, {STREAM_KIND} AS kind FROM q),
s AS (SELECT stream, max(n) AS n, max(CASE WHEN pos = 1 THEN kind END) AS first, bool_or(kind = 'odd') AS odd, count(*) FILTER (WHERE kind = 'tool_use') > count(*) FILTER (WHERE kind = 'tool_result') AS dangling,
  max(pos) FILTER (WHERE kind IN ('user', 'tool_use', 'tool_result')) AS reset, arg_max('e' || k, pos) FILTER (WHERE kind = 'error' AND k % 2 = 1) AS failure, bool_or(kind = 'result' AND k % 4 = 0) AS bad, count(*) FILTER (WHERE kind = 'tool_result') AS calls FROM r GROUP BY 1),
a AS (SELECT r.stream, trim(string_agg('a' || r.k || ' ', '' ORDER BY pos)) AS answer FROM r JOIN s USING (stream) WHERE kind = 'assistant' AND pos > coalesce(reset, 0) GROUP BY 1),
f AS (SELECT s.stream, calls, coalesce(answer, '') AS answer, CASE WHEN bad THEN coalesce(failure, 'the result reports an error') ELSE failure END AS provider,
  CASE WHEN first <> 'init' THEN 'missing init' WHEN n = 1 THEN 'no terminal result' WHEN odd THEN 'unknown event' WHEN dangling THEN 'dangling tool call' WHEN NOT bad AND failure IS NULL AND answer IS NULL THEN 'missing final answer' END AS protocol FROM s LEFT JOIN a USING (stream))
SELECT stream, CASE WHEN protocol IS NOT NULL THEN 'protocol_invalid' WHEN provider IS NOT NULL THEN 'provider_error' ELSE 'complete' END AS status, coalesce(protocol, provider) AS reason, CASE WHEN protocol IS NULL THEN answer END AS answer, CASE WHEN protocol IS NULL THEN calls END AS tool_calls FROM f""")
def src13(spark, sf_dir):
    t = trace(spark, sf_dir)
    p = t.selectExpr("CAST(run_id * 100 + (index - 1) div 10 AS BIGINT) AS stream", "(index - 1) % 10 + 1 AS pos", "k")
    q = p.selectExpr("*", "count(*) OVER (PARTITION BY stream) AS n", "lag(k) OVER (PARTITION BY stream ORDER BY pos) AS pk").withColumn("kind", F.expr(STREAM_KIND))
    return provider_streams.stream_outcomes(q.select("stream", "pos", F.expr(STREAM_LINE).alias("line")), "stream", "pos", "line")


@query("snk3_annotations", f"WITH {FINDINGS} SELECT '::' || CASE WHEN severity = 'required' THEN 'error' ELSE 'warning' END || ' title=' || kind || '::a ' || coalesce(subject, 'nothing') AS line, count(*) AS n FROM findings GROUP BY 1")
def snk3(spark, sf_dir):
    found = findings(spark, sf_dir).withColumn("message", F.concat(F.lit("a\r\n"), F.coalesce("subject", F.lit("nothing"))))
    return files.annotations(found).groupBy("line").agg(F.count("*").alias("n"))
