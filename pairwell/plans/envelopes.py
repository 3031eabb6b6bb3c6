"""JSON envelopes derived from customers: outcome, usage and tool counts against DuckDB's JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import provider_envelopes
from pairwell.plans.registry import query
from pairwell.sources.evalviews import table

#: A document for each customer, the same text in both engines; K is the key as text.
DOCUMENTS = """CASE WHEN c_custkey % 17 = 3 THEN '{"response": ' WHEN c_custkey % 17 = 4 THEN '[' || K || ']' ELSE '{' || concat_ws(', ',
  CASE WHEN c_custkey % 13 = 1 THEN '"session_id": 7' ELSE '"session_id": "s' || K || '"' END,
  CASE WHEN c_custkey % 11 = 2 THEN '"error": {"type": "Quota", "message": "' || c_mktsegment || '"}' WHEN c_custkey % 11 = 3 THEN '"error": {"type": "Quota"}' END,
  CASE WHEN c_custkey % 7 = 1 THEN '"warnings": ["slow", "Maximum Session Turns Exceeded"]' WHEN c_custkey % 7 = 2 THEN '"warnings": ["agent execution stopped: ' || c_mktsegment || '"]' WHEN c_custkey % 7 = 3 THEN '"warnings": ["slow"]' END,
  CASE WHEN c_custkey % 5 > 0 THEN '"response": "' || c_name || '"' END,
  '"stats": {"models": {"m' || K || '": {"tokens": {"input": ' || K || ', "prompt": ' || P || ', "candidates": 5, "total": ' || T || ', "cached": 2, "thoughts": 0, "tool": ' || CASE WHEN c_custkey % 19 = 5 THEN '-1' ELSE '0' END || '}}, "b": {"tokens": {"input": 1, "prompt": 1, "candidates": 1, "total": 2, "cached": 0, "thoughts": 0, "tool": 0}}}, "tools": {"totalCalls": ' || CASE WHEN c_custkey % 23 = 6 THEN '"3"' ELSE '3' END || '}}') || '}' END"""


def _in(string: str) -> str:
    text = DOCUMENTS.replace("' || K", f"' || CAST(c_custkey AS {string})").replace("|| P ||", f"|| CAST(c_custkey + CASE WHEN c_custkey % 29 = 7 THEN 1 ELSE 2 END AS {string}) ||")
    return text.replace("|| T ||", f"|| CAST(c_custkey + CASE WHEN c_custkey % 31 = 8 THEN 6 ELSE 7 END AS {string}) ||")


@query("src13_json_envelope", f"""WITH d AS (SELECT c_custkey, c_mktsegment, {_in("VARCHAR")} AS t FROM customer), j AS (SELECT *, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS v FROM d),
m AS (SELECT c_custkey, 'm' || c_custkey AS own, v->'$.stats.models' AS ms FROM j WHERE json_type(v) = 'OBJECT'), k AS (SELECT *, ms->own->'tokens' AS x, ms->'b'->'tokens' AS y FROM m),
r AS (SELECT j.c_custkey, v, (v->>'$.error.type') || ': ' || (v->>'$.error.message') AS failed, CASE WHEN lower(v->>'$.warnings[0]') LIKE 'agent execution stopped:%' THEN v->>'$.warnings[0]' WHEN lower(v->>'$.warnings[1]') = 'maximum session turns exceeded' THEN v->>'$.warnings[1]' END AS stopped,
  own, (x->>'input')::BIGINT AS i, (x->>'prompt')::BIGINT AS p, (x->>'cached')::BIGINT AS c, (x->>'total')::BIGINT AS t, (x->>'candidates')::BIGINT AS o, (x->>'tool')::BIGINT AS tool, (y->>'total')::BIGINT AS t2, (y->>'prompt')::BIGINT AS p2 FROM j LEFT JOIN k ON j.c_custkey = k.c_custkey),
e AS (SELECT *, CASE WHEN v IS NULL THEN 'malformed JSON' WHEN json_type(v) <> 'OBJECT' THEN 'output must be an object' WHEN json_type(v, '$.session_id') <> 'VARCHAR' THEN 'session_id must be a non-empty string'
  WHEN json_type(v, '$.error') = 'OBJECT' AND failed IS NULL THEN 'error.message must be a non-empty string' WHEN coalesce(failed, stopped) IS NULL AND (v->>'$.response') IS NULL THEN 'response must be a non-empty string'
  WHEN tool < 0 THEN 'tokens.tool must be a non-negative integer' WHEN p <> i + c THEN 'prompt must equal input + cached' WHEN t < p + o THEN 'total cannot be less than prompt + candidates'
  WHEN json_type(v, '$.stats.tools.totalCalls') = 'VARCHAR' THEN 'stats.tools.totalCalls must be a non-negative integer' END AS wrong FROM r)
SELECT c_custkey, CASE WHEN wrong IS NOT NULL THEN 'protocol_invalid' WHEN coalesce(failed, stopped) IS NOT NULL THEN 'provider_error' ELSE 'complete' END AS status, coalesce(wrong, failed, stopped) AS reason,
  CASE WHEN wrong IS NULL THEN coalesce(v->>'$.response', '') END AS response, CASE WHEN wrong IS NULL THEN 'b,' || own END AS models, CASE WHEN wrong IS NULL THEN p + p2 END AS input_tokens,
  CASE WHEN wrong IS NULL THEN o + 1 END AS output_tokens, CASE WHEN wrong IS NULL THEN t + t2 END AS total_tokens, CASE WHEN wrong IS NULL THEN c END AS cache_read_tokens, CASE WHEN wrong IS NULL THEN 3::BIGINT END AS tool_calls FROM e""")
def src13_envelope(spark, sf_dir):
    documents = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_in("STRING")).alias("t"))
    return provider_envelopes.envelope_outcomes(documents, "c_custkey", "t")
