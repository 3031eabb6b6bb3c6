"""Raw trace lines of all dialects, derived from conversations, read by dialect and paired by call id."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import dialects
from pairwell.plans.registry import query
from pairwell.sources.evalviews import table

#: A trace for each conversation, a raw line for each turn, the same text in both engines. Even turns open calls, odd turns close them.
LINES = """SELECT conv_id, turn + 1 AS line_number, CASE conv_id % 7 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' WHEN 3 THEN 'pi' WHEN 4 THEN 'vibe' WHEN 5 THEN 'generic' ELSE 'pi ' END AS dialect,
  CASE WHEN (conv_id + turn) % 13 = 5 THEN '{"type": ' WHEN (conv_id + turn) % 17 = 5 THEN '[1]'
    WHEN turn % 2 = 0 THEN CASE conv_id % 7
      WHEN 0 THEN '{"type": "assistant", "message": {"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "t' || TURN || '", "name": "' || role || '", "input": {}}, {"type": "tool_use", "id": "same", "name": "Read", "input": {}}]}}'
      WHEN 1 THEN '{"type": "item.started", "item": {"id": "t' || TURN || '", "command": "' || role || '"}}'
      WHEN 2 THEN '{"type": "tool_use", "tool_id": "t' || TURN || '", "tool_name": "' || role || '", "parameters": {}}'
      WHEN 3 THEN '{"type": "tool_execution_start", "toolCallId": "t' || TURN || '", "toolName": "' || role || '"}'
      WHEN 4 THEN '{"role": "assistant", "tool_calls": [{"id": "t' || TURN || '", "function": {"name": "' || role || '"}}]}'
      ELSE '{"id": "t' || TURN || '", "name": "' || role || '", "status": "started"}' END
    ELSE CASE conv_id % 7
      WHEN 0 THEN '{"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t' || BEFORE || '", "is_error": ' || CASE WHEN turn % 3 = 0 THEN 'true' ELSE 'false' END || '}, {"type": "tool_result", "tool_use_id": "same"}]}}'
      WHEN 1 THEN '{"type": "item.completed", "item": {"id": "t' || BEFORE || '", "command": "' || role || '", "exit_code": ' || CASE WHEN turn % 3 = 0 THEN '2' ELSE '0' END || '}}'
      WHEN 2 THEN '{"type": "tool_result", "tool_id": "t' || BEFORE || '", "status": "' || CASE WHEN turn % 3 = 0 THEN 'error' ELSE 'success' END || '"}'
      WHEN 3 THEN '{"type": "tool_execution_end", "toolCallId": "t' || BEFORE || '", "isError": ' || CASE WHEN turn % 3 = 0 THEN 'true' ELSE 'false' END || '}'
      WHEN 4 THEN '{"role": "tool", "tool_call_id": "t' || BEFORE || '"}'
      ELSE '{"id": "t' || BEFORE || '", "status": "' || CASE WHEN turn % 3 = 0 THEN 'failed' ELSE 'completed' END || '"}' END END AS line FROM conversations"""


def _in(engine_string: str) -> str:
    return LINES.replace("BEFORE", f"CAST(turn - 1 AS {engine_string})").replace("TURN", f"CAST(turn AS {engine_string})")


#: Actions read from the stored lines with JSON functions, a branch for each dialect.
ACTIONS_SQL = f"""lines AS ({_in("VARCHAR")}), good AS (SELECT *, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN CAST(line AS JSON) END AS j FROM lines WHERE dialect <> 'pi '),
blocks AS (SELECT conv_id, line_number, unnest(range(len(b))) AS pos, unnest(b) AS b FROM (SELECT *, CAST(json_extract(j, '$.message.content') AS JSON[]) AS b FROM good WHERE dialect = 'claude' AND j IS NOT NULL)),
found AS (
  SELECT conv_id, line_number, pos, 'open' AS phase, b->>'$.id' AS call_id, b->>'$.name' AS name, NULL::BOOLEAN AS ok FROM blocks WHERE (b->>'$.type') = 'tool_use'
  UNION ALL SELECT conv_id, line_number, pos, 'close', b->>'$.tool_use_id', NULL, coalesce(b->>'$.is_error', 'false') = 'false' FROM blocks WHERE (b->>'$.type') = 'tool_result'
  UNION ALL SELECT conv_id, line_number, 0, CASE j->>'$.type' WHEN 'item.started' THEN 'open' ELSE 'close' END, j->>'$.item.id', j->>'$.item.command', CASE WHEN (j->>'$.type') = 'item.completed' THEN (j->>'$.item.exit_code') = '0' END FROM good WHERE dialect = 'codex' AND j IS NOT NULL
  UNION ALL SELECT conv_id, line_number, 0, CASE j->>'$.type' WHEN 'tool_use' THEN 'open' ELSE 'close' END, j->>'$.tool_id', j->>'$.tool_name', (j->>'$.status') = 'success' FROM good WHERE dialect = 'gemini' AND j IS NOT NULL
  UNION ALL SELECT conv_id, line_number, 0, CASE j->>'$.type' WHEN 'tool_execution_start' THEN 'open' ELSE 'close' END, j->>'$.toolCallId', j->>'$.toolName', (j->>'$.isError') = 'false' FROM good WHERE dialect = 'pi' AND j IS NOT NULL
  UNION ALL SELECT conv_id, line_number, 0, 'open', j->>'$.tool_calls[0].id', j->>'$.tool_calls[0].function.name', NULL FROM good WHERE dialect = 'vibe' AND (j->>'$.role') = 'assistant'
  UNION ALL SELECT conv_id, line_number, 0, 'close', j->>'$.tool_call_id', NULL, true FROM good WHERE dialect = 'vibe' AND (j->>'$.role') = 'tool'
  UNION ALL SELECT conv_id, line_number, 0, CASE j->>'$.status' WHEN 'started' THEN 'open' ELSE 'close' END, j->>'$.id', j->>'$.name', CASE j->>'$.status' WHEN 'completed' THEN true WHEN 'failed' THEN false END FROM good WHERE dialect = 'generic' AND j IS NOT NULL),
wrong AS (SELECT conv_id, line_number, CASE WHEN dialect = 'pi ' THEN 'unknown dialect' WHEN NOT json_valid(line) THEN 'invalid JSON' WHEN json_type(line) <> 'OBJECT' THEN 'not a JSON object' END AS problem FROM lines)"""


def actions(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("pairwell_conversations")
    lines = spark.sql(_in("STRING").replace("FROM conversations", "FROM pairwell_conversations"))
    return dialects.trace_actions(lines, ["conv_id"], F.col("dialect"))


@query("src8_trace_actions", f"""WITH {ACTIONS_SQL}
SELECT conv_id, line_number::BIGINT AS line_number, (row_number() OVER (PARTITION BY conv_id, line_number ORDER BY pos) - 1)::INT AS place, phase, call_id, name, ok, NULL AS problem FROM found
UNION ALL SELECT conv_id, line_number, 0, 'bad', NULL, NULL, NULL, problem FROM wrong WHERE problem IS NOT NULL""")
def src8_actions(spark, sf_dir):
    return actions(spark, sf_dir)


@query("src8_trace_calls", f"""WITH {ACTIONS_SQL}, o AS (SELECT conv_id, call_id, arg_min(name, line_number) AS name, min(line_number) AS opened_line, count(*) AS opens FROM found WHERE phase = 'open' GROUP BY 1, 2),
c AS (SELECT f.conv_id, f.call_id, min(f.line_number) FILTER (WHERE f.line_number > o.opened_line) AS closed_line, arg_min(ok, f.line_number) FILTER (WHERE f.line_number > o.opened_line) AS ok,
  count(*) FILTER (WHERE f.line_number > o.opened_line) AS closes, count(*) FILTER (WHERE f.line_number > o.opened_line IS NOT TRUE) AS early FROM found f LEFT JOIN o ON o.conv_id = f.conv_id AND o.call_id = f.call_id WHERE phase = 'close' GROUP BY 1, 2)
SELECT coalesce(o.conv_id, c.conv_id) AS conv_id, coalesce(o.call_id, c.call_id) AS call_id, name, opened_line, closed_line,
  CASE WHEN closed_line IS NULL THEN CASE WHEN opens IS NULL THEN 'unknown' ELSE 'in_progress' END WHEN ok THEN 'completed' ELSE 'failed' END AS status,
  nullif(concat_ws('; ', CASE WHEN opens > 1 THEN 'opened twice' END, CASE WHEN opens IS NULL OR early > 0 THEN 'unmatched close' END, CASE WHEN closes > 1 THEN 'closed twice' END), '') AS problem
FROM o FULL OUTER JOIN c ON o.conv_id = c.conv_id AND o.call_id = c.call_id""")
def src8_calls(spark, sf_dir):
    return dialects.trace_calls(actions(spark, sf_dir), ["conv_id"])
