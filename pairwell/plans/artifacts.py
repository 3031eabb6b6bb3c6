"""Artifact sets, the grading export and the telemetry envelope."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators import artifacts
from pairwell.plans.registry import query
from pairwell.sources.evalviews import table

#: The marker of each document's run folder, in SQL of both engines; what is wrong with it goes by d.
INVENTORY = """concat('{"output.md":"', sha2, '","events.json":"', repeat('a', 64), CASE WHEN d = 8 THEN '' ELSE concat('","metrics.json":"', repeat('b', 64)) END,
  '","metadata.json":"', repeat('c', CASE WHEN d = 9 THEN 63 ELSE 64 END), CASE WHEN d = 10 THEN concat('","../x":"', repeat('d', 64)) ELSE '' END, '"}')"""
COMMIT = f"""CASE WHEN d IN (0, 1) THEN NULL WHEN d = 4 THEN '{{"schema_version":1,' WHEN d = 5 THEN '[1]' ELSE concat('{{"schema_version":', CASE d WHEN 6 THEN 'true' WHEN 15 THEN '2' ELSE '1' END,
  ',"required_files":["output.md","events.json"', CASE WHEN d = 7 THEN '' ELSE ',"metrics.json"' END, ',"metadata.json"],"inventory_sha256":', CASE WHEN d = 14 THEN '[]' ELSE {INVENTORY} END, '}}') END"""


@query("src5_artifact_states", """WITH r AS (SELECT doc_id, doc_id % 16 AS d FROM documents)
SELECT doc_id, CASE WHEN d = 0 THEN 'legacy_undeclared' WHEN d = 1 THEN 'missing_commit' WHEN d IN (2, 3, 4, 5, 6, 7, 9, 10, 14, 15) THEN 'invalid_commit' WHEN d IN (8, 11, 12) THEN 'incomplete' ELSE 'complete' END AS state,
  CASE d WHEN 1 THEN 'no commit marker' WHEN 2 THEN 'unsupported contract version' WHEN 3 THEN 'no declared contract version' WHEN 4 THEN 'invalid JSON' WHEN 5 THEN 'no object' WHEN 6 THEN 'unsupported schema version'
  WHEN 7 THEN 'wrong required files' WHEN 8 THEN 'a required file is not listed' WHEN 9 THEN 'invalid path or digest' WHEN 10 THEN 'invalid path or digest' WHEN 11 THEN 'inventory and files differ' WHEN 12 THEN 'a digest differs'
  WHEN 14 THEN 'no inventory' WHEN 15 THEN 'unsupported schema version' END AS reason FROM r""")
def src5_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(doc_id % 16 AS INT) AS d", "sha2(coalesce(text, ''), 256) AS sha2")
    declared = F.when(F.col("d") == 2, 2).when(~F.col("d").isin(0, 3), 1)
    runs = d.select("doc_id", declared.alias("declared"), F.expr(COMMIT).alias("marker"))
    stale = F.when(F.col("d") == 12, F.lit("e" * 64)).otherwise(F.lit("b" * 64))
    of = lambda path, sha: F.struct(F.lit(path).alias("path"), sha.alias("sha"))
    files = F.array(
        of("output.md", F.col("sha2")), of("events.json", F.lit("a" * 64)), of("metrics.json", stale), of("metadata.json", F.lit("c" * 64)),
        of(artifacts.MARKER, F.lit("f" * 64)), F.when(F.col("d") == 11, of("extra.txt", F.lit("d" * 64))),
    )
    listed = d.select("doc_id", F.explode(F.array_compact(files)).alias("f")).select("doc_id", "f.path", "f.sha")
    return artifacts.artifact_states(runs, listed, "doc_id", "declared", "marker", "path", "sha")


@query("snk5_commit_marker", """SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN '{"schema_version":1,"required_files":["output.md","events.json","metrics.json","metadata.json"],"inventory_sha256":{"events.json":"' || sha256('[]') || '","metadata.json":"' || sha256('m' || doc_id) || '","metrics.json":"' || sha256('{}') || '","output.md":"' || sha256(coalesce(text, '')) || '"}}' END AS marker FROM documents""")
def snk5(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    of = lambda path, content: F.struct(F.lit(path).alias("path"), F.sha2(content, 256).alias("sha"))
    files = F.array(
        of("output.md", F.coalesce("text", F.lit(""))), of("events.json", F.lit("[]")), of("metrics.json", F.lit("{}")),
        F.when(F.col("doc_id") % 10 > 0, of("metadata.json", F.concat(F.lit("m"), F.col("doc_id").cast("string")))),
    )
    listed = d.select("doc_id", F.explode(F.array_compact(files)).alias("f")).select("doc_id", "f.path", "f.sha")
    return artifacts.commit_markers(listed, "doc_id", "path", "sha")


@query("snk4_grading_files", """SELECT l_orderkey, '{"expectations":[' || string_agg('{"text":"line ' || l_linenumber || '","passed":' || (l_quantity > 25) || ',"evidence":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_quantity > 25, l_returnflag) ||
  '],"summary":{"passed":' || count(*) FILTER (WHERE l_quantity > 25) || ',"failed":' || count(*) FILTER (WHERE NOT l_quantity > 25) || ',"total":' || count(*) || ',"pass_rate":' || round(count(*) FILTER (WHERE l_quantity > 25) / count(*), 4) || '}}' AS grading FROM lineitem GROUP BY 1""")
def snk4(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_quantity") > 25).alias("passed"), F.col("l_returnflag").alias("evidence"))
    return artifacts.grading_files(r, ["l_orderkey"], "text", "passed", "evidence")


#: A run's metadata for each event: what is said of its input tokens and times goes by k.
META = """concat('{"output_tokens": ', k, CASE WHEN k % 9 < 5 THEN concat(', "usage_normalized": {"source": "', CASE k % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'odd' ELSE 'provider_reported' END,
  '", "input_tokens": ', CASE k % 9 WHEN 3 THEN '"7"' ELSE concat(k, '') END, '}') ELSE '' END, CASE k % 9 WHEN 5 THEN ', "input_tokens": 2.5' WHEN 6 THEN ', "input_tokens": 8.0' WHEN 7 THEN ', "input_tokens": null' ELSE '' END,
  CASE k % 4 WHEN 0 THEN ', "elapsed_ms": 10' WHEN 1 THEN ', "elapsed_ms": -1, "duration_ms": 5' WHEN 2 THEN ', "duration_ms": 6' ELSE '' END, ', "tool_calls": ', CASE WHEN k % 8 = 0 THEN 'true' ELSE concat(k, '') END, '}')"""


@query("cst2_envelope", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k % 9 = 1 THEN 'not_applicable' WHEN k % 9 IN (4, 6) THEN 'available' ELSE 'unavailable' END AS input_availability, CASE k % 9 WHEN 4 THEN k WHEN 6 THEN 8 END::DOUBLE AS input_tokens,
  CASE k % 9 WHEN 4 THEN 'provider_reported' WHEN 6 THEN 'legacy_unverified' END AS input_provenance,
  CASE k % 9 WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'unknown_usage_provenance' WHEN 3 THEN 'missing_input_tokens' WHEN 4 THEN NULL WHEN 5 THEN 'invalid_legacy_input_tokens' WHEN 6 THEN NULL ELSE 'missing' END AS input_reason,
  CASE WHEN k % 9 >= 5 THEN k END::DOUBLE AS output_tokens, CASE k % 4 WHEN 0 THEN 10 WHEN 2 THEN 6 END::DOUBLE AS elapsed_ms,
  CASE WHEN k % 5 = 0 THEN 'process_observation_incomplete' WHEN k % 7 = 0 THEN 'provider_response_incomplete' WHEN k % 11 = 0 THEN 'trace_observation_incomplete' WHEN k % 8 = 0 THEN 'missing_tool_calls' END AS tool_calls_reason,
  CASE WHEN k % 5 > 0 AND k % 7 > 0 AND k % 11 > 0 THEN 'missing_commands' END AS commands_reason FROM e""")
def cst2(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    m = e.select("event_id", "k", artifacts.envelope(F.expr(META), k % 5 != 0, k % 7 != 0, k % 11 != 0).alias("e")).select("event_id", "k", "e.measurements.*")
    commands = F.when(F.col("commands.reason") == "missing_commands", F.col("commands.reason"))
    return m.select(
        "event_id", F.col("input_tokens.availability").alias("input_availability"), F.col("input_tokens.value").alias("input_tokens"), F.col("input_tokens.provenance").alias("input_provenance"),
        F.col("input_tokens.reason").alias("input_reason"), F.col("output_tokens.value").alias("output_tokens"), F.col("elapsed_ms.value").alias("elapsed_ms"),
        F.col("tool_calls.reason").alias("tool_calls_reason"), commands.alias("commands_reason"),
    )
