"""Text and trace predicates over documents, conversations and the trace relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.functions import diff, view
from pairwell.functions import text as tx
from pairwell.operators import traces
from pairwell.plans.registry import query
from pairwell.sources.evalviews import TRACE, table, trace

FOLD = "replace(lower(nfc_normalize(replace(replace(replace(text, chr(8203), ''), chr(8288), ''), chr(65279), ''))), 'ß', 'ss')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("txt1_contains", f"SELECT doc_id, contains({FOLD}, 'licensed under') AS passed FROM documents")
def txt1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.contains(F.col("text"), F.lit("Licensed under")).alias("passed"))


@query("txt2_contains_any", f"SELECT doc_id, contains({FOLD}, 'token = ') OR contains({FOLD}, '@') AS passed FROM documents")
def txt2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.contains_any(F.col("text"), ["token = ", "@"]).alias("passed"))


@query("txt3_contains_all", f"""SELECT doc_id, contains({FOLD}, 'the') AND contains({FOLD}, 'ing') AS passed,
  array_to_string(list_filter(['the', 'ing'], lambda v: NOT contains({FOLD}, v)), ',') AS missing FROM documents""")
def txt3(spark, sf_dir):
    values = ["the", "ing"]
    return docs(spark, sf_dir).select(
        "doc_id", tx.contains_all(F.col("text"), values).alias("passed"), F.array_join(tx.missing(F.col("text"), values), ",").alias("missing")
    )


@query("txt4_excludes_any", f"SELECT doc_id, NOT (contains({FOLD}, '!!') OR contains({FOLD}, '$$$')) AS passed FROM documents")
def txt4(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.excludes_any(F.col("text"), ["!!", "$$$"]).alias("passed"))


@query("txt5_regex", r"SELECT doc_id, regexp_matches(text, '(?i)[a-z]+\.[0-9]+@[a-z0-9.]+') AS passed FROM documents")
def txt5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.matches(F.col("text"), r"[a-z]+\.[0-9]+@[a-z0-9.]+").alias("passed"))


@query("txt5_bounded_regex")
def txt5_bounded(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.bounded_regex(r"\+1 \(\d{3}\) \d{3}-\d{4}")(F.col("text")).alias("passed"))


@query("txt6_similarity")
def txt6(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.similarity(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query("txt7_cosine", """SELECT a.vec_id, round(greatest(0.0, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) /
  (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))), 4) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def txt7(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select("vec_id", tx.cosine(F.col("embedding"), F.col("other")).alias("score"))


#: Texts with signs planted by id: a zero-width space behind the fifth character, a word joiner and a byte order mark in front, a decomposed letter at the end.
PLANTED = """CASE doc_id % 4 WHEN 0 THEN concat(substr(text, 1, 5), chr(8203), substr(text, 6)) WHEN 1 THEN concat(chr(8288), chr(65279), text) WHEN 2 THEN concat(text, 'e', chr(769)) ELSE text END"""
SPARK_PLANTED = PLANTED.replace("chr(8203)", "'\u200b'").replace("chr(8288)", "'\u2060'").replace("chr(65279)", "'\ufeff'").replace("chr(769)", "'\u0301'")


@query("txt8_normalization", f"""WITH p AS (SELECT doc_id, {PLANTED} AS t FROM documents), s AS (SELECT *, replace(replace(replace(t, chr(8203), ''), chr(8288), ''), chr(65279), '') AS u FROM p)
SELECT doc_id, nfc_normalize(u) <> t AS changed, nfc_normalize(u) <> u AS canonical_normalized, (length(t) - length(replace(t, chr(8203), '')))::INT AS spaces, (length(t) - length(replace(t, chr(8288), '')))::INT AS joiners,
  (length(t) - length(replace(t, chr(65279), '')))::INT AS marks, CASE doc_id % 4 WHEN 0 THEN (strpos(t, chr(8203)) - 1)::VARCHAR WHEN 1 THEN '0,1' ELSE '' END AS removed_at FROM s""")
def txt8(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", view.normalization(F.expr(SPARK_PLANTED)).alias("n"))
    count = lambda code, name: F.coalesce(F.col("n.removed")[code], F.lit(0)).alias(name)
    return found.select(
        "doc_id", "n.changed", "n.canonical_normalized", count("U+200B", "spaces"), count("U+2060", "joiners"), count("U+FEFF", "marks"), F.array_join("n.removed_at", ",").alias("removed_at")
    )


@query("txt8_positions", f"""WITH p AS (SELECT doc_id, {PLANTED} AS t FROM documents), f AS (SELECT *, strpos(lower(replace(replace(replace(t, chr(8203), ''), chr(8288), ''), chr(65279), '')), 'and the ') - 1 AS hit FROM p WHERE NOT contains(t, 'ß'))
SELECT doc_id, CASE WHEN hit >= 0 THEN hit + CASE WHEN doc_id % 4 = 1 THEN 2 WHEN doc_id % 4 = 0 AND hit >= 5 THEN 1 ELSE 0 END END::INT AS start,
  CASE WHEN hit >= 0 THEN hit + 8 + CASE WHEN doc_id % 4 = 1 THEN 2 WHEN doc_id % 4 = 0 AND hit + 8 > 5 THEN 1 ELSE 0 END END::INT AS stop FROM f""")
def txt8_positions(spark, sf_dir):
    texts = docs(spark, sf_dir).select("doc_id", F.expr(SPARK_PLANTED).alias("t")).filter(~F.contains("t", F.lit("ß")))
    return texts.select("doc_id", view.located(F.col("t"), "And the ").alias("s")).select("doc_id", "s.start", F.col("s.end").alias("stop"))


@query("txt9_golden", r"""SELECT a.doc_id, a.text = b.text AS exact, trim(a.text, ' ') = trim(b.text, ' ') AS trimmed,
  trim(regexp_replace(a.text, '[ \t\r\n]+', ' ', 'g'), ' ') = trim(regexp_replace(b.text, '[ \t\r\n]+', ' ', 'g'), ' ') AS same_text
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def txt9(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    t, o = F.col("text"), F.col("other")
    return d.join(following, "doc_id").select("doc_id", tx.golden(t, o, "exact").alias("exact"), tx.golden(t, o, "trim").alias("trimmed"), tx.golden(t, o, "text").alias("same_text"))


#: Whole texts against themselves with a first line gone, one put before, one replaced: scripts of a known length, whatever else the text holds.
@query("txt9_diff", """SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS removed, CASE WHEN doc_id % 4 IN (0, 2) AND text <> '' THEN 1 ELSE 0 END AS added,
  CASE WHEN doc_id % 4 = 3 OR doc_id % 4 = 0 AND text = '' THEN 0 ELSE 1 END AS hunks, CASE doc_id % 4 WHEN 0 THEN CASE WHEN text <> '' THEN '+' || string_split(text, chr(10))[1] END ELSE CASE WHEN doc_id % 4 < 3 THEN '-<<put here>>' END END AS first_edit FROM documents""")
def txt9_diff(spark, sf_dir):
    text, end = F.col("text"), F.instr(F.col("text"), F.lit("\n"))
    rest = F.when(end > 0, F.substr(text, end)).otherwise("")
    k = F.col("doc_id") % 4
    edited = F.when(k == 0, F.substr(rest, F.lit(2))).when(k == 1, F.concat(F.lit("<<put here>>\n"), text)).when(k == 2, F.concat(F.lit("<<put here>>"), rest)).otherwise(text)
    found = docs(spark, sf_dir).select("doc_id", diff.difference(edited, text).alias("d"))
    first = F.get(F.filter(F.split("d.diff", "\n"), lambda line: F.substr(line, F.lit(1), F.lit(1)).isin("-", "+")), 0)
    return found.select("doc_id", "d.removed", "d.added", "d.hunks", first.alias("first_edit"))


@query("txt10_json_field", "SELECT event_id, coalesce(json_extract_string(props, '$.k') = '7', false) AS passed FROM events")
def txt10(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.json_field_equals(F.col("props"), "$.k", "7").alias("passed"))


@query("txt11_structured_output", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) >= 100 AS failed FROM events")
def txt11(spark, sf_dir):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}
    return table(spark, sf_dir, "events").select("event_id", (F.size(tx.structured_output(schema)(F.col("props"))) > 0).alias("failed"))


@query("src6_strict_json", "SELECT event_id, json_valid(props) AS ok FROM events")
def src6(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.strict_json(F.col("props"))["ok"].alias("ok"))


@query("txt12_file_exists", "SELECT p.page_id, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id * 7) AS passed FROM pages p")
def txt12(spark, sf_dir):
    present = docs(spark, sf_dir).select(F.col("doc_id").alias("file")).distinct().withColumn("there", F.lit(True))
    p = table(spark, sf_dir, "pages").select("page_id")
    return p.join(present, p["page_id"] * 7 == present["file"], "left").select("page_id", F.coalesce("there", F.lit(False)).alias("passed"))


@query("txt13_script_score", """SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 AND c_custkey % 7 <= c_custkey % 11 THEN round((c_custkey % 7)::DOUBLE / (c_custkey % 11), 4) END AS score FROM customer""")
def txt13(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.format_string('{"score": %d, "max_score": %d}', F.col("c_custkey") % 7, F.col("c_custkey") % 11)
    return c.select("c_custkey", tx.script_score(line).alias("score"))


@query("flt9_redaction", "SELECT doc_id, md5(replace(replace(text, 'worthless', '[REDACTED]'), 'the', '[REDACTED]')) AS redacted FROM documents")
def flt9(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.redact(F.col("text"), ["the", "worthless"])).alias("redacted"))


@query("flt11_trigger_query", r"SELECT conv_id, turn, regexp_extract(text, '^\s*([A-Za-z]+)[ ,.]', 1) AS query FROM conversations")
def flt11(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract("text", r"^\s*([A-Za-z]+)[ ,.]", 1).alias("query"))


@query("flt8_population", "SELECT population, count(*) AS n, count(*) FILTER (WHERE population = 'answer') AS reported FROM (SELECT CASE role WHEN 'user' THEN 'answer' WHEN 'assistant' THEN 'judge' ELSE 'trigger' END AS population FROM conversations) GROUP BY 1")
def flt8(spark, sf_dir):
    population = F.when(F.col("role") == "user", "answer").when(F.col("role") == "assistant", "judge").otherwise("trigger")
    rows = table(spark, sf_dir, "conversations").select(population.alias("population"))
    return rows.groupBy("population").agg(F.count("*").alias("n"), F.count_if(F.col("population") == "answer").alias("reported"))


@query("trc1_event_state", f"WITH {TRACE} SELECT run_id, index, CASE WHEN status = 'started' THEN 'in_progress' ELSE status END AS state FROM trace")
def trc1(spark, sf_dir):
    return trace(spark, sf_dir).select("run_id", "index", traces.event_state(F.concat(F.lit(" "), F.upper("status"))).alias("state"))


@query("trc2_kind", "SELECT event_id, CASE event_type WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'file_write' WHEN 'click' THEN 'command' WHEN 'error' THEN 'error' ELSE 'event' END AS kind FROM events")
def trc2(spark, sf_dir):
    raw = F.replace(F.replace(F.col("event_type"), F.lit("purchase"), F.lit("file_write")), F.lit("click"), F.lit("command_execution"))
    return table(spark, sf_dir, "events").select("event_id", traces.kind_of(F.concat(F.lit("item."), raw)).alias("kind"))


@query("trc3_open_calls", """WITH e AS (SELECT user_id, event_id // 4 AS call, CASE WHEN event_type IN ('click', 'view') THEN 'open' ELSE 'close' END AS kind FROM events),
o AS (SELECT DISTINCT user_id, call FROM e WHERE kind = 'open'), c AS (SELECT DISTINCT user_id, call FROM e WHERE kind = 'close')
SELECT o.user_id, count(*) AS opened, count(c.call) AS completed_calls FROM o LEFT JOIN c USING (user_id, call) GROUP BY 1""")
def trc3(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), "open").otherwise("close")
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 4).alias("call"), kind.alias("kind"))
    return traces.open_calls(e, "user_id", "call", "kind")


@query("trc4_metrics", f"""WITH {TRACE}, done AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY index) - row_number() OVER (PARTITION BY run_id, name ORDER BY index) AS island FROM trace WHERE status = 'completed'),
l AS (SELECT run_id, max(n) AS m FROM (SELECT run_id, name, island, count(*) AS n FROM done GROUP BY ALL) GROUP BY 1)
SELECT t.run_id, count(*) FILTER (WHERE status = 'completed' AND type = 'tool_call') AS tool_calls, count(*) FILTER (WHERE status = 'completed' AND type = 'command') AS commands,
  count(*) FILTER (WHERE status = 'completed' AND type = 'file_read') AS file_reads, count(*) FILTER (WHERE status = 'completed' AND type = 'file_write') AS file_writes,
  count(*) FILTER (WHERE status = 'failed') AS errors, count(*) FILTER (WHERE type = 'skill_load') > 0 AS skill_invoked, max(m) AS repeated_command_max FROM trace t LEFT JOIN l USING (run_id) GROUP BY t.run_id""")
def trc4(spark, sf_dir):
    return traces.metrics(trace(spark, sf_dir))


@query("trc5_usage_alias", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 OR l_quantity = 10 THEN CAST(l_quantity AS INT) END AS tokens,
  l_linenumber % 3 = 2 AND l_quantity <> 10 AS conflict FROM lineitem""")
def trc5(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    first = F.when(F.col("l_linenumber") % 3 != 0, q)
    second = F.when(F.col("l_linenumber") % 3 == 2, F.lit(10))
    value, conflict = traces.one_alias([first, second])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("tokens"), conflict.alias("conflict"))


@query("trc6_stream_totals", f"""WITH {TRACE} SELECT run_id, coalesce(arg_max(CASE WHEN type = 'skill_load' THEN duration_ms END, CASE WHEN type = 'skill_load' THEN index END),
  CAST(sum(duration_ms) FILTER (WHERE type <> 'skill_load') AS BIGINT)) AS total FROM trace GROUP BY run_id""")
def trc6(spark, sf_dir):
    return traces.stream_totals(trace(spark, sf_dir), "run_id", F.col("type") == "skill_load", "duration_ms", "index")


@query("trc8_trajectory", f"""WITH {TRACE} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY index) AS INT) AS step, index, type, name FROM trace WHERE status = 'completed'""")
def trc8(spark, sf_dir):
    return traces.trajectory(trace(spark, sf_dir))


@query("trc9_operation_evidence", f"WITH {TRACE} SELECT run_id, index, CASE WHEN k % 5 = 0 THEN 'process_observation_incomplete' WHEN k % 7 = 0 THEN 'provider_response_incomplete' WHEN k % 11 = 0 THEN 'trace_observation_incomplete' ELSE 'complete' END AS evidence FROM trace")
def trc9(spark, sf_dir):
    k = F.col("k")
    return trace(spark, sf_dir).select("run_id", "index", traces.operation_evidence(k % 5 != 0, k % 7 != 0, k % 11 != 0).alias("evidence"))


@query("prc1_skill_invoked", f"WITH {TRACE} SELECT run_id, bool_or(type = 'skill_load') AS skill_invoked FROM trace GROUP BY 1")
def prc1(spark, sf_dir):
    return traces.metrics(trace(spark, sf_dir)).select("run_id", "skill_invoked")


@query("prc2_command_ran", f"WITH {TRACE} SELECT run_id, bool_or(name = 'cmd3' AND status = 'completed') AS command_ran, bool_or(name = 'cmd3') AS called_at_all FROM trace GROUP BY 1")
def prc2(spark, sf_dir):
    return traces.ran(trace(spark, sf_dir), "^cmd3$")


@query("prc4_command_order", f"""WITH {TRACE}, s AS (SELECT run_id, ',' || string_agg(name, ',' ORDER BY index) || ',' AS p FROM trace WHERE status = 'completed' GROUP BY 1)
SELECT run_id, regexp_matches(p, ',cmd1,(.*,)?cmd2,(.*,)?cmd3,') AS in_order FROM s""")
def prc4(spark, sf_dir):
    return traces.in_order(trace(spark, sf_dir), ["cmd1", "cmd2", "cmd3"])


@query("prc8_call_sets", f"""WITH {TRACE}, s AS (SELECT run_id, list(name ORDER BY name) AS n FROM trace WHERE status = 'completed' GROUP BY 1)
SELECT run_id, list_contains(n, 'cmd1') AND list_contains(n, 'cmd2') AS required_calls, n = ['cmd1', 'cmd2'] AS call_set, CAST(len(n) AS INT) AS tool_count FROM s""")
def prc8(spark, sf_dir):
    return traces.call_sets(trace(spark, sf_dir), ["cmd2", "cmd1"])


@query("prc11_repeat_loop", f"""WITH {TRACE}, i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY index) - row_number() OVER (PARTITION BY run_id, name ORDER BY index) AS island FROM trace)
SELECT run_id, max(n) AS repeated_command_max FROM (SELECT run_id, name, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1""")
def prc11(spark, sf_dir):
    return traces.longest_repeat(trace(spark, sf_dir))


@query("eff1_limits", f"WITH {TRACE} SELECT run_id, coalesce(sum(CASE WHEN k < 90 THEN duration_ms END) <= 6000, false) AS tokens_ok, coalesce(sum(duration_ms) / 1000 <= 7, false) AS seconds_ok, count(*) <= 70 AS commands_ok FROM trace GROUP BY 1")
def eff1(spark, sf_dir):
    g = trace(spark, sf_dir).groupBy("run_id").agg(F.sum(F.when(F.col("k") < 90, F.col("duration_ms"))).alias("t"), (F.sum("duration_ms") / 1000).alias("s"), F.count("*").alias("n"))
    return g.select("run_id", traces.at_most(F.col("t"), 6000).alias("tokens_ok"), traces.at_most(F.col("s"), 7).alias("seconds_ok"), traces.at_most(F.col("n"), 70).alias("commands_ok"))
