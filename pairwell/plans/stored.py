"""What is written to the shared folder and read back: manifests, committed run folders, report history; reports as markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwell.operators.lineage import fresh
from pairwell.plans.registry import query
from pairwell.sources import files
from pairwell.sources.evalviews import table
from pairwell.sources.folders import write_runs


@query("src1_manifest_cases", """SELECT 1 + (item_id // 10) % 2 AS version, 'suite-' || (item_id // 10) AS skill_name, 'item-' || item_id AS id, CASE WHEN item_id % 4 > 0 THEN 'tune' END AS split, text AS prompt,
  CASE WHEN item_id % 3 = 0 THEN item_id % 2 = 0 END AS should_trigger, item_id % 3 AS goals FROM benchmark""")
def src1(spark, sf_dir):
    """A manifest of JSON for every ten items, written as files and read as a row per case."""
    i = F.col("item_id")
    goals = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (i % 3).cast("int"))
    case = F.struct(
        F.concat(F.lit("item-"), i.cast("string")).alias("id"), F.when(i % 4 > 0, "tune").alias("split"), F.col("text").alias("prompt"),
        F.when(i % 3 == 0, i % 2 == 0).alias("should_trigger"), goals.alias("success_goals"),
    )
    b = table(spark, sf_dir, "benchmark").withColumn("suite", F.floor(i / 10))
    whole = b.groupBy("suite").agg(F.collect_list(case).alias("cases"))  # ten cases at most
    document = F.to_json(F.struct((1 + F.col("suite") % 2).alias("version"), F.concat(F.lit("suite-"), F.col("suite").cast("string")).alias("skill_name"), "cases"), {"pretty": "true"})
    path = fresh(spark, "manifests")
    whole.select(document.alias("value"), "suite").write.partitionBy("suite").text(path)
    m = files.manifest(spark, path)
    return m.select(F.col("version").cast("long").alias("version"), "skill_name", "id", "split", "prompt", "should_trigger", F.size("success_goals").cast("long").alias("goals"))


@query("snk5_committed_folders", """SELECT 'page-' || page_id || '/' || CASE WHEN page_id % 2 = 0 THEN 'with_skill' ELSE 'old_skill/run-' || page_id END AS run,
  CASE WHEN page_id % 7 = 3 THEN 3 ELSE 5 END::BIGINT + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS files, CASE WHEN page_id % 7 = 3 THEN 'missing_commit' ELSE 'complete' END AS state FROM pages""")
def snk5(spark, sf_dir):
    """A run folder for each page by the committing job, then found again and held against its marker."""
    i = F.col("page_id")
    run = F.concat(F.lit("page-"), i.cast("string"), F.lit("/"), F.when(i % 2 == 0, "with_skill").otherwise(F.concat(F.lit("old_skill/run-"), i.cast("string"))))
    file = lambda name, text: F.struct(F.lit(name).alias("path"), F.encode(text, "UTF-8").alias("content"))
    each = F.array(
        file("output.md", F.coalesce("html", F.lit(""))), file("events.json", F.lit("[]")), file("metadata.json", F.to_json(F.struct("url"))),
        F.when(i % 7 != 3, file("metrics.json", F.lit("{}"))), F.when(i % 5 == 0, file("extra/note.txt", F.coalesce("url", F.lit("")))),
    )
    rows = table(spark, sf_dir, "pages").select(run.alias("run"), F.explode(F.array_compact(each)).alias("f")).select("run", "f.path", "f.content")
    root = fresh(spark, "runs")
    write_runs(rows, root)
    return files.run_folder_states(spark, root).select("run", "files", "state")


@query("snk6_history", """SELECT event_type, ordinal, n, sum(n) OVER (PARTITION BY event_type ORDER BY ordinal)::BIGINT AS so_far FROM (SELECT event_type, event_id % 3 + 1 AS ordinal, count(*) AS n FROM events GROUP BY 1, 2)""")
def snk6(spark, sf_dir):
    """Three reports appended to a history out of order and read in order of their ordinals."""
    from pyspark.sql.window import Window

    path, e = fresh(spark, "history"), table(spark, sf_dir, "events")
    for ordinal in (2, 1, 3):
        files.append_report(e.filter(F.col("event_id") % 3 + 1 == ordinal).groupBy("event_type").agg(F.count("*").alias("n")), ordinal, path)
    so_far = F.sum("n").over(Window.partitionBy("event_type").orderBy("ordinal"))
    return files.history(spark, path).select("event_type", F.col("ordinal").cast("long").alias("ordinal"), "n", so_far.alias("so_far"))


@query("snk1_markdown", """WITH r AS (SELECT c_mktsegment, '| ' || c_name || '\\|' || c_nationkey || ' | ' || CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE 'a<br>b' || c_custkey END || ' |' AS line FROM customer)
SELECT c_mktsegment, 2 AS place, line FROM r UNION ALL SELECT DISTINCT c_mktsegment, 0, '| customer | note |' FROM r UNION ALL SELECT DISTINCT c_mktsegment, 1, '| --- | --- |' FROM r""".replace("\\\\", "\\"))
def snk1(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("a\r\nb"), F.col("c_custkey").cast("string")))
    report = c.select("c_mktsegment", F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string")).alias("customer"), note.alias("note"))
    return files.markdown(report, ["customer", "note"], ["c_mktsegment"])
