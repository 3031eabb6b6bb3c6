"""Manifests, run folders, trace files and report history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.operators.artifacts import artifact_states
from pairwell.operators.traces import event_state, kind_of
from pairwell.sources.folders import listed_files

CASE = (
    "struct<id:string,split:string,kind:string,domain:string,difficulty:string,trigger_type:string,success_goals:array<string>,"
    "prompt:string,should_trigger:boolean,expected_behavior:array<string>,canary:string,released_at:string,source:string>"
)
MANIFEST = f"version int, skill_name string, variants array<string>, cases array<{CASE}>"
#: The field of a raw trace line that holds its type, name and status, by dialect.
DIALECTS = {
    "generic": ("$.type", "$.name", "$.status"),
    "claude": ("$.type", "$.message.content[0].name", "$.subtype"),
    "codex": ("$.type", "$.item.command", "$.item.status"),
    "gemini": ("$.type", "$.tool_name", "$.status"),
    "pi": ("$.type", "$.toolName", "$.status"),
    "vibe": ("$.type", "$.tool", "$.state"),
    "jetty": ("$.kind", "$.name", "$.status"),
}
_RUN = r"/([^/]+)/(?:([^/]+)/)?(with_skill|without_skill|old_skill|ablation:[^/]+)/(?:run-(\d+)/)?[^/]+$"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: a row per case of JSON manifests of version 1 or 2; other versions are an error."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True, allowNonNumericNumbers=False)
    version = F.when(F.col("version").isin(1, 2), F.col("version")).otherwise(F.raise_error(F.lit("unknown manifest version")).cast("int"))
    return m.select(version.alias("version"), "skill_name", F.explode("cases").alias("case")).select("version", "skill_name", "case.*")


def yaml_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: the same rows of a YAML manifest, with the name of each case's dataset; a manifest is a small file."""
    import yaml  # not everywhere at hand

    whole = spark.read.text(path, wholetext=True).first()[0]
    m = yaml.safe_load(whole)
    if m.get("version") not in (1, 2):
        raise ValueError("unknown manifest version")
    schema = T.StructType.fromDDL(f"case {CASE}")["case"].dataType.add("dataset", "string")
    cases = spark.createDataFrame([tuple(c.get(f) for f in schema.names) for c in m.get("cases") or []], schema)
    return cases.select(F.lit(m["version"]).alias("version"), F.lit(m.get("skill_name")).alias("skill_name"), "*")


def dataset_rows(spark: SparkSession, root: str, names: Sequence[str], row_id: str = "id") -> DataFrame:
    """SRC2: the rows of JSONL datasets, each with its dataset's name and row_id."""
    rows = spark.read.json([f"{root}/{n}" for n in names])
    file = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return rows.select("*", file.alias("dataset"), F.col(row_id).alias("row_id"))


def run_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """SRC4: files called `name` below case/[model/]variant/[run-n/], with their coordinate and text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    inner = F.substring_index("path", root.split("://")[-1].rstrip("/"), -1)
    part = lambda i: F.nullif(F.regexp_extract(inner, _RUN, i), F.lit(""))
    return files.select(
        part(1).alias("case_id"), part(2).alias("model"), part(3).alias("variant"),
        F.coalesce(part(4).cast("int"), F.lit(1)).alias("run_number"), F.decode("content", "UTF-8").alias("text"),
    )


#: A run's folder below the root, and a file's path in it.
_FOLDER = r"^/?((?:[^/]+/){1,2}(?:with_skill|without_skill|old_skill|ablation:[^/]+)(?:/run-\d+)?)/(.+)$"


def run_folder_states(spark: SparkSession, root: str, version: int = 1) -> DataFrame:
    """SRC4, SRC5: every run folder below root with its number of files and bytes, and its state by its marker and digests.

    Tasks list the folders and hash the files, each once; what is not below case/[model/]variant/[run-n/] belongs to no run.
    """
    part = lambda i: F.regexp_extract("path", _FOLDER, i)
    found = listed_files(spark, root).select(part(1).alias("run"), part(2).alias("path"), "length", "sha", "marker").filter("run <> ''")
    runs = found.groupBy("run").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("marker").alias("marker"), F.lit(version).alias("declared"))
    states = artifact_states(runs.select("run", "declared", "marker"), found.select("run", "path", "sha"), "run", "declared", "marker", "path", "sha")
    return runs.select("run", "files", "bytes").join(states, "run", "left")


def trace_lines(files: DataFrame, dialect: str, text: str = "text") -> DataFrame:
    """SRC8: an event per JSON line with its line number; an unknown dialect is refused."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown trace dialect: {dialect}")
    kind, name, status = (F.get_json_object("line", p) for p in DIALECTS[dialect])
    keys = [c for c in files.columns if c != text]
    lines = files.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line")).filter(F.btrim("line") != "")
    return lines.select(
        *keys, (F.col("at") + 1).alias("line_number"), kind.alias("raw_type"), kind_of(kind).alias("type"), name.alias("name"), event_state(status, kind).alias("status")
    )


def append_report(report: DataFrame, ordinal: int, path: str) -> None:
    """SNK6: appends a report to the history, partitioned by ordinal; one that is there already is never written to again."""
    spark = report.sparkSession
    try:
        taken = not history(spark, path).filter(F.col("ordinal") == ordinal).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        taken = False
    if taken:
        raise ValueError(f"the history has a report {ordinal}")
    report.withColumn("ordinal", F.lit(ordinal)).write.mode("append").partitionBy("ordinal").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: all reports; order by ordinal where order matters."""
    return spark.read.parquet(path)


def write_json(report: DataFrame, path: str) -> None:
    """SNK1: a report as JSON lines."""
    report.write.mode("errorifexists").json(path)


def markdown(report: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """SNK1: a report as the lines of markdown tables, one for each value of `by`: place 0 is the head, 1 the rule, 2 the rows.

    Lines of a place are ordered by their text where they are written. Bars and line ends in values are escaped; null is a dash.
    """
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    shown = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"\R", "<br>"), F.lit("-"))
    rows = report.select(*by, F.lit(2).alias("place"), line([shown(c) for c in columns]).alias("line"))
    top = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), line([F.lit(x) for x in cells]).alias("line")) for i, cells in enumerate((columns, ["---"] * len(columns))))))
    heads = report.select(*by).distinct() if by else report.sparkSession.range(1)
    return heads.select(*by, top.alias("t")).select(*by, "t.place", "t.line").unionByName(rows)


def annotations(findings: DataFrame) -> DataFrame:
    """SNK3: a warning or error line per finding."""
    level = F.when(F.col("severity").isin("error", "required"), "error").otherwise("warning")
    return findings.select(F.format_string("::%s title=%s::%s", level, "kind", F.regexp_replace("message", r"[\r\n]+", " ")).alias("line"))
