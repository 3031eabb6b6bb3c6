"""Run folders as artifact sets, the grading export and the telemetry envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators.contracts import canonical_json
from pairwell.operators.traces import operation_evidence

#: The marker's name, its version, and the files that every set has.
MARKER, VERSION = "artifact-commit.json", 1
REQUIRED = ("output.md", "events.json", "metrics.json", "metadata.json")
#: Where a measurement may come from.
PROVENANCE = ("provider_reported", "trace_normalized", "process_measured", "price_table_estimated", "estimated", "legacy_unverified")
#: Counters that hold only for a completely observed run.
OPERATIONS = ("tool_calls", "commands", "file_reads", "file_writes", "errors", "retries", "repeated_command_max")


def commit_markers(files: DataFrame, run: str, path: str, sha256: str) -> DataFrame:
    """SNK5: the marker of each run, to be written after its files; null if a required file is missing.

    A marker lists all files of one run folder, so its size is that of the folder's listing.
    """
    entries = F.array_sort(F.collect_list(F.struct(path, sha256)))
    g = files.filter(F.col(path) != MARKER).groupBy(run).agg(F.map_from_entries(entries).alias("inventory"))
    required = F.array(*map(F.lit, REQUIRED))
    marker = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), required.alias("required_files"), F.col("inventory").alias("inventory_sha256")))
    whole = F.size(F.array_except(required, F.map_keys("inventory"))) == 0
    return g.select(run, F.when(whole, marker).alias("marker"))


def _type(value: Column, path: str) -> Column:
    """The type of a member of a variant, null if it is not there."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def artifact_states(runs: DataFrame, files: DataFrame, run: str, declared: str, marker: str, path: str, sha256: str) -> DataFrame:
    """SRC5: legacy_undeclared, missing_commit, invalid_commit, incomplete or complete, and why.

    runs has the declared contract version and the marker's text of each run, null where there is none; files the
    files below it. Inventories are held against the files in one full outer join of narrow rows.
    """
    value = F.try_parse_json(canonical_json(F.col(marker)))
    typed = runs.select(run, F.col(declared).alias("__declared"), F.col(marker).alias("__marker"), value.alias("__value"))
    inventory = F.from_json(F.try_variant_get("__value", "$.inventory_sha256", "string"), "map<string,string>")
    parsed = typed.withColumn("__want", F.when(F.startswith(_type(F.col("__value"), "$.inventory_sha256"), F.lit("OBJECT")), inventory))
    listed = parsed.select(run, F.explode("__want").alias("__path", "__sha"))
    found = files.filter(F.col(path) != MARKER).select(run, F.col(path).alias("__path"), F.col(sha256).alias("__have"))
    sides = listed.join(found, [run, "__path"], "full_outer").groupBy(run).agg(
        F.count_if(F.col("__sha").isNull() | F.col("__have").isNull()).alias("__alone"), F.count_if(F.col("__sha") != F.col("__have")).alias("__stale")
    )
    odd_path = lambda p: (p == "") | F.startswith(p, F.lit("/")) | F.rlike(p, F.lit(r"^(\./?)+$|(^|/)\.\.(/|$)"))
    odd = F.exists(F.map_entries("__want"), lambda e: odd_path(e["key"]) | ~F.coalesce(F.rlike(e["value"], F.lit("^[0-9a-f]{64}$")), F.lit(False)))
    version = F.when(_type(F.col("__value"), "$.schema_version") == "BIGINT", F.try_variant_get("__value", "$.schema_version", "long"))
    required = F.from_json(F.try_variant_get("__value", "$.required_files", "string"), "array<string>")
    want = F.array(*map(F.lit, REQUIRED))
    reasons = (
        F.when(F.col("__declared") != VERSION, "invalid_commit:unsupported contract version")
        .when(F.col("__marker").isNull() & F.col("__declared").isNull(), "legacy_undeclared:")
        .when(F.col("__marker").isNull(), "missing_commit:no commit marker")
        .when(F.col("__declared").isNull(), "invalid_commit:no declared contract version")
        .when(F.col("__value").isNull(), "invalid_commit:invalid JSON")
        .when(~F.startswith(F.schema_of_variant("__value"), F.lit("OBJECT")), "invalid_commit:no object")
        .when(~F.coalesce(version == VERSION, F.lit(False)), "invalid_commit:unsupported schema version")
        .when(~F.coalesce(required == want, F.lit(False)), "invalid_commit:wrong required files")
        .when(F.col("__want").isNull(), "invalid_commit:no inventory")
        .when(odd, "invalid_commit:invalid path or digest")
        .when(F.size(F.array_except(want, F.map_keys("__want"))) > 0, "incomplete:a required file is not listed")
        .when(F.col("__alone") > 0, "incomplete:inventory and files differ")
        .when(F.col("__stale") > 0, "incomplete:a digest differs")
        .otherwise("complete:")
    )
    named = parsed.join(sides, run, "left").select(run, F.split(reasons, ":").alias("__r"))
    return named.select(run, F.col("__r")[0].alias("state"), F.nullif(F.col("__r")[1], F.lit("")).alias("reason"))


def grading_files(results: DataFrame, run: list[str], text: str, passed: str, evidence: str) -> DataFrame:
    """SNK4: the grading.json of each run: expectations in order of their text, and a summary; a run has few assertions."""
    expectation = F.struct(F.col(text).alias("text"), F.col(passed).alias("passed"), F.col(evidence).alias("evidence"))
    g = results.groupBy(*run).agg(F.array_sort(F.collect_list(expectation)).alias("expectations"), F.count_if(F.col(passed)).alias("ok"), F.count("*").alias("total"))
    summary = F.struct(F.col("ok").alias("passed"), (F.col("total") - F.col("ok")).alias("failed"), "total", F.round(F.col("ok") / F.col("total"), 4).alias("pass_rate"))
    return g.select(*run, F.to_json(F.struct("expectations", summary.alias("summary"))).alias("grading"))


def _measured(availability: Column, value: Column, provenance: Column, reason: Column) -> Column:
    return F.struct(availability.alias("availability"), value.cast("double").alias("value"), provenance.alias("provenance"), reason.alias("reason"))


def _available(value: Column, provenance: Column) -> Column:
    return _measured(F.lit("available"), value, provenance, F.lit(None).cast("string"))


def _unavailable(reason: Column, availability: str = "unavailable") -> Column:
    return _measured(F.lit(availability), F.lit(None), F.lit(None).cast("string"), reason)


def _whole(value: Column, path: str) -> Column:
    """A number that is whole and not negative; no text and no boolean."""
    number = F.when(F.rlike(_type(value, path), F.lit("^(BIGINT|DOUBLE|DECIMAL)")), F.try_variant_get(value, path, "double"))
    return F.when((number >= 0) & (number == F.floor(number)), number)


def _usage(value: Column, key: str) -> Column:
    source = F.try_variant_get(value, "$.usage_normalized.source", "string")
    block, legacy = _whole(value, f"$.usage_normalized.{key}"), _whole(value, f"$.{key}")
    told = F.coalesce(_type(value, f"$.{key}"), F.lit("VOID")) != "VOID"
    return (
        F.when(source == "missing", _unavailable(F.lit("missing")))
        .when(source == "not_applicable", _unavailable(F.lit("not_applicable"), "not_applicable"))
        .when(source.isNotNull() & block.isNull(), _unavailable(F.lit(f"missing_{key}")))
        .when(source.isNotNull() & ~source.isin(*PROVENANCE), _unavailable(F.lit("unknown_usage_provenance")))
        .when(source.isNotNull(), _available(block, source))
        .when(told & legacy.isNull(), _unavailable(F.lit(f"invalid_legacy_{key}")))
        .when(told, _available(legacy, F.lit("legacy_unverified")))
        .otherwise(_unavailable(F.lit("missing")))
    )


def envelope(raw: Column, process: Column, provider: Column, trace: Column) -> Column:
    """CST2: the version-3 measurements of a run, from its metadata (a JSON text).

    Tokens come from the normalised block, else from a legacy field; elapsed time from either of its fields;
    operation counters only where process, provider response and trace were all observed completely.
    """
    value = F.try_parse_json(raw)
    elapsed = F.when(F.coalesce(_type(value, "$.elapsed_ms"), F.lit("VOID")) != "VOID", _whole(value, "$.elapsed_ms")).otherwise(_whole(value, "$.duration_ms"))
    evidence = operation_evidence(process, provider, trace)
    fields = [_usage(value, k).alias(k) for k in ("input_tokens", "output_tokens", "total_tokens")]
    fields.append(F.when(elapsed.isNull(), _unavailable(F.lit("missing_elapsed_ms"))).otherwise(_available(elapsed, F.lit("process_measured"))).alias("elapsed_ms"))
    for name in OPERATIONS:
        count = _whole(value, f"$.{name}")
        fields.append(
            F.when(evidence != "complete", _unavailable(evidence)).when(count.isNull(), _unavailable(F.lit(f"missing_{name}")))
            .otherwise(_available(count, F.lit("process_measured"))).alias(name)
        )
    return F.struct(F.lit(3).alias("schema_version"), F.struct(*fields).alias("measurements"))
