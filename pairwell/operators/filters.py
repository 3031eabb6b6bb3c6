"""Run validity, stop reasons, served models, sources and status normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop reasons of the messages interface and their classes.
STOPS = {
    "end_turn": "completed", "stop_sequence": "completed", "max_tokens": "truncated",
    "model_context_window_exceeded": "truncated", "refusal": "refused",
}
#: Status names of a run service and its lifecycle.
LIFECYCLE = {
    "queued": "queued", "pending": "queued", "running": "running", "in_progress": "running", "succeeded": "succeeded", "completed": "succeeded",
    "failed": "failed", "error": "failed", "timed_out": "timed_out", "timeout": "timed_out",
}


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def stop_class(reason: Column, subtype: Column | None = None) -> Column:
    """FLT4: the class of a stop reason, word for word; blank is unavailable, an unknown or oddly spelt one is other.

    subtype: that of the run's result event; a step budget that ran out outranks the last message's reason.
    """
    by_word = F.when(F.coalesce(F.btrim(reason), F.lit("")) == "", "unavailable").otherwise(F.coalesce(_lookup(STOPS, reason), F.lit("other")))
    return by_word if subtype is None else F.when(subtype == "error_max_turns", "turn_limit").otherwise(by_word)


def unscorable(stop: Column, served_check: Column) -> Column:
    """FLT3: why a completion cannot be scored; null if it can."""
    return F.when(stop.isin("truncated", "turn_limit"), F.concat(F.lit("stopped:"), stop)).when(served_check == "mismatch", "served_model_mismatch")


def execution_valid(lifecycle_error: Column, reason: Column, returncode: Column, timed_out: Column, text: Column, markers: Sequence[str]) -> Column:
    """FLT2: nothing says that the run failed, and its text does not begin with a failure marker."""
    lead = F.ltrim(F.coalesce(text, F.lit("")))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.startswith(lead, F.lit(m))
    return ~(F.coalesce(lifecycle_error, F.lit(False)) | reason.isNotNull() | (F.coalesce(returncode, F.lit(0)) != 0) | F.coalesce(timed_out, F.lit(False)) | marked)


def in_scope(variant: Column, only: Column, excluded: Column) -> Column:
    """FLT7: an assertion holds for a variant that its list names, or that its exceptions do not."""
    return (F.size(only) <= 0) | F.coalesce(F.array_contains(only, variant), F.lit(True)) & ~F.coalesce(F.array_contains(excluded, variant), F.lit(False))


def lifecycle(status: Column, state: Column) -> Column:
    """SRC14: one lifecycle of two fields; if they disagree, or neither is known, the record is invalid."""
    a, b = _lookup(LIFECYCLE, F.lower(status)), _lookup(LIFECYCLE, F.lower(state))
    known = (status.isNull() | a.isNotNull()) & (state.isNull() | b.isNotNull()) & F.coalesce(a, b).isNotNull()
    return F.when(known & (a.isNull() | b.isNull() | (a == b)), F.coalesce(a, b)).otherwise("protocol_invalid")


def fill_template(template: Column, keys: Sequence[str], values: Sequence[Column]) -> Column:
    """SRC3: replaces {key}; other braces stay."""
    for k, v in zip(keys, values):
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def artifact_status(inventory: DataFrame, files: DataFrame, run: str, path: str, digest: str) -> DataFrame:
    """SRC5: complete if the inventory names exactly the files there, each with its digest."""
    i = inventory.select(run, path, F.col(digest).alias("__want"))
    f = files.select(run, path, F.col(digest).alias("__have"))
    both = i.join(f, [run, path], "full_outer")
    g = both.groupBy(run).agg(
        F.count("__want").alias("listed"), F.count("__have").alias("present"), F.count_if(F.col("__want") == F.col("__have")).alias("matching")
    )
    status = F.when(F.col("listed") == 0, "missing_commit").when((F.col("matching") == F.col("listed")) & (F.col("listed") == F.col("present")), "complete").otherwise("incomplete")
    return g.withColumn("status", status)


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """SRC10: ids that a result file has more than once; a load with any is refused."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def judgements(rows: DataFrame, verdict: str) -> DataFrame:
    """SRC12: pass, fail or unsure, older good and bad included, word for word; a blank verdict is a note alone; anything else stays as it is, marked unparsed."""
    v = F.col(verdict)
    known = F.when(v.isin("pass", "good"), "pass").when(v.isin("fail", "bad"), "fail").when(v == "unsure", "unsure")
    return rows.withColumn("judgement", known).withColumn("parsed", known.isNotNull() | v.isNull() | (v == ""))


def junit(results: DataFrame, suite: Column, case: Column, failed: Column) -> DataFrame:
    """SNK2: the lines of one JUnit document per suite, to be written in order of place and line.

    A testcase per result, soft failures are not failures. A suite is never gathered: its head carries the counts.
    """
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    line = F.concat(F.lit('<testcase name="'), esc(case), F.when(failed, F.lit('"><failure/></testcase>')).otherwise(F.lit('"/>')))
    g = results.groupBy(suite.alias("suite")).agg(F.count("*").alias("tests"), F.count_if(failed).alias("failures"))
    head = F.format_string('<testsuite name="%s" tests="%s" failures="%s">', esc(F.col("suite")), "tests", "failures")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("place"), head.alias("line")), F.struct(F.lit(2).alias("place"), F.lit("</testsuite>").alias("line"))))
    cases = results.select(suite.alias("suite"), F.lit(1).alias("place"), line.alias("line"))
    return cases.unionByName(g.select("suite", ends.alias("__e")).select("suite", "__e.place", "__e.line"))


def ablation_verdicts(paired: DataFrame, by: Sequence[str], expected_pairs: Column) -> DataFrame:
    """ABL2 to ABL4: a drop counts if pairs are complete and unblocked; six moved pairs one way are needed to confirm."""
    delta = F.col("treatment_rate") - F.col("control_rate")
    good = F.col("status") == "pair"
    g = paired.groupBy(*by).agg(
        F.count_if(good).alias("pairs"),
        F.count_if(~good).alias("blocked"),
        F.count_if(good & (delta > 0)).alias("drops"),
        F.count_if(good & (delta < 0)).alias("rises"),
    )
    covered = (F.col("blocked") == 0) & (F.col("pairs") >= expected_pairs)
    verdict = F.when(~covered, "indeterminate").when(F.col("drops") <= F.col("rises"), "refuted").when((F.col("drops") >= 6) & (F.col("rises") == 0), "confirmed_causal").otherwise("indeterminate")
    return g.withColumn("verdict", verdict)


def measurement(value: Column, provenance: Column, sources: Sequence[str]) -> tuple[Column, Column]:
    """CST1: availability and reason of one reported value."""
    bad = F.when(value.isNull(), "missing").when(value < 0, "invalid").when(~provenance.isin(*sources), "unknown_provenance")
    return F.when(bad.isNull(), "complete").otherwise("unavailable"), bad
