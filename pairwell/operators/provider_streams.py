"""SRC13: the lifecycle of provider streams stored as JSON lines, as joins and aggregates over the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The events of a stream.
KINDS = ("init", "message", "tool_use", "tool_result", "error", "result")


def _blank(value):
    return F.btrim(F.coalesce(value, F.lit(""))) == ""


def stream_records(lines: DataFrame, run: str, order: str, line: str) -> DataFrame:
    """A row per line that is not blank: its kind, the fields of its kind, and what is wrong with it by itself."""
    at = lambda name: F.get_json_object(line, f"$.{name}")
    kind, status, failure = at("type"), at("status"), at("error")
    outcome = ~F.coalesce(status.isin("success", "error"), F.lit(False))
    wrong = (
        F.when(F.json_object_keys(line).isNull(), "no object")
        .when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown event")
        .when(_blank(at("timestamp")), "no timestamp")
        .when((kind == "init") & (_blank(at("session_id")) | _blank(at("model"))), "init without session or model")
        .when((kind == "message") & ~F.coalesce(at("role").isin("user", "assistant"), F.lit(False)), "unknown role")
        .when((kind == "message") & at("content").isNull(), "message without content")
        .when(kind.isin("tool_use", "tool_result") & _blank(at("tool_id")), "call without id")
        .when((kind == "tool_use") & _blank(at("tool_name")), "call without name")
        .when((kind == "tool_use") & F.json_object_keys(at("parameters")).isNull(), "call without parameters")
        .when(kind.isin("tool_result", "result") & outcome, "unknown status")
        .when(kind.isin("tool_result", "result") & (status == "success") & failure.isNotNull(), "success with an error")
        .when((kind == "error") & ~F.coalesce(at("severity").isin("warning", "error"), F.lit(False)), "unknown severity")
        .when((kind == "error") & _blank(at("message")), "error without message")
    )
    return lines.filter(~_blank(F.col(line))).select(
        F.col(run).alias("run"), F.col(order).alias("at"), kind.alias("kind"), wrong.alias("wrong"), at("role").alias("role"), at("content").alias("content"),
        at("tool_id").alias("call"), status.alias("status"), F.coalesce(at("error.message"), failure, at("message")).alias("message"), at("severity").alias("severity"),
    )


def stream_outcomes(lines: DataFrame, run: str = "run_id", order: str = "line_number", line: str = "line") -> DataFrame:
    """run, status (complete, provider_error or protocol_invalid), reason, answer and tool_calls of each stream.

    A stream has one init, at its start, and one result, at its end; every call
    is made once and answered once, afterwards. The answer is what the assistant
    says after the last user message or tool event. A run without lines gives
    no row; malformed records make their stream invalid and no other.
    """
    records = stream_records(lines, run, order, line)
    is_ = lambda kind: F.col("kind") == kind
    last = lambda what, where: F.max_by(F.when(where, F.col(what)), F.when(where, F.col("at")))
    failed = is_("error") & (F.col("severity") == "error")
    shape = records.groupBy("run").agg(
        F.min_by("kind", "at").alias("first"),
        F.max_by("kind", "at").alias("final"),
        F.count_if(is_("init")).alias("inits"),
        F.count_if(is_("result")).alias("results"),
        F.min_by(F.when(F.col("wrong").isNotNull(), F.col("wrong")), F.when(F.col("wrong").isNotNull(), F.col("at"))).alias("wrong"),
        F.max(F.when(is_("tool_use") | is_("tool_result") | (is_("message") & (F.col("role") == "user")), F.col("at"))).alias("reset"),
        last("message", failed).alias("failure"),
        last("status", is_("result")).alias("status"),
        last("message", is_("result")).alias("result_failure"),
        F.count_if(is_("tool_result")).alias("tool_calls"),
    )
    uses, answers = F.count_if(is_("tool_use")), F.count_if(is_("tool_result"))
    late = F.min(F.when(is_("tool_result"), F.col("at"))) > F.min(F.when(is_("tool_use"), F.col("at")))
    calls = records.filter(F.col("call").isNotNull()).groupBy("run", "call").agg(
        ((uses > 1) | (answers > 1) | ((answers > 0) & ~F.coalesce(late, F.lit(False)))).alias("misused"), ((uses > 0) & (answers == 0)).alias("open")
    )
    calls = calls.groupBy("run").agg(F.bool_or("misused").alias("misused"), F.bool_or("open").alias("open"))
    said = records.filter(is_("message") & (F.col("role") == "assistant")).join(shape.select("run", "reset"), "run")
    said = said.filter(F.col("at") > F.coalesce("reset", F.lit(-1))).groupBy("run")
    answer = said.agg(F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda m: m["content"]), "")).alias("answer"))
    found = shape.join(calls, "run", "left").join(answer, "run", "left")
    provider = F.when(F.col("status") == "error", F.coalesce("result_failure", "failure", F.lit("the result reports an error"))).otherwise(F.col("failure"))
    protocol = (
        F.when(F.col("wrong") == "no object", "no object")
        .when(~F.coalesce(F.col("first") == "init", F.lit(False)), "missing init")
        .when(F.col("inits") > 1, "more than one init")
        .when((F.col("results") != 1) | ~F.coalesce(F.col("final") == "result", F.lit(False)), "no terminal result")
        .when(F.col("wrong").isNotNull(), F.col("wrong"))
        .when(F.col("misused"), "call repeated or not made")
        .when(F.col("open"), "dangling tool call")
        .when(provider.isNull() & (F.coalesce("answer", F.lit("")) == ""), "missing final answer")
    )
    return found.select(
        F.col("run").alias(run),
        F.when(protocol.isNotNull(), "protocol_invalid").when(provider.isNotNull(), "provider_error").otherwise("complete").alias("status"),
        F.coalesce(protocol, provider).alias("reason"),
        F.when(protocol.isNull(), F.coalesce("answer", F.lit(""))).alias("answer"),
        F.when(protocol.isNull(), F.col("tool_calls")).alias("tool_calls"),
    )
