"""Trace normalisation and predicates on a run's events; missing evidence fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The words of a status, and the kinds of event that prove a state by themselves.
COMPLETED = ("completed", "complete", "succeeded", "success", "done", "finished")
RUNNING = ("in_progress", "started", "running", "pending", "queued")
FAILED = ("failed", "failure", "error", "errored", "cancelled", "canceled", "timed_out", "timeout")
TERMINAL_KINDS = (
    "result", "response.completed", "item.completed", "message_end", "turn_end",
    "agent_end", "tool_execution_end", "command_end", "usage", "metric",
)
START_KINDS = ("item.started", "agent_start", "tool_execution_start", "command_start")


def event_state(status: Column, kind: Column | None = None, present: Column | None = None) -> Column:
    """TRC1: a status that is there but unknown or blank stays unknown; only where there is none may the kind tell."""
    return state_and_source(status, kind, present)["state"]


def state_and_source(status: Column, kind: Column | None = None, present: Column | None = None, legacy: Column | None = None) -> Column:
    """TRC1, SRC9: state and what it was read from.

    present says that the event has a status field, whatever is in it; legacy,
    that the log is of version 1, whose events without a status are complete.
    """
    s = F.lower(F.btrim(status))
    kind = F.lower(F.btrim(kind)) if kind is not None else F.lit(None).cast("string")
    present = present if present is not None else F.lit(False)
    legacy = legacy if legacy is not None else F.lit(False)
    both = lambda state, source: F.struct(F.lit(state).alias("state"), F.lit(source).alias("source"))
    unknown = both("unknown", "unknown")
    by_status = F.when(s.isin(*COMPLETED), both("completed", "provider_status")).when(s.isin(*RUNNING), both("in_progress", "provider_status"))
    by_status = by_status.when(s.isin(*FAILED), both("failed", "provider_status")).otherwise(unknown)
    return (
        F.when(F.coalesce(s, F.lit("")) != "", by_status)
        .when(present, unknown)
        .when(kind.isin(*TERMINAL_KINDS), both("completed", "provider_event_kind"))
        .when(kind.isin(*START_KINDS), both("in_progress", "provider_event_kind"))
        .when(legacy, both("completed", "legacy_assumed_completed"))
        .otherwise(unknown)
    )


def event_log_state(version: Column, status: Column) -> Column:
    """SRC9: state and source of an event of a stored log: version 1 takes a missing status for completed, version 2 for unknown."""
    both = lambda state, source: F.struct(F.lit(state).alias("state"), F.lit(source).alias("source"))
    missing = F.when(version == 1, both("completed", "legacy_assumed_completed")).otherwise(both("unknown", "unknown"))
    return F.when(status.isNull(), missing).otherwise(state_and_source(status, present=F.lit(True)))


def kind_of(raw: Column) -> Column:
    """TRC2: by whole words of the raw type, never by substring."""
    words = F.split(F.lower(raw), "[._]")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    return F.when(has("read", "view"), "file_read").when(has("write", "edit"), "file_write").when(has("command", "shell", "bash"), "command").when(has("error"), "error").otherwise("event")


def open_calls(events: DataFrame, run: str, call: str, kind: str) -> DataFrame:
    """TRC3: calls of each run that were closed; a call without a close counts zero."""
    opens = events.filter(F.col(kind) == "open").select(run, call).distinct()
    closes = events.filter(F.col(kind) == "close").select(run, call, F.lit(1).alias("closed")).distinct()
    return opens.join(closes, [run, call], "left").groupBy(run).agg(
        F.count("*").alias("opened"), F.coalesce(F.sum("closed"), F.lit(0)).alias("completed_calls")
    )


def longest_repeat(events: DataFrame, run: str = "run_id", order: str = "index", name: str = "name") -> DataFrame:
    """PRC11: the longest stretch of identical names in a row, as gaps and islands."""
    w = Window.partitionBy(run).orderBy(order)
    per = Window.partitionBy(run, name).orderBy(order)
    islands = events.withColumn("__island", F.row_number().over(w) - F.row_number().over(per))
    sizes = islands.groupBy(run, name, "__island").agg(F.count("*").alias("n"))
    return sizes.groupBy(run).agg(F.max("n").alias("repeated_command_max"))


def metrics(events: DataFrame, run: str = "run_id") -> DataFrame:
    """TRC4: counts of completed actions, errors and the longest repeat of each run."""
    done = F.col("status") == "completed"
    count = lambda kind: F.count_if(done & (F.col("type") == kind))
    rollup = events.groupBy(run).agg(
        count("tool_call").alias("tool_calls"),
        count("command").alias("commands"),
        count("file_read").alias("file_reads"),
        count("file_write").alias("file_writes"),
        F.count_if(F.col("status") == "failed").alias("errors"),
        (F.count_if(F.col("type") == "skill_load") > 0).alias("skill_invoked"),
    )
    return rollup.join(longest_repeat(events.filter(done), run), run, "left")


def ran(events: DataFrame, pattern: str, run: str = "run_id") -> DataFrame:
    """PRC1 to PRC3, PRC7: whether a completed command's name matches, and whether any call does."""
    hit = F.rlike("name", F.lit(pattern))
    return events.groupBy(run).agg(
        F.bool_or(hit & (F.col("status") == "completed")).alias("command_ran"), F.bool_or(hit).alias("called_at_all")
    )


def in_order(events: DataFrame, names: list[str], run: str = "run_id") -> DataFrame:
    """PRC4, PRC6: whether completed events have the names as a subsequence, taken greedily."""
    done = events.filter(F.col("status") == "completed").select(run, "index", "name")
    met = done.groupBy(run).agg(F.lit(-1).cast("long").alias("__at"))
    for name in names:  # one number a run: the least index of this name after that of the one before
        here = done.filter(F.col("name") == name).select(run, F.col("index").alias("__index"))
        after = met.join(here, run).filter(F.col("__index") > F.col("__at")).groupBy(run).agg(F.min("__index").cast("long").alias("__next"))
        met = met.join(after, run, "left").select(run, F.col("__next").alias("__at"))
    return met.select(run, F.col("__at").isNotNull().alias("in_order"))


def call_sets(events: DataFrame, expected: list[str], run: str = "run_id") -> DataFrame:
    """PRC5, PRC8 to PRC10: required calls as a set, exact calls as a multiset, and their count; only counts are kept of a run."""
    counts = {name: expected.count(name) for name in sorted(set(expected))}
    seen = {n: F.count_if(F.col("name") == n) for n in counts}
    required, exact = F.lit(True), F.count("*") == len(expected)
    for n, times in counts.items():
        required, exact = required & (seen[n] > 0), exact & (seen[n] == times)
    return events.filter(F.col("status") == "completed").groupBy(run).agg(
        required.alias("required_calls"), exact.alias("call_set"), F.count("*").cast("int").alias("tool_count")
    )


def calls_between(events: DataFrame, pattern: str, least: int, most: int, run: str = "run_id") -> DataFrame:
    """PRC5: whether the completed calls whose name matches are from least to most in number."""
    n = F.count_if((F.col("status") == "completed") & F.rlike("name", F.lit(pattern)))
    return events.groupBy(run).agg(n.between(least, most).alias("calls_ok"))


def at_most(value: Column, limit: float) -> Column:
    """EFF1 to EFF3: null evidence fails."""
    return F.coalesce(value <= limit, F.lit(False))


def one_alias(columns: list[Column]) -> tuple[Column, Column]:
    """TRC5: the value that aliases agree on, and whether they conflict."""
    seen = F.array_distinct(F.array_compact(F.array(*columns)))
    return F.when(F.size(seen) == 1, F.element_at(seen, 1)), F.size(seen) > 1


def stream_totals(events: DataFrame, run: str, terminal: Column, value: str, order: str) -> DataFrame:
    """TRC6: the last cumulative result wins; without one, the deltas add up."""
    return events.groupBy(run).agg(
        F.coalesce(F.max_by(F.when(terminal, F.col(value)), F.when(terminal, F.col(order))), F.sum(F.when(~terminal, F.col(value)))).alias("total")
    )


def trajectory(events: DataFrame, run: str = "run_id") -> DataFrame:
    """TRC8: completed actions of each run, a row each, numbered from 1 in order."""
    step = F.row_number().over(Window.partitionBy(run).orderBy("index"))
    return events.filter(F.col("status") == "completed").select(run, step.alias("step"), "index", "type", "name")


def operation_evidence(process: Column, provider: Column, trace: Column) -> Column:
    """TRC9: the first channel that is not complete names the reason."""
    return F.when(~process, "process_observation_incomplete").when(~provider, "provider_response_incomplete").when(~trace, "trace_observation_incomplete").otherwise("complete")
