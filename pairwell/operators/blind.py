"""Blind comparisons of two variants: tasks without names, a truth table beside them, and answers held against it (CMP1, CMP2).

Outputs are hashed where they are scanned, so one shuffle of narrow rows pairs the arms, and one more pairs tasks and
answers. Nothing is dropped: an identity or answer that cannot be used is a row with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators.contracts import json_digest

IDENTITY = ("case_id", "model", "run_number")
#: What a reviewer may see; the rest of a task belongs to the truth table.
OPEN = ("comparison_task_id", *IDENTITY, "prompt_sha256", "output_a_sha256", "output_b_sha256", "comparison_task_sha256")


def _task_id(primary: str, baseline: str) -> Column:
    run = F.concat(F.lit("run-"), F.col("run_number").cast("string"))
    return F.concat_ws("::", "case_id", "model", run, F.lit(f"blind-{primary}-vs-{baseline}"))


def blind_tasks(arms: DataFrame, primary: str, baseline: str, seed: int) -> DataFrame:
    """CMP1: a row for each (case_id, model, run_number) of either variant, with its task or the reason why there is none.

    arms has these columns, variant, scorable, prompt and output. The two variants must have the same identities, one row
    each; both have to be scorable and their outputs not blank, and they must answer the same prompt. Null scorable is no.
    Side A is the primary if the first hex digit of SHA-256("seed:task id") is below 8, so the sides do not depend on
    partitions or retries. The task digest is that of the canonical JSON of all that the reviewer sees.
    """
    mine = F.col("variant") == primary
    own = lambda column, yes: F.max(F.when(mine if yes else ~mine, F.col(column)))
    g = (
        arms.filter(F.col("variant").isin(primary, baseline))
        .select(
            *IDENTITY, "variant", F.coalesce("scorable", F.lit(False)).alias("scorable"), F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt"),
            F.rlike(F.coalesce("output", F.lit("")), F.lit(r"(?U)\A\s*\z")).alias("blank"), F.sha2(F.coalesce("output", F.lit("")), 256).alias("output"),
        )
        .groupBy(*IDENTITY)
        .agg(
            F.count_if(mine).alias("primaries"), F.count_if(~mine).alias("baselines"), F.bool_and("scorable").alias("scorable"), F.bool_or("blank").alias("blank"),
            F.min("prompt").alias("prompt"), F.max("prompt").alias("other_prompt"), own("output", True).alias("primary"), own("output", False).alias("baseline"),
        )
    )
    reason = (
        F.when((F.col("primaries") > 1) | (F.col("baselines") > 1), "duplicate_identity")
        .when(F.col("primaries") == 0, "missing_primary")
        .when(F.col("baselines") == 0, "missing_baseline")
        .when(~F.col("scorable"), "unscorable_arm")
        .when(F.col("blank"), "blank_output")
        .when(F.col("prompt") != F.col("other_prompt"), "prompts_differ")
    )
    named = g.withColumn("comparison_task_id", _task_id(primary, baseline)).withColumn("reason", reason)
    first = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "comparison_task_id"), 256), 1, 1) < "8"
    shown = lambda column: F.when(F.col("reason").isNull(), column)
    sided = named.select(
        *IDENTITY, "comparison_task_id", "reason", shown(F.col("prompt")).alias("prompt_sha256"), shown(F.when(first, "primary").otherwise("baseline")).alias("a_role"),
        shown(F.when(first, F.col("primary")).otherwise(F.col("baseline"))).alias("output_a_sha256"), shown(F.when(first, F.col("baseline")).otherwise(F.col("primary"))).alias("output_b_sha256"),
    )
    identity = F.to_json(F.struct("comparison_task_id", *IDENTITY, "prompt_sha256", "output_a_sha256", "output_b_sha256"), {"ignoreNullFields": "false"})
    return sided.withColumn("comparison_task_sha256", shown(json_digest(identity)))


def reviewer_rows(tasks: DataFrame) -> DataFrame:
    """CMP1: the tasks as a reviewer gets them: no roles."""
    return tasks.filter("reason IS NULL").select(*OPEN)


def truth_rows(tasks: DataFrame) -> DataFrame:
    """CMP1: the truth table: each task's id, digest and the role behind A."""
    return tasks.filter("reason IS NULL").select("comparison_task_id", "comparison_task_sha256", "a_role")


def comparison_details(truth: DataFrame, results: DataFrame) -> DataFrame:
    """CMP2: a row for each task id of either side: its winner and the role that won, or why the answer is refused.

    results has comparison_task_id, comparison_task_sha256, schema_version, observation_complete, returncode and winner.
    Truth and answers must cover each other exactly, once each; the digest must be the task's, so an answer to outputs that
    have changed since is stale. The winner is A, B or TIE after trimming, in either case of letters.
    """
    said = ("comparison_task_sha256", "schema_version", "observation_complete", "returncode", "winner")
    t = truth.select("comparison_task_id", F.struct(F.col("comparison_task_sha256").alias("sha"), "a_role").alias("t"), F.lit(None).alias("r"))
    r = results.select("comparison_task_id", F.lit(None).alias("t"), F.struct(*said).alias("r"))
    g = t.unionByName(r).groupBy("comparison_task_id").agg(F.count("t").alias("tasks"), F.count("r").alias("answers"), F.max("t").alias("t"), F.max("r").alias("r"))
    winner = F.upper(F.btrim("r.winner"))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    reason = (
        F.when(F.col("comparison_task_id").isNull(), "missing_id")
        .when(F.col("tasks") > 1, "duplicate_truth")
        .when(F.col("answers") > 1, "duplicate_result")
        .when(F.col("tasks") == 0, "unexpected_result")
        .when(F.col("answers") == 0, "missing_result")
        .when(bad(F.col("r.schema_version") == 1), "unsupported_schema")
        .when(bad(F.col("r.observation_complete")), "incomplete_observation")
        .when(bad(F.col("r.returncode") == 0), "failed_reviewer")
        .when(bad(F.col("r.comparison_task_sha256") == F.col("t.sha")), "stale_task")
        .when(bad(winner.isin("A", "B", "TIE")), "invalid_winner")
    )
    of_a = F.col("t.a_role") == "primary"
    role = F.when(winner == "TIE", "tie").when((winner == "A") == of_a, "primary").otherwise("baseline")
    return g.withColumn("reason", reason).select(
        "comparison_task_id", "reason", F.when(F.col("reason").isNull(), winner).alias("winner"), F.when(F.col("reason").isNull(), role).alias("winning_role")
    )


def comparison_summary(details: DataFrame, expected: DataFrame) -> DataFrame:
    """CMP2: one row: coverage and counts by role. Counts are null unless no answer and no task (`expected` has all identities) is refused."""
    d = details.agg(F.count("*").alias("ids"), F.count("reason").alias("refused"), *(F.count_if(F.col("winning_role") == w).alias(w) for w in ("primary", "baseline", "tie")))
    e = expected.agg(F.count("*").alias("expected"), F.count("reason").alias("blocked"))
    whole = (F.col("refused") == 0) & (F.col("blocked") == 0) & (F.col("ids") == F.col("expected"))
    both = d.crossJoin(e).withColumn("comparison_complete", whole)  # one row each
    counts = [F.when(F.col("comparison_complete"), F.col(w)).alias(w) for w in ("primary", "baseline", "tie")]
    return both.select("comparison_complete", "expected", "blocked", "refused", *counts)
