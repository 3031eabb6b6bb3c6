"""Probes of a judge: the rubric turned round, an empty answer and a master key (JDG13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The calls of a task, the controls that a sound judge rejects, and the kinds of findings.
PROBES = ("base", "flipped", "empty", "master-key")
CONTROLS = ("empty", "master-key")
INCOMPLETE, FLIPPED = "judge-call-incomplete", "order-flip-inconsistent"


def probe_tasks(calls: DataFrame, task: str = "task_id") -> DataFrame:
    """JDG13: a row for each task: whether turning the order keeps the verdict, whether each control passes, and findings.

    calls has task, probe, passed and complete, and may repeat a probe: it is complete if all its calls are, a control
    passes if any of its calls does, and the order counts as kept if all calls of base and flipped agree. A call that was
    not made, is not complete or has no verdict leaves null, with a finding for each such probe; other probes are ignored.
    """
    aggregates = []
    for p in PROBES:
        here = F.col("probe") == p
        good = F.coalesce(F.col("complete") & F.col("passed").isNotNull(), F.lit(False))
        aggregates += [
            (F.coalesce(F.bool_and(F.when(here, good)), F.lit(False))).alias(f"{p}_whole"),
            F.bool_or(F.when(here, F.col("passed"))).alias(f"{p}_any"),
            F.bool_and(F.when(here, F.col("passed"))).alias(f"{p}_all"),
        ]
    g = calls.groupBy(task).agg(*aggregates)
    col = lambda p, what: F.col(f"{p}_{what}")
    kept = (col("base", "any") == col("base", "all")) & (col("flipped", "any") == col("flipped", "all")) & (col("base", "any") == col("flipped", "any"))
    consistent = F.when(col("base", "whole") & col("flipped", "whole"), kept)
    passed = {p: F.when(col(p, "whole"), col(p, "any")) for p in CONTROLS}
    findings = F.array_compact(
        F.array(
            *(F.when(~col(p, "whole"), INCOMPLETE) for p in PROBES),
            F.when(~consistent, FLIPPED),
            *(F.when(passed[p], f"passes-{p}-control") for p in CONTROLS),
        )
    )
    return g.select(task, consistent.alias("order_flip_consistent"), passed["empty"].alias("empty_passed"), passed["master-key"].alias("master_key_passed"), findings.alias("findings"))


def probe_findings(tasks: DataFrame, task: str = "task_id") -> DataFrame:
    """JDG13: a row for each finding."""
    return tasks.select(task, F.explode("findings").alias("kind"))


def probe_summary(tasks: DataFrame) -> DataFrame:
    """JDG13: one row: the share of tasks that keep their verdict and the share of controls that pass; null if any call it rests on is incomplete."""
    controls = [F.col("empty_passed"), F.col("master_key_passed")]
    known, leaks = (sum((F.when(test(c), 1).otherwise(0) for c in controls), F.lit(0)) for test in (lambda c: c.isNotNull(), lambda c: c))
    s = tasks.agg(
        F.count("*").alias("n"), F.count("order_flip_consistent").alias("flips"), F.count_if("order_flip_consistent").alias("kept"), F.sum(known).alias("controls"), F.sum(leaks).alias("leaks"),
        F.count_if(F.array_contains("findings", INCOMPLETE)).alias("partial"), F.sum(F.size("findings")).alias("findings"),
    )
    some = F.col("n") > 0
    return s.select(
        "n",
        F.when(~some, "unavailable").when(F.col("partial") == 0, "complete").otherwise("partial").alias("availability"),
        F.when(some & (F.col("flips") == F.col("n")), F.round(F.col("kept") / F.col("n"), 6)).alias("order_flip_consistency"),
        F.when(some & (F.col("controls") == len(CONTROLS) * F.col("n")), F.round(F.col("leaks") / F.col("controls"), 6)).alias("control_leak_rate"),
        F.coalesce("findings", F.lit(0)).cast("long").alias("findings"),
    )
