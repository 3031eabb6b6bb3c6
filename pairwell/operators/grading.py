"""Grading rollups, judge verdicts and agreement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators.lineage import cut


def assertion_state(passed: Column, skipped: Column) -> Column:
    """GRD1: skipped wins, then an unknown result is unavailable."""
    return F.when(skipped, "skipped").when(passed.isNull(), "unavailable").when(passed, "satisfied").otherwise("failed")


def grade(results: DataFrame, run: Sequence[str] = ("run_id",), strict: bool = False) -> DataFrame:
    """GRD2 to GRD4: pass rate over gate and critical assertions, critical veto, mean soft score.

    strict makes soft assertions count as gates.
    """
    marked = results.withColumn("__state", assertion_state(F.col("passed"), F.col("skipped")))
    severity = F.when((F.col("severity") == "soft") & F.lit(strict), "gate").otherwise(F.col("severity"))
    known = F.col("__state").isin("satisfied", "failed")
    counts = severity.isin("gate", "critical") & known
    veto = F.coalesce(F.bool_or((severity == "critical") & (F.col("__state") == "failed")), F.lit(False))
    graded = marked.groupBy(*run).agg(
        F.count_if(counts).alias("counted"),
        F.count_if(counts & (F.col("__state") == "satisfied")).alias("satisfied"),
        veto.alias("critical_failure"),
        F.avg(F.when((severity == "soft") & known, F.col("score"))).alias("__soft"),
    )
    rate = F.when(F.col("counted") > 0, F.when(F.col("critical_failure"), 0.0).otherwise(F.col("satisfied") / F.col("counted")))
    return graded.withColumn("pass_rate", rate).withColumn("graded_score", F.when(~F.col("critical_failure"), F.col("__soft"))).drop("__soft")


def closure(needs: DataFrame) -> DataFrame:
    """Every name with all its direct and indirect prerequisites, a row each; ValueError on a cycle.

    Each round joins the pairs found so far with themselves, so a chain of n takes log2(n) rounds, and pairs are kept
    once however many paths lead to them. Rounds are written to the checkpoint folder, not recomputed.
    """
    reach = cut(needs.select("name", "prerequisite").filter("name IS NOT NULL AND prerequisite IS NOT NULL").distinct())
    size = reach.count()
    while True:
        further = reach.alias("l").join(reach.alias("r"), F.col("l.prerequisite") == F.col("r.name")).select("l.name", "r.prerequisite")
        reach = cut(reach.union(further).distinct())
        before, size = size, reach.count()
        if size == before:
            break
    if (found := reach.filter("name = prerequisite").agg(F.min("name")).first()[0]) is not None:
        raise ValueError(f"dependency cycle through {found}")
    return reach


def skip_dependents(results: DataFrame, needs: DataFrame, run: str = "run_id") -> DataFrame:
    """GRD5: whoever depends, directly or not, on a failed or skipped assertion of its run is skipped.

    needs: rows of name and prerequisite, of one suite: it is small beside results, which are joined once with its closure.
    A cycle is an error.
    """
    closed = closure(needs)
    bad = results.filter("skipped OR NOT passed").select(run, F.col("name").alias("prerequisite"))
    hit = bad.join(closed, "prerequisite").select(run, "name").distinct().withColumn("__hit", F.lit(True))
    return results.join(hit, [run, "name"], "left").withColumn("skipped", F.coalesce("__hit", "skipped")).drop("__hit")


def judge_task_id(case: Column, model: Column, variant: Column, run: Column, name: Column) -> Column:
    """GRD9: parts joined by `::`, a null model left out; null where a part holds the joint itself, for two tasks could then have one id."""
    joint = F.lit("::")
    odd = reduce(lambda a, b: a | b, (F.coalesce(F.contains(p, joint), F.lit(False)) for p in (case, model, variant, name)))
    return F.when(~odd, F.concat_ws("::", case, model, variant, F.concat(F.lit("run-"), run.cast("string")), name))


def merge_verdicts(tasks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """GRD8, GRD10: a verdict counts if its input digest is the task's; the rest is pending, stale or missing."""
    return tasks.join(verdicts, "task_id", "left").withColumn(
        "status", F.when(F.col("verdict").isNull(), "missing").when(F.col("digest") == F.col("verdict_digest"), "merged").otherwise("stale")
    )


def dimensions_score(values: Column) -> Column:
    """JDG3: mean of (v - 1) / 4 over scores from 1 to 5, 4 places, null if one is off the scale."""
    ok = F.forall(values, lambda v: v.between(1, 5)) & (F.size(values) > 0)
    return F.when(ok, F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - 1) / 4) / F.size(values), 4))


def criteria_passed(met: Column, n: Column, minimum: Column) -> tuple[Column, Column]:
    """JDG4: share of met criteria and whether they suffice."""
    return F.round(met / n, 4), (met >= minimum) & (minimum <= n)


def step_minimum(fraction: Column, steps: Column) -> Column:
    """JDG5: the decimal ceiling of fraction x steps."""
    return F.ceil(fraction.cast("decimal(10,6)") * steps.cast("decimal(10,0)")).cast("int")


def consensus(votes: DataFrame, task: str, threshold: float, quorum: int | None = None) -> DataFrame:
    """JDG6, JDG7: quorum, else strict majority, else the median score against the threshold; with agreement."""
    g = votes.groupBy(task).agg(
        F.count("*").alias("n"), F.count_if("passed").alias("passes"), F.median("score").alias("median"),
    )
    n, p = F.col("n"), F.col("passes")
    if quorum is not None:
        verdict = p >= quorum
    else:
        verdict = F.when(p * 2 > n, True).when(p * 2 < n, False).otherwise(F.col("median") >= threshold)
    concur = F.greatest(p, n - p)
    return g.select(
        task, "n", "passes", verdict.alias("passed"), F.round(concur / n, 4).alias("agreement"), (concur == n).alias("unanimous")
    )


def alignment(labels: DataFrame, verdicts: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """JDG9, JDG10: confusion, precision, recall, F1 and kappa of judge against human; headline only if both sides match."""
    both = labels.join(verdicts, [key, *by], "full_outer")
    h, j = F.col("human"), F.col("judge")
    c = both.groupBy(*by).agg(
        F.count_if(h & j).alias("tp"),
        F.count_if(~h & j).alias("fp"),
        F.count_if(h & ~j).alias("fn"),
        F.count_if(~h & ~j).alias("tn"),
        F.count_if(h.isNull() | j.isNull()).alias("unmatched"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agree = (tp + tn) / n
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return (
        c.withColumn("observed_agreement", F.when(n > 0, F.round(agree, 6)))
        .withColumn("precision", F.when(tp + fp > 0, F.round(tp / (tp + fp), 6)))
        .withColumn("recall", F.when(tp + fn > 0, F.round(tp / (tp + fn), 6)))
        .withColumn("f1", F.when(tp + fp + fn > 0, F.round(2 * tp / (2 * tp + fp + fn), 6)))
        .withColumn("kappa", F.when(n > 0, F.when(chance == 1, 1.0).otherwise(F.round((agree - chance) / (1 - chance), 6))))
        .withColumn("agreement", F.when(F.col("unmatched") == 0, F.col("observed_agreement")))
    )


def kappa_band(kappa: Column) -> Column:
    """JDG11."""
    band = F.lit("poor")
    for least, name in ((0.0, "slight"), (0.2, "fair"), (0.4, "moderate"), (0.6, "substantial"), (0.8, "almost-perfect")):
        band = F.when(kappa > least, name).otherwise(band)
    return F.when(kappa.isNotNull(), band)


def judge_sensitivity(lifts: DataFrame, by: Sequence[str], eps: float = 0.1) -> DataFrame:
    """JDG12: whether judges disagree on the sign of a lift or by more than eps; null if a report is partial."""
    g = lifts.groupBy(*by).agg(
        F.count("*").alias("judges"), F.count("lift").alias("complete"), (F.max("lift") - F.min("lift")).alias("__spread"), F.countDistinct(F.signum("lift")).alias("__signs")
    )
    whole = F.col("judges") == F.col("complete")
    return g.select(
        *by, "judges", F.when(whole, F.col("__signs") > 1).alias("sign_sensitive"), F.when(whole, F.col("__spread") > eps).alias("magnitude_sensitive")
    )


def probe_flips(probes: DataFrame, task: str = "task_id") -> DataFrame:
    """JDG13: share of tasks whose verdict survives turning the order round."""
    a = probes.filter("probe = 'original'").select(task, F.col("passed").alias("first"))
    b = probes.filter("probe = 'flipped'").select(task, F.col("passed").alias("second"))
    return a.join(b, task).agg(F.count("*").alias("tasks"), F.count_if(F.col("first") == F.col("second")).alias("consistent"))


def scaled(score: Column, low: float, high: float) -> Column:
    """JDG15: (s - low) / (high - low); null off the scale."""
    return F.when(score.between(low, high), (score - low) / (high - low))
