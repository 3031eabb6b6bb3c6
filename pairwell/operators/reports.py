"""Case flags, diffs, trends, error analysis, ablations, triggers, findings and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed weights of failures by severity; gate's is our choice.
WEIGHTS = {"critical": 3, "gate": 2, "soft": 1}


def case_flags(w: Column, n: Column, flaky: Sequence[tuple[Column, str]] = (), critical: Column | None = None) -> Column:
    """FLG1: flags of a case from its two arms' rates; null rates raise none (FLG6)."""
    flags = [
        F.when((w == 1) & (n == 1), "saturated"),
        F.when((w == 0) & (n == 0), "floor"),
        F.when((w == n) & (w > 0) & (w < 1), "no objective lift"),
        F.when(w < 1, "with-skill failure"),
        *[F.when(c, F.lit(f"flaky: {variant}")) for c, variant in flaky],
    ]
    if critical is not None:
        flags.append(F.when(critical != "", F.concat(F.lit("critical-failure: "), critical)))
    return F.array_compact(F.array(*flags))


def flag_kind(flag: Column) -> Column:
    """FLG2: the flag without its detail."""
    return F.split_part(flag, F.lit(": "), F.lit(1))


def non_discriminating(flags: Column) -> Column:
    """FLG3: saturated or without lift; floor is not among them."""
    return F.arrays_overlap(flags, F.array(F.lit("saturated"), F.lit("no objective lift")))


def discrimination(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """FLG5: assertions whose pass rates are the same in both arms."""
    rate = lambda v: F.avg(F.when(F.col("variant") == v, F.col("passed").cast("double")))
    g = results.groupBy(*key).agg(rate("with_skill").alias("with_rate"), rate("without_skill").alias("without_rate"))
    return g.withColumn("identical", F.col("with_rate") == F.col("without_rate"))


def report_diff(previous: DataFrame, current: DataFrame, key: Sequence[str], rate: str, flags: str) -> DataFrame:
    """DIF1: change of each key in both reports, with flags that came and went."""
    p = previous.select(*key, F.col(rate).alias("before"), F.col(flags).alias("old_flags"))
    c = current.select(*key, F.col(rate).alias("after"), F.col(flags).alias("now_flags"))
    return p.join(c, list(key)).select(
        *key,
        (F.col("after") - F.col("before")).alias("delta"),
        F.array_sort(F.array_except("now_flags", "old_flags")).alias("new_flags"),
        F.array_sort(F.array_except("old_flags", "now_flags")).alias("resolved_flags"),
    )


def trend(history: DataFrame, series: Sequence[str], ordinal: str, value: str) -> DataFrame:
    """DIF2: each report's value and its change from the report before."""
    w = Window.partitionBy(*series).orderBy(ordinal)
    return history.withColumn("change", F.col(value) - F.lag(value).over(w))


def weighted_failures(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """DIF3: share of runs that fail, times the severity's weight."""
    runs = results.groupBy(*[b for b in by if b != "severity"]).agg(F.countDistinct("run_id").alias("runs"))
    failed = results.filter("NOT passed AND NOT skipped").groupBy(*by).agg(F.countDistinct("run_id").alias("failing"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("severity"))
    return failed.join(runs, [b for b in by if b != "severity"]).withColumn("weighted", F.round(F.col("failing") / F.col("runs") * weight, 6))


def stale_cases(history: DataFrame, case: str, w: str, n: str, exempt: Column) -> DataFrame:
    """DIF4, DIF5: cases that no report of two or more told apart, regression guards left out."""
    g = history.filter(~exempt).groupBy(case).agg(F.count("*").alias("reports"), F.max(F.abs(F.col(w) - F.col(n))).alias("__most"))
    return g.filter("reports >= 2 AND __most = 0").select(case, "reports")


def trajectory_diff(events: DataFrame, arm: str, case: str, name: str = "name") -> DataFrame:
    """DIF6: command names that only one arm of a case ever used."""
    names = lambda v: F.collect_set(F.when(F.col(arm) == v, F.col(name)))
    g = events.groupBy(case).agg(names("with_skill").alias("__w"), names("without_skill").alias("__n"))
    return g.select(case, F.array_sort(F.array_except("__w", "__n")).alias("only_with"), F.array_sort(F.array_except("__n", "__w")).alias("only_without"))


def first_failures(results: DataFrame, run: str = "run_id", ordinal: str = "ordinal") -> DataFrame:
    """ERR1: each failing run in the category of its first failure, with counts and shares."""
    category = F.concat(F.when(F.col("severity") == "critical", "critical-failure:").when(F.col("severity") == "soft", "judge:").otherwise("text:"), F.col("name"))
    failed = results.filter("NOT passed AND NOT skipped").withColumn("category", category)
    first = failed.groupBy(run).agg(F.min(F.struct(ordinal, "category")).alias("__first")).select("__first.category")
    counts = first.groupBy("category").agg(F.count("*").alias("runs"))  # a row per category
    whole = counts.agg(F.sum("runs").alias("__all"))
    return counts.crossJoin(F.broadcast(whole)).select("category", "runs", F.round(F.col("runs") / F.col("__all"), 4).alias("share"))


def review_queue(rows: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """ERR2: the first `limit` rows of each group, and how many were left out."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.greatest(F.count("*").over(w) - limit, F.lit(0)))
    return ranked.filter(F.col("place") <= limit)


def upsert(judgements: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """SNK7: the last judgement of a key replaces earlier ones."""
    last = Window.partitionBy(*key).orderBy(F.desc(seq))
    return judgements.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def evidence_class(verified: Column, covered: Column, regressed: Column, significant: Column) -> Column:
    """ABL1: indeterminate without provenance, coverage or significance; else what was observed."""
    return F.when(~verified | ~covered, "indeterminate").when(~regressed, "refuted").when(significant, "confirmed_causal").otherwise("indeterminate")


def trigger_compare(baseline: DataFrame, ablated: DataFrame, cell: Sequence[str]) -> DataFrame:
    """TRG2, TRG3: cells of both arms with a reason if they cannot be compared."""
    def agg(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(*cell).agg(
            F.count("*").alias(f"{side}_n"), F.count("passed").alias(f"{side}_seen"), F.avg(F.col("passed").cast("double")).alias(f"{side}_rate")
        )

    both = agg(baseline, "base").join(agg(ablated, "abl"), list(cell), "full_outer")
    reason = (
        F.when(F.col("abl_n").isNull(), "missing_ablation_arm")
        .when(F.col("base_n").isNull(), "missing_baseline_arm")
        .when((F.col("base_seen") < F.col("base_n")) | (F.col("abl_seen") < F.col("abl_n")), "ablation_observations_incomplete")
        .when(F.col("base_n") != F.col("abl_n"), "repetition_count_mismatch")
    )
    return both.select(*cell, reason.alias("reason"), F.when(reason.isNull(), F.col("abl_rate") - F.col("base_rate")).alias("delta"))


def eval_health(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """FND2: every mark of the dimension with its findings: concern, ok, or unavailable if it was not observed."""
    g = findings.groupBy("mark").agg(F.count("*").alias("findings"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return marks.join(g, "mark", "left").select(
        "mark",
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.array_join(F.coalesce("kinds", F.array().cast("array<string>")), ",").alias("kinds"),
        F.when(F.col("findings") > 0, "concern").when(F.col("observed"), "ok").otherwise("unavailable").alias("state"),
    )


def gate(findings: DataFrame, policy: DataFrame, complete: bool) -> DataFrame:
    """FND3: fails on a finding whose kind or severity the policy names, and on incomplete evidence."""
    found = findings
    for c in ("kind", "severity"):  # two equi-joins instead of one on either
        found = found.join(policy.select(F.col("token").alias(f"__{c}")).distinct(), F.col(c) == F.col(f"__{c}"), "left")
    hits = found.filter(F.col("__kind").isNotNull() | F.col("__severity").isNotNull())
    return hits.agg(F.count("*").alias("matching")).withColumn("failed", (F.col("matching") > 0) | F.lit(not complete))


def readiness(w: Column, n: Column, wc: Column, nc: Column) -> Column:
    """FND5."""
    return F.when((w == n) & (w > 0), F.when(wc > nc, "qualitative_only").otherwise("base_saturated")).when((w == 0) & (n == 0), "floor").otherwise("measurable")


def design(cases: DataFrame, variants: Sequence[str], repetitions: int) -> DataFrame:
    """DSN1: the expected identities: every case in every variant, so many times."""
    return cases.withColumn("variant", F.explode(F.array(*map(F.lit, variants)))).withColumn("run_number", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def design_coverage(expected: DataFrame, runs: DataFrame, key: Sequence[str]) -> DataFrame:
    """DSN2: missing, extra, duplicate and present identities."""
    have = runs.groupBy(*key).agg(F.count("*").alias("__n"))
    both = expected.withColumn("__want", F.lit(True)).join(have, list(key), "full_outer")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__want").isNull(), "extra").when(F.col("__n") > 1, "duplicate").otherwise("present")
    return both.select(*key, status.alias("status"))
