"""Verdicts on ablations by test (ABL2, ABL4, ABL6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators.estimates import sign_flip


def confirmation(provenance: Column, coverage: Column, observed: Column, significant: Column) -> Column:
    """The one way to a confirmed cause: both gates, a regression seen, and a test that it passes; seen but not passed is open, not refuted."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~yes(provenance) | ~yes(coverage), "indeterminate")
        .when(~yes(observed), "refuted")
        .when(~yes(significant), "indeterminate")
        .otherwise("confirmed_causal")
    )


def case_evidence(pairs: DataFrame, expected: Column, alpha: float = 0.05) -> DataFrame:
    """ABL2: of each ablation and case the pairs, flips, mean drop, the exact p of the signed drops, and whether a regression is seen and significant.

    pairs: ablation, case_id, status (pair or what blocks it), drop (full less ablated score), flipped (a cited assertion
    held in full and failed in the ablation). A regression needs a flip and a drop of the mean in one case. Equal drops
    are counted before the test, so a case sends a row per distinct drop.
    """
    by, good = ["ablation", "case_id"], F.col("status") == "pair"
    told = pairs.groupBy(*by).agg(
        F.count_if(good).alias("pairs"), F.count_if(~good).alias("blocked"), F.count_if(good & F.col("flipped")).alias("flips"), expected.alias("expected")
    )
    tested = sign_flip(pairs.filter(good), by, "drop", ends=False).select(*by, F.col("mean").alias("mean_drop"), "p_value")
    observed = F.coalesce((F.col("flips") > 0) & (F.col("mean_drop") > 0), F.lit(False))
    covered = (F.col("blocked") == 0) & (F.col("pairs") >= F.col("expected"))
    return told.join(tested, by, "left").withColumns(
        {"covered": covered, "observed": observed, "significant": observed & F.coalesce(F.col("p_value") <= alpha, F.lit(False))}
    )


def ablation_report(cases: DataFrame, provenance: DataFrame) -> DataFrame:
    """ABL6: one significant case confirms, however weak the others are; a case without coverage or unverified provenance leaves all open."""
    whole = cases.groupBy("ablation").agg(
        F.count("*").alias("cases"),
        F.bool_and("covered").alias("has_coverage"),
        F.bool_or("observed").alias("regression_observed"),
        F.bool_or("significant").alias("significant"),
        F.array_sort(F.collect_set(F.when(F.col("significant"), F.col("case_id")))).alias("confirming"),
    )
    verdict = confirmation(F.col("provenance_verified"), F.col("has_coverage"), F.col("regression_observed"), F.col("significant"))
    return whole.join(provenance.select("ablation", "provenance_verified"), "ablation", "left").withColumn("verdict", verdict)
