"""Pairing treatment and control runs on an exact identity, with a reason for every refusal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("case_id", "model", "run_number")


def scorable(missing: str = "missing_output", valid: str = "execution_valid") -> Column:
    """FLT1: the one predicate of all quality views."""
    return ~F.coalesce(F.col(missing), F.lit(False)) & F.coalesce(F.col(valid), F.lit(True))


def valid_rate(rate: str = "rate") -> Column:
    """A finite number in [0, 1]; NaN sorts above all numbers, so it is asked for by name."""
    return F.col(rate).isNotNull() & ~F.isnan(rate) & F.col(rate).between(0, 1)


def effort_reason(left: Column, right: Column) -> Column:
    """PAIR3: why two arms cannot be compared on effort; null if they can."""
    return F.when(left.isNull() & right.isNull(), None).when(
        left.isNull() | right.isNull(), "effort_unrecorded_on_one_arm"
    ).when(left != right, "effort_mismatch")


def duplicate_arms(runs: DataFrame, key: Sequence[str] = KEY, arm: str = "variant") -> DataFrame:
    """PAIR2: identities that an arm has more than once; must be empty before any arithmetic."""
    return runs.groupBy(*key, arm).agg(F.count("*").alias("copies")).filter("copies > 1")


def contrast(treatment: str, control: str) -> str:
    """PAIR4: the declared contrast of two variants; any other pairing is refused."""
    if control == "without_skill" and treatment == "with_skill":
        return "skill_presence"
    if control == "old_skill" and treatment == "with_skill":
        return "skill_edit"
    if treatment == "with_skill" and control.startswith("ablation:") and len(control) > len("ablation:"):
        return control
    raise ValueError(f"no declared contrast has {treatment} against {control}")


def pairs(
    runs: DataFrame,
    treatment: str = "with_skill",
    control: str = "without_skill",
    key: Sequence[str] = KEY,
    eligible: Column | None = None,
    not_applicable: Column | None = None,
    payload: Sequence[str] = ("rate", "effort"),
) -> DataFrame:
    """PAIR1: one full outer join on the null-safe key, then one ordered CASE for status and reason.

    eligible and not_applicable are conditions on a run; rows of other variants are ignored (PAIR6).
    """
    contrast(treatment, control)
    eligible = scorable() if eligible is None else eligible
    out_of_scope = F.lit(False) if not_applicable is None else not_applicable

    def arm(variant: str, side: str) -> DataFrame:
        return runs.filter(F.col("variant") == variant).select(
            *[F.col(k).alias(f"{side}_{k}") for k in key],
            F.lit(True).alias(f"{side}_there"),
            eligible.alias(f"{side}_eligible"),
            out_of_scope.alias(f"{side}_out"),
            *[F.col(c).alias(f"{side}_{c}") for c in payload],
        )

    left, right = arm(treatment, "l"), arm(control, "r")
    same = None
    for k in key:
        equal = F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
        same = equal if same is None else same & equal
    joined = left.join(right, same, "full_outer")
    reason = (
        F.when(F.col("l_out") & F.col("r_out"), "not_applicable")
        .when(F.col("l_there").isNull(), "missing_treatment")
        .when(F.col("r_there").isNull(), "missing_control")
        .when(~F.col("l_eligible"), "treatment_ineligible")
        .when(~F.col("r_eligible"), "control_ineligible")
    )
    if "effort" in payload:
        reason = F.coalesce(reason, effort_reason(F.col("l_effort"), F.col("r_effort")))
    return joined.select(
        *[F.when(F.col("l_there"), F.col(f"l_{k}")).otherwise(F.col(f"r_{k}")).alias(k) for k in key],
        *[F.col(f"l_{c}").alias(f"treatment_{c}") for c in payload],
        *[F.col(f"r_{c}").alias(f"control_{c}") for c in payload],
        reason.alias("reason"),
    ).withColumn(
        "status",
        F.when(F.col("reason").isNull(), "pair").when(F.col("reason") == "not_applicable", "not_applicable").otherwise("blocked"),
    )


def diagnostics(paired: DataFrame) -> DataFrame:
    """PAIR5: how many identities have each status and reason."""
    return paired.groupBy("status", "reason").agg(F.count("*").alias("identities"))
