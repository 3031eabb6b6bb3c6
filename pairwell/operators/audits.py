"""What a suite's cases cover and which of them are malformed, before a run is paid for (FND6), and what its runs leave to be measured (FND7)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators import pairing

#: Splits, those that are kept from tuning, and where a case may come from.
SPLITS, HIDDEN = ("tune", "holdout", "holdback"), ("holdout", "holdback")
SOURCES = ("production", "bug-report", "hand-written", "synthesized", "imported")
#: Fixed value: the share of passes from which a control arm leaves no room.
EXHAUSTED = 0.95


def _blank(c: Column) -> Column:
    return F.coalesce(F.btrim(c) == "", F.lit(True))


def polarity(case_id: Column, kind: Column) -> Column:
    """FND6: trigger by kind, then negative by its id's prefix or kind, adversarial by kind; any other answer case is positive."""
    negative = F.startswith(case_id, F.lit("neg-")) | (kind == "negative")
    return F.when(kind == "trigger", "trigger").when(F.coalesce(negative, F.lit(False)), "negative").when(kind == "adversarial", "adversarial").otherwise("positive")


def case_problems(cases: DataFrame, suite: Sequence[str]) -> DataFrame:
    """FND6: a row for each malformed case of a suite, with all that is wrong with it.

    cases has id, split, kind, source, should_trigger, reference_answer and reference_answer_ref. An id may stand for one
    case of its suite only; ids are counted and joined back, so no suite is gathered.
    """
    keys = [*suite, "id"]
    counted = cases.groupBy(*keys).agg(F.count("*").alias("__copies")).filter("__copies > 1")
    copies = counted.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__copies")
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    given = F.col("reference_answer").isNotNull() | F.col("reference_answer_ref").isNotNull()
    kind, split = F.col("kind"), F.col("split")
    wrong = F.array_compact(
        F.array(
            F.when(_blank(F.col("id")), "blank id"),
            F.when(F.col("__copies") > 1, "repeated id"),
            F.when(_blank(kind), "blank kind"),
            F.when(~F.coalesce(split.isin(*SPLITS), F.lit(False)), "unknown split"),
            F.when(~F.col("source").isin(*SOURCES), "unknown source"),
            F.when((kind == "trigger") & F.col("should_trigger").isNull(), "trigger case without polarity"),
            F.when((kind == "trigger") & given, "known answer of a trigger case"),
            F.when(split.isin(*HIDDEN) & F.col("reference_answer").isNotNull(), "known answer of a held-out case is not private"),
            F.when(F.col("reference_answer").isNotNull() & F.col("reference_answer_ref").isNotNull(), "two known answers"),
        )
    )
    checked = cases.join(copies, same, "left").select(*keys, wrong.alias("problems"))
    return checked.filter(F.size("problems") > 0)


def suite_audit(cases: DataFrame, suite: Sequence[str]) -> DataFrame:
    """FND6: a row for each suite: counts by polarity, split and source, and the kinds of its findings in a fixed order.

    cases has id, split, kind, domain, difficulty, success_goals, should_trigger and source. A taxonomy is missing where
    any answer case lacks its field (our choice), a source where any case has none that is known; a suite without any
    case has no row.
    """
    p = polarity(F.col("id"), F.col("kind"))
    answer = F.col("kind").isNull() | (F.col("kind") != "trigger")
    n = lambda test: F.count_if(test)
    source = F.when(F.col("source").isin(*SOURCES), F.col("source"))
    counts = {
        "cases": F.count("*"), **{k: n(p == k) for k in ("positive", "negative", "adversarial")}, "hidden": n(F.col("split").isin(*HIDDEN)),
        "triggers": n((p == "trigger") & F.col("should_trigger")), "no_triggers": n((p == "trigger") & ~F.col("should_trigger")), "unsourced": n(source.isNull()), **{s: n(source == s) for s in SOURCES},
        "no_domain": n(answer & _blank(F.col("domain"))), "no_difficulty": n(answer & _blank(F.col("difficulty"))),
        "no_goals": n(answer & (F.coalesce(F.size("success_goals"), F.lit(0)) < 1)),
    }
    g = cases.groupBy(*suite).agg(*(c.alias(f"__{k}") for k, c in counts.items()))
    c = lambda k: F.col(f"__{k}")
    kinds = (
        (c("no_domain") > 0, "missing-domain-taxonomy"),
        (c("no_difficulty") > 0, "missing-difficulty-taxonomy"),
        (c("no_goals") > 0, "missing-success-goals"),
        (c("positive") == 0, "missing-positive-evals"),
        (c("negative") == 0, "missing-negative-evals"),
        (c("adversarial") == 0, "missing-adversarial-evals"),
        (c("hidden") == 0, "missing-hidden-splits"),
        ((c("triggers") == 0) | (c("no_triggers") == 0), "missing-trigger-no-trigger-cases"),
        (c("unsourced") > 0, "case-source-unrecorded"),
        (c("synthesized") == c("cases"), "synthesized-cases-only"),
    )
    named = [x for s in SOURCES for x in (F.lit(s), c(s))]
    return g.select(
        *suite, *(c(k).alias(k) for k in ("cases", "positive", "negative", "adversarial", "hidden", "triggers", "no_triggers")),
        F.map_filter(F.create_map(*named), lambda _, v: v > 0).alias("case_sources"), F.array_compact(F.array(*(F.when(test, kind) for test, kind in kinds))).alias("findings"),
    )


def run_findings(runs: DataFrame, verdicts: DataFrame, by: Sequence[str], regression: Column) -> DataFrame:
    """FND7: a row for each group of runs: the control arm's mean over scorable capability runs, and what the runs say about the suite.

    verdicts has the group's columns, verdict (of the noise check) and blocked, mismatched and mixed counts of its run
    conditions; a group without one is not called underpowered. Regression guards are meant to pass and count for nothing.
    """
    room = pairing.scorable() & (F.col("variant") == "without_skill") & ~F.coalesce(regression, F.lit(False)) & pairing.valid_rate("rate")
    g = runs.groupBy(*by).agg(F.avg(F.when(room, F.col("rate"))).alias("baseline"))
    kinds = (
        (F.col("baseline") >= EXHAUSTED, "suite-headroom-exhausted"),
        (F.col("verdict") != "resolvable", "underpowered-eval"),
        (F.col("blocked") > 0, "arm-conditions-differ"),
        (F.col("mismatched") > 0, "served-model-mismatch"),
        (F.col("mixed") > 0, "served-model-mixed"),
    )
    found = F.array_compact(F.array(*(F.when(test, kind) for test, kind in kinds)))
    return g.join(verdicts, list(by), "left").select(*by, F.round("baseline", 9).alias("baseline"), found.alias("findings"))
