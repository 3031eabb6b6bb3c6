"""Aggregates that never pose a partial total as a total.

Every aggregate carries the counts of observed, unavailable and not-applicable
rows; its headline is null unless the cohort is complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators.percentiles import exact_percentiles


def state(observed: Column, unavailable: Column, not_applicable: Column) -> Column:
    """AGG1: empty, not_applicable, partial or complete, from the three counts."""
    return (
        F.when(observed + unavailable + not_applicable == 0, "empty")
        .when(observed + unavailable == 0, "not_applicable")
        .when(unavailable > 0, F.when(observed > 0, "partial").otherwise("unavailable"))
        .otherwise("complete")
    )


def cohort(rows: DataFrame, by: Sequence[str], eligible: Column, reason: Column) -> DataFrame:
    """AGG1, AGG4: attempted rows, eligible ones, blocked ones with sorted reasons, and the state."""
    marked = rows.withColumn("__ok", F.coalesce(eligible, F.lit(False))).withColumn("__why", F.when(~F.col("__ok"), reason))
    return marked.groupBy(*by).agg(
        F.count("*").alias("attempted"),
        F.count_if("__ok").alias("runs"),
        F.count_if(~F.col("__ok")).alias("blocked"),
        F.array_join(F.array_sort(F.collect_set("__why")), ", ").alias("reason"),
    ).withColumn("availability", F.when(F.col("attempted") == 0, "empty").when(F.col("blocked") > 0, "partial").otherwise("complete"))


def metric_cohort(rows: DataFrame, by: Sequence[str], key: str, eligible: Column, applicable: Column) -> DataFrame:
    """AGG2, AGG3: a metric's cohort; its mean is a headline only if every applicable row has a value."""
    row = F.coalesce(eligible, F.lit(False))
    marked = rows.withColumn(
        "__why",
        F.when(~row, "ineligible").when(~applicable, F.lit(f"{key}_not_applicable")).when(F.col(key).isNull(), F.lit(f"missing_{key}")),
    )
    na = F.col("__why") == f"{key}_not_applicable"
    found = marked.groupBy(*by).agg(
        F.count_if(F.col("__why").isNull()).alias("observed"),
        F.count_if(F.col("__why").isNotNull() & ~na).alias("unavailable"),
        F.count_if(na).alias("not_applicable"),
        F.avg(F.when(F.col("__why").isNull(), F.col(key))).alias("observed_mean"),
    )
    return headline(found, "observed_mean", "mean")


def headline(found: DataFrame, observed: str, out: str) -> DataFrame:
    """AGG3: publishes the observed value only of complete cohorts."""
    status = state(F.col("observed"), F.col("unavailable"), F.col("not_applicable"))
    return found.withColumn("state", status).withColumn(out, F.when(F.col("state") == "complete", F.col(observed)))


def aggregate_numeric(measured: DataFrame, by: Sequence[str], value: str, basis: Sequence[str]) -> DataFrame:
    """AGG5: sum with availability; more than one basis among the observed makes it unavailable."""
    complete = F.col("availability") == "complete"
    found = measured.groupBy(*by).agg(
        F.count_if(complete).alias("observed"),
        F.count_if(F.col("availability").isin("unavailable", "partial")).alias("unavailable"),
        F.count_if(F.col("availability") == "not_applicable").alias("not_applicable"),
        F.countDistinct(F.when(complete, F.struct(*basis))).alias("bases"),
        F.sum(F.when(complete, F.col(value))).alias("known"),
    )
    status = state(F.col("observed"), F.col("unavailable"), F.col("not_applicable"))
    return (
        found.withColumn("state", F.when(F.col("bases") > 1, "unavailable").otherwise(status))
        .withColumn("reason", F.when(F.col("bases") > 1, "basis_mismatch"))
        .withColumn("value", F.when(F.col("state") == "complete", F.col("known")))
        .withColumn("known_subtotal", F.when(F.col("state") == "partial", F.col("known")))
        .drop("known")
    )


def aggregate_money(measured: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG6: one exact total per currency; what is unavailable counts against every currency of its group."""
    complete = F.col("availability") == "complete"
    missing = measured.groupBy(*by).agg(F.count_if(F.col("availability") == "unavailable").alias("unavailable"))
    known = measured.filter(complete).groupBy(*by, "currency").agg(F.count("*").alias("observed"), F.sum("amount").alias("known"))
    return (
        missing.join(known, list(by), "left")
        .withColumn("currency", F.coalesce("currency", F.lit("unknown")))
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .withColumn("value", F.when(F.col("unavailable") == 0, F.col("known")))
        .withColumn("known_subtotal", F.when(F.col("unavailable") > 0, F.col("known")))
        .drop("known")
    )


def mean_rate(rows: DataFrame, by: Sequence[str], scorable: Column, rate: str = "rate") -> DataFrame:
    """AGG7, AGG8: mean over scorable rows; nulls are skipped, rates outside [0, 1] are an error."""
    bad = F.col(rate).isNotNull() & (F.isnan(rate) | ~F.col(rate).between(0, 1))
    checked = F.when(bad, F.raise_error(F.lit("rate outside [0, 1]")).cast("double")).otherwise(F.col(rate))
    return rows.filter(scorable).groupBy(*by).agg(F.count("*").alias("n"), F.avg(checked).alias("mean_rate"))


def variant_summary(rows: DataFrame, scorable: Column, metrics: Sequence[str]) -> DataFrame:
    """AGG9: per variant, n, mean rate, mean, median and 90th percentile of metrics; errors stay disclosed. Percentiles are exact, by selection."""
    ok = scorable
    aggregates = [F.count_if(ok).alias("n"), F.count_if(~ok).alias("execution_errors"), F.avg(F.when(ok, F.col("rate"))).alias("mean_rate")]
    aggregates += [F.round(F.avg(F.when(ok, F.col(m)).cast("double")), 6).alias(f"{m}_mean") for m in metrics]
    found = rows.groupBy("variant").agg(*aggregates)
    for m in metrics:
        names = {f"{m}_median": 0.5, f"{m}_p90": 0.9}
        told = exact_percentiles(rows.filter(ok), ["variant"], m, names)
        told = told.select(F.col("variant").alias("__variant"), *(F.round(c, 6).alias(c) for c in names))
        found = found.join(told, F.col("variant").eqNullSafe(F.col("__variant")), "left").drop("__variant")
    order = ["variant", "n", "execution_errors", "mean_rate", *(f"{m}_{x}" for m in metrics for x in ("mean", "median", "p90"))]
    return found.select(*order)


def run_endings(rows: DataFrame, ending: str, by: str = "variant") -> DataFrame:
    """AGG12: how runs of each variant ended; runs without a record are `unrecorded`."""
    return rows.groupBy(by, F.coalesce(F.col(ending), F.lit("unrecorded")).alias("ending")).agg(F.count("*").alias("runs"))


def trigger_cohort(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG14: complete cohorts have rates; incomplete ones have counts only."""
    seen = F.col("triggered").isNotNull()
    passed = F.col("triggered") == F.col("should_trigger")
    return rows.groupBy(*by).agg(
        F.count("*").alias("observations"), F.count_if(seen).alias("measured"), F.count_if(seen & passed).alias("passed")
    ).withColumn(
        "status", F.when(F.col("measured") < F.col("observations"), "incomplete").otherwise("complete")
    ).withColumn("pass_rate", F.when(F.col("status") == "complete", F.col("passed") / F.col("observations")))


def trigger_matrix(rows: DataFrame) -> DataFrame:
    """AGG15: overall, by polarity and by query of each agent and model, as grouping sets."""
    seen, passed = F.col("triggered").isNotNull(), F.col("triggered") == F.col("should_trigger")
    sets = [["agent", "model"], ["agent", "model", "should_trigger"], ["agent", "model", "query_id"]]
    return rows.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("agent"), F.col("model"), F.col("should_trigger"), F.col("query_id")
    ).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("observations"),
        F.count_if(seen).alias("measured"),
        F.count_if(seen & passed).alias("passed"),
    )


def slices(units: DataFrame, single: Sequence[str], several: Sequence[str] = (), delta: str = "delta") -> DataFrame:
    """AGG10: of each value of each kind of slice the units, their mean delta, and its share of the mean over all units.

    single: columns with one value a unit; several: arrays, of which a unit counts once for each distinct value. A null is
    the value `unspecified`; an empty array belongs to no slice. A unit is exploded to its values and pre-aggregated where it is.
    """
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.coalesce(value.cast("string"), F.lit("unspecified")).alias("value"))
    own = F.array(*(entry(c, F.col(c)) for c in single))
    values = lambda kind: F.array_distinct(F.coalesce(F.col(kind), F.array(F.lit(None).cast("string"))))
    entries = lambda kind: F.transform(values(kind), lambda value: entry(kind, value))
    lists = [entries(kind) for kind in several]
    each = units.select(F.col(delta).alias("__delta"), F.explode(F.concat(own, *lists)).alias("slice"))
    told = each.groupBy("slice.kind", "slice.value").agg(F.count("*").alias("units"), F.round(F.avg("__delta"), 9).alias("lift"))
    whole = units.agg(F.round(F.avg(delta), 9).alias("__whole"))  # one row
    return told.join(whole).select("kind", "value", "units", "lift", F.round(F.try_divide("lift", "__whole"), 6).alias("lift_concentration"))
