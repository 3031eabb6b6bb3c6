"""Measurements that carry their basis, and their comparison (CST2 to CST4).

A measurement is struct(availability, reason, amount, currency, provenance, basis). It is read once from a run's raw
record; every comparison takes the struct, so none can forget what the figure rests on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a figure may come from, and the parts of a basis in the order in which they are compared.
PROVENANCE = ("provider_reported", "price_table_estimated", "process_measured", "trace_normalized", "legacy_unverified")
BASIS = ("population", "provider", "model", "billing_scope", "case_id", "run_number")
PRICING = ("pricing_model", "pricing_table_version")
#: The reasons for parts that have a name of their own.
PART_REASON = {"population": "population_mismatch", "case_id": "pair_key_mismatch", "run_number": "pair_key_mismatch"}
AMOUNT = "decimal(38,9)"


#: What is read of a run's record. Text fields take numbers as they are written, so that no amount passes through a double.
RECORD = "population string, provider string, runner string, model string, billing_scope string, case_id string, run_number string, pricing_model string, pricing_table_version string, manifest_revision string, cost_usd string, cost string, cost_normalized struct<source:string,total_cost:string,currency:string>"


def read_run(text: Column) -> Column:
    """The record of a run; a block of another kind than an object reads as none. Select it before it is used: it is parsed once a row."""
    return F.from_json(text, RECORD)


def basis_of(run: Column) -> Column:
    """The basis of a run: an empty provider falls back to the runner; population and scope have defaults."""
    return F.struct(
        F.coalesce(run.population, F.lit("answer")).alias("population"),
        F.coalesce(F.nullif(run.provider, F.lit("")), F.nullif(run.runner, F.lit(""))).alias("provider"),
        run.model.alias("model"),
        F.coalesce(run.billing_scope, F.lit("run")).alias("billing_scope"),
        *(run[name].alias(name) for name in ("case_id", "run_number", *PRICING, "manifest_revision")),
    )


def _values(run: Column) -> Column:
    """What a cost is told from: the block's source, amount and currency, and the legacy scalar with its amount."""
    block, legacy = run.cost_normalized, F.coalesce(run.cost_usd, run.cost)
    return F.struct(
        block.source.alias("source"), block.total_cost.try_cast(AMOUNT).alias("total"), F.coalesce(block.currency, F.lit("USD")).alias("currency"),
        legacy.alias("legacy"), legacy.try_cast(AMOUNT).alias("old"),
    )


def _cost(values: Column, basis: Column) -> Column:
    source, currency = values.source, values.currency
    total, old = (F.when(v >= 0, v) for v in (values.total, values.old))  # 0 or more, a number or its text; true is no amount
    reason = (
        F.when(source.isin("missing", "not_applicable"), source)
        .when(source.isNotNull() & (total.isNull() | ~F.rlike(currency, F.lit("^[A-Z]{3}$"))), "invalid_cost_block")
        .when(source.isNotNull() & ~source.isin(*PROVENANCE), "unknown_cost_provenance")
        .when(source.isNull() & values.legacy.isNull(), "missing")
        .when(source.isNull() & old.isNull(), "invalid_legacy_cost")
    )
    there = reason.isNull()
    return F.struct(
        F.when(there, "available").when(reason == "not_applicable", "not_applicable").otherwise("unavailable").alias("availability"),
        reason.alias("reason"),
        F.when(there, F.when(source.isNull(), old).otherwise(total)).alias("amount"),
        F.when(there, F.when(source.isNull(), "USD").otherwise(currency)).alias("currency"),
        F.when(there, F.coalesce(source, F.lit("legacy_unverified"))).alias("provenance"),
        basis.alias("basis"),
    )


def cost_measure(run: Column) -> Column:
    """The cost of a run: its normalised block, else the legacy scalar in dollars, else missing."""
    return _cost(_values(run), basis_of(run))


def with_cost(df: DataFrame, text: Column, name: str = "cost") -> DataFrame:
    """df with the cost of each raw record. A filter on it does not parse the record again: what is read comes out of a generator."""
    once = lambda c: F.inline(F.array(F.struct(c)))
    read = df.select("*", once(read_run(text).alias("__run")))
    read = read.select("*", once(_values(F.col("__run")).alias("__values")))
    return read.select(*df.columns, _cost(F.col("__values"), basis_of(F.col("__run"))).alias(name))


def basis_reason(left: Column, right: Column) -> Column:
    """CST3: why two measurements rest on bases that cannot be compared; null if they can."""
    a, b = left.basis, right.basis
    part = lambda name: F.when(a[name].isNull() | b[name].isNull(), "basis_missing").when(a[name] != b[name], PART_REASON.get(name, "basis_mismatch"))
    priced = left.provenance == "price_table_estimated"
    revision = F.when(a.manifest_revision.isNotNull() | b.manifest_revision.isNotNull(), part("manifest_revision"))
    return F.coalesce(
        F.when((left.provenance == "legacy_unverified") | (right.provenance == "legacy_unverified"), "legacy_unverified"),
        F.when(left.provenance != right.provenance, "provenance_mismatch"),
        *(part(name) for name in BASIS),
        *(F.when(priced, part(name)) for name in PRICING),
        revision,
    )


def pair_reason(left: Column, right: Column, left_scorable: Column, right_scorable: Column) -> Column:
    """CST4: why a pair has no difference: unscorable arms first, then each side, the currency, the basis."""
    side = lambda m, name: F.when(m.isNull() | (m.availability == "unavailable"), f"missing_{name}").when(m.availability == "not_applicable", "not_applicable")
    yes = lambda c: F.coalesce(c, F.lit(True))  # noqa: E731  an arm that is not there is missing, not unscorable
    return F.coalesce(
        F.when(~yes(left_scorable) | ~yes(right_scorable), "unscorable_arm"),
        side(left, "left"),
        side(right, "right"),
        F.when(left.currency != right.currency, "currency_mismatch"),
        basis_reason(left, right),
    )


def compare_cost(left: DataFrame, right: DataFrame, key: Sequence[str], measure: str = "cost") -> DataFrame:
    """CST4: the exact signed difference of two arms, or the reason why there is none. Both have key, scorable and a measurement."""
    l = left.select(*key, F.col("scorable").alias("__ls"), F.col(measure).alias("__l"))  # noqa: E741
    r = right.select(*key, F.col("scorable").alias("__rs"), F.col(measure).alias("__r"))
    m, n = F.col("__l"), F.col("__r")
    both = l.join(r, list(key), "full_outer").withColumn("reason", pair_reason(m, n, F.col("__ls"), F.col("__rs")))
    free = F.col("reason").isNull()
    return both.select(*key, "reason", F.when(free, m.amount - n.amount).cast(AMOUNT).alias("delta"), F.when(free, m.currency).alias("currency"))
