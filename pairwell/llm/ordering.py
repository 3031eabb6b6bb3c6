"""Global order by an id without a single-task window: ranges whose heads are known.

`id_ranges` finds quantiles of the ids in one narrow aggregation. Parts are
consecutive ranges of about equal row counts, so order within a part plus
per-part totals gives any global running figure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwell.llm.common import parallelism


@dataclass(frozen=True)
class IdRanges:
    """heads: the smallest id of each part in ascending order; parts are numbered from 1.

    Rows without an id come first, in part 0, which exists if has_null.
    """

    heads: tuple[int, ...]
    has_null: bool

    @property
    def count(self) -> int:
        return len(self.heads) + 1

    def first(self) -> int:
        return 0 if self.has_null else 1

    def part(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """Adds the part number of each row: a binary search in the JVM."""
        if len(self.heads) < 2:
            return df.withColumn(out, F.when(F.col(key).isNull(), 0).otherwise(1))
        splits = [float("-inf"), *sorted({float(h) for h in self.heads[1:]}), float("inf")]
        probe = f"{out}__id"
        bucketed = Bucketizer(splits=splits, inputCol=probe, outputCol=out, handleInvalid="keep").transform(
            df.withColumn(probe, F.coalesce(F.col(key), F.lit(self.heads[0])).cast("double"))
        )
        # two ids may be one double: the head itself decides whether the id is in its part or in the one before
        near = F.col(out).cast("int") + 1
        head = F.element_at(F.array(*(F.lit(h).cast("long") for h in self.heads)), near)
        exact = near - F.when((near > 1) & (F.col(key) < head), 1).otherwise(0)
        return bucketed.withColumn(out, F.when(F.col(key).isNull(), 0).otherwise(exact)).drop(probe)


def id_ranges(df: DataFrame, key: str, parts: int | None = None) -> IdRanges:
    """Parts cut at quantiles of the ids, at most `parts` of them (default: the shuffle partitions).

    Quantiles are doubles, so they only say where to cut; each part's head is the smallest id that lies in it.
    """
    parts = parts or parallelism(df.sparkSession)
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    low, inner, nulls = df.agg(
        F.min(key), F.percentile_approx(key, cuts, max(10_000, 20 * parts)), F.count(F.when(F.col(key).isNull(), 1))
    ).first()
    # ids that a double cannot tell apart may not be two heads
    apart = lambda ids: tuple(sorted({float(h): h for h in sorted(ids, reverse=True)}.values()))
    cuts_at = IdRanges(apart({low, *(inner or [])} - {None}), bool(nulls))
    ids = df.select(F.col(key).cast("long").alias("__id")).filter("__id IS NOT NULL")
    firsts = cuts_at.part(ids, "__id", "__part").groupBy("__part").agg(F.min("__id").alias("first")).collect()  # a row a part
    return IdRanges(apart({r.first for r in firsts}), bool(nulls))


def running_total(df: DataFrame, part: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of `value` over all rows before each row, by part and then `order`.

    The totals table has a row per part, so its window is bounded by their number.
    """
    amount = df.withColumn(f"{out}__v", value)
    totals = amount.groupBy(part).agg(F.sum(f"{out}__v").alias(f"{out}__t"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, F.coalesce(F.sum(f"{out}__t").over(before), F.lit(0)).alias(f"{out}__b"))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        amount.withColumn(f"{out}__w", F.coalesce(F.sum(f"{out}__v").over(within), F.lit(0)))
        .join(F.broadcast(bases), part)
        .withColumn(out, F.col(f"{out}__b") + F.col(f"{out}__w"))
        .drop(f"{out}__v", f"{out}__w", f"{out}__b")
    )
