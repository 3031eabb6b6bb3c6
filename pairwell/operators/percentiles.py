"""Exact percentiles without a buffer of a group's values (AGG9)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are counted in first.
RANGES = 4096


def _same(by: Sequence[str]) -> Column:
    """Whether rows l and r are of one group; null is a group too."""
    return reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by), F.lit(True))


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, points: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """A column for each of points (its name: a share from 0 to 1) by linear interpolation between neighbouring ranks; nulls and NaN are no values.

    Distributed selection: equal values are counted where they are; a histogram of `ranges` equal ranges between a
    group's ends says in which range each wanted rank lies; only those ranges are put in order, by a running sum that
    holds one row. Groups without a value give no row.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counted = rows.select(*by, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    ends = counted.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__n").alias("__all"))
    share = F.coalesce(F.try_divide(F.col("__v") - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))
    part = F.least(F.floor(F.when(F.isnan(share), 0.0).otherwise(share) * ranges), F.lit(ranges - 1)).cast("int")
    placed = counted.alias("l").join(ends.alias("r"), _same(by)).select("l.*", "r.__low", "r.__high", "r.__all").withColumn("__part", part)
    histogram = placed.groupBy(*by, "__part").agg(F.sum("__n").alias("__n"), F.first("__all").alias("__all"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    place = lambda p: (F.col("__all") - 1) * F.lit(p)
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(high).alias("high"), (F.ceil(place(p)) if high else F.floor(place(p))).cast("long").alias("rank")) for name, p in points.items() for high in (False, True)))
    wanted = histogram.withColumn("__upto", upto).withColumn("__want", F.explode(ranks)).filter((F.col("__want.rank") < F.col("__upto")) & (F.col("__want.rank") >= F.col("__upto") - F.col("__n")))
    wanted = wanted.select(*by, "__part", (F.col("__upto") - F.col("__n")).alias("__before"), "__want")
    parts = wanted.select(*by, "__part", "__before").distinct()
    inside = _in_parts(placed, parts, by).withColumn(
        "__upto", F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    )
    hit = inside.alias("l").join(wanted.alias("r"), _same(by) & (F.col("l.__part") == F.col("r.__part")) & (F.col("r.__want.rank") < F.col("l.__upto")) & (F.col("r.__want.rank") >= F.col("l.__upto") - F.col("l.__n")))
    hit = hit.select(*(F.col(f"l.{c}").alias(c) for c in by), "l.__v", "l.__all", "r.__want")
    at = lambda name, high: F.max(F.when((F.col("__want.name") == name) & (F.col("__want.high") == high), F.col("__v")))
    found = hit.groupBy(*by).agg(F.max("__all").alias("__all"), *(at(n, h).alias(f"{n}__{int(h)}") for n in points for h in (False, True)))

    def between(name: str, p: float):
        low, high = F.col(f"{name}__0"), F.col(f"{name}__1")
        return F.when(low == high, low).otherwise((F.ceil(place(p)) - place(p)) * low + (place(p) - F.floor(place(p))) * high).alias(name)

    return found.select(*by, *(between(n, p) for n, p in points.items()))


def _in_parts(placed: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counted values that lie in wanted ranges, with how many values stand before their range."""
    return placed.alias("l").join(parts.alias("r"), _same(by) & (F.col("l.__part") == F.col("r.__part"))).select("l.*", "r.__before")
