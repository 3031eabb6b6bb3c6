"""Streaming extensions: windowed trigger rates and identities seen once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigger_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Passed and measured observations of each window and agent; windows close `late` after their end."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "agent")
        .agg(F.count("triggered").alias("measured"), F.count_if(F.col("triggered") == F.col("should_trigger")).alias("passed"))
        .select(F.col("window.start").alias("start"), "agent", "measured", "passed")
    )


def first_arms(runs: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Drops repeated arms of an identity that arrive within the watermark."""
    return runs.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
