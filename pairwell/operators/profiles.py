"""The size of skills from their files (CST14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A skill's main file, the folder of its references, and characters a token of the estimate.
MAIN, REFERENCES, CHARS = "SKILL.md", "references/", 4.0


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / CHARS)


def headings(text: Column, level: str) -> Column:
    """Lines that open with as many # as `level` (a quantifier such as {2}) and a space, outside fenced blocks."""
    unfenced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?ms)^```.*?(?:^```[^\n]*$|\z)", "")
    return F.size(F.regexp_extract_all(unfenced, F.lit(rf"(?m)^#{level} "), F.lit(0)))


def skill_profile(files: DataFrame, skill: str, path: str, text: str, max_tokens: int, max_references: int, max_modules: int) -> DataFrame:
    """CST14: a row for each skill: estimated tokens of its main file and references, headings, modules and warnings.

    Files are measured where they are scanned and their figures summed; a file listed twice counts twice. Modules are
    headings of level two of the main file. A skill without a main file is warned of.
    """
    main, extra = F.col("path") == MAIN, F.startswith(F.col("path"), F.lit(REFERENCES))
    t = F.col(text)
    measured = files.select(F.col(skill), F.col(path).alias("path"), token_estimate(t).alias("tokens"), headings(t, "{1,6}").alias("heads"), headings(t, "{2}").alias("modules"))
    total = lambda test, column: F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).cast("long")
    g = measured.groupBy(skill).agg(
        F.count_if(main).alias("mains"), total(main, "tokens").alias("skill_tokens"), F.count_if(extra).alias("references"), total(extra, "tokens").alias("reference_tokens"),
        F.coalesce(F.max(F.when(extra, F.col("tokens"))), F.lit(0)).cast("long").alias("largest_reference"), total(main, "heads").alias("headings"), total(main, "modules").alias("modules"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("mains") == 0, "missing-skill-file"), F.when(F.col("skill_tokens") > max_tokens, "skill-too-large"),
            F.when(F.col("references") > max_references, "many-references"), F.when(F.col("modules") > max_modules, "many-modules"),
        )
    )
    return g.withColumn("warnings", F.array_join(warnings, ",")).drop("mains")
