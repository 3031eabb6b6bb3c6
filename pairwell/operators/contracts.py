"""Typed contracts: verdict kinds, canonical JSON, dataset fan-out and known answers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.text import contains_all, parse_strict
from pairwell.operators.filters import fill_template

#: The fields of a verdict that carry meaning, and those that each kind may have.
SEMANTIC_FIELDS = ("passed", "score", "threshold", "dimension_scores", "criteria", "minimum_criteria")
ALLOWED_FIELDS = {
    "boolean": ("passed",),
    "scored": ("passed", "score", "threshold"),
    "dimensions": ("passed", "score", "threshold", "dimension_scores"),
    "dynamic": ("passed", "score", "criteria", "minimum_criteria"),
    "consensus": ("passed", "score"),
}


def verdict_kind(raw: Column) -> Column:
    """JDG1: kind and error of a stored verdict, a JSON text.

    A stated kind counts; else the first that applies: consensus by its judge or
    panel, dimensions, dynamic criteria, a score that is not null, a pass. A
    field with meaning that the kind may not have is an error; a null score
    is no field, nor is a threshold of a boolean without a score. The text is
    made once and read four times a row: what follows works on variables.
    """
    value = lambda text, name: F.get_json_object(text, f"$.{name}")
    read = lambda text: F.struct(
        F.json_object_keys(text).alias("keys"), value(text, "verdict_kind").alias("stated"),
        value(text, "score").isNotNull().alias("scored"), value(text, "judge_model").alias("judge"),
    )
    return F.get(F.transform(F.transform(F.array(raw), read), _kind_of), 0)


def _kind_of(verdict: Column) -> Column:
    keys, stated, scored = verdict.keys, verdict.stated, verdict.scored
    has = lambda name: F.array_contains(keys, name)
    inferred = (
        F.when(F.coalesce(verdict.judge == "consensus", F.lit(False)) | has("judge_panel"), "consensus")
        .when(has("dimension_scores"), "dimensions")
        .when(has("criteria"), "dynamic")
        .when(scored, "scored")
        .when(has("passed"), "boolean")
    )
    kind = F.coalesce(stated, inferred)
    allowed = F.lit(None).cast("array<string>")
    for name, fields in ALLOWED_FIELDS.items():
        allowed = F.when(kind == name, F.array(*map(F.lit, fields))).otherwise(allowed)
    present = F.filter(F.array(*map(F.lit, sorted(SEMANTIC_FIELDS))), lambda f: F.array_contains(keys, f) & ~((f == "score") & ~scored) & ~((f == "threshold") & (kind == "boolean") & ~scored))
    foreign = F.array_except(present, allowed)
    error = (
        F.when(keys.isNull(), "no object")
        .when(stated.isNotNull() & ~stated.isin(*ALLOWED_FIELDS), F.concat(F.lit("unknown kind: "), stated))
        .when(has("dimension_scores") & has("criteria"), "dimensions and criteria")
        .when(kind.isNull(), "no payload")
        .when(F.size(foreign) > 0, F.concat(F.lit("foreign fields: "), F.array_join(foreign, ", ")))
    )
    return F.struct(F.when(error.isNull(), kind).alias("kind"), error.alias("error"))


def _canonical(text: str | None) -> str | None:
    value, why = parse_strict(text)
    return None if why else json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """DIG2: sorted keys, no spaces, ASCII; null for what is no strict JSON. 1, 1.0 and true stay apart."""
    return texts.map(_canonical).astype("object")


@F.pandas_udf(T.StringType())
def json_digest(texts: pd.Series) -> pd.Series:
    """DIG2: the SHA-256 of the canonical form."""

    def one(text: str | None) -> str | None:
        canonical = _canonical(text)
        return None if canonical is None else hashlib.sha256(canonical.encode()).hexdigest()

    return texts.map(one).astype("object")


def strictly_equal(left: Column, right: Column) -> Column:
    """SRC7: equal as typed JSON; null if either is no strict JSON."""
    return canonical_json(left) == canonical_json(right)


def fan_out(cases: DataFrame, rows: DataFrame, dataset: str, case_id: str, template: str, row_id: str, keys: Sequence[str]) -> DataFrame:
    """SRC3: a case for each row of its dataset, with the row's values in its template and `<case>-<row id>` as its id."""
    left = cases.select(dataset, F.col(case_id).alias("__case"), F.col(template).alias("__template"))
    right = rows.select(dataset, F.col(row_id).cast("string").alias("__row"), *[F.col(k).cast("string").alias(f"__v{i}") for i, k in enumerate(keys)])
    filled = fill_template(F.col("__template"), list(keys), [F.col(f"__v{i}") for i in range(len(keys))])
    return left.join(right, dataset).select(F.concat_ws("-", "__case", "__row").alias("id"), filled.alias("prompt"))


def known_answer(reference: Column, prompt: Column, required: list[str]) -> Column:
    """LEK3: the reference answer has to pass every text check and the prompt, as an empty answer, has to fail one."""
    return F.when(~contains_all(reference, required), "reference-answer-fails").when(contains_all(prompt, required), "null-answer-passes").otherwise("ok")
