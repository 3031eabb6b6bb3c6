"""A provider's single-document JSON output: outcome, usage by model and tool counts (SRC13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions.text import strict_json

#: Warnings that end a run, whole or by their beginning, in lower case; the counts of a model.
TERMINAL = ("maximum session turns exceeded", "loop detected, stopping execution")
TERMINAL_START = "agent execution stopped:"
COUNTS = ("input", "prompt", "candidates", "total", "cached", "thoughts", "tool")


def terminal_warning(text: Column) -> Column:
    """Whether a warning says that the run was stopped."""
    low = F.lower(text)
    return low.isin(*TERMINAL) | F.startswith(low, F.lit(TERMINAL_START))


def _kind(value: Column, path: str) -> Column:
    """The type of a member of a variant; null if it is not there or null itself."""
    return F.nullif(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))


def _text(value: Column, path: str) -> Column:
    """A member that is a text with something in it, else null."""
    text = F.try_variant_get(value, path, "string")
    return F.when((_kind(value, path) == "STRING") & (F.btrim(text) != ""), text)


def _count(value: Column, path: str) -> Column:
    """A member that is a whole number of 0 or more, else null."""
    n = F.try_variant_get(value, path, "long")
    return F.when((_kind(value, path) == "BIGINT") & (n >= 0), n)


def _is(kind: Column, what: str) -> Column:
    return F.coalesce(F.startswith(kind, F.lit(what)), F.lit(False))


def model_usage(parsed: DataFrame, run: str, value: str) -> DataFrame:
    """A row for each model of a document's statistics: its name, counts, and what is wrong with them."""
    models = F.when(_is(_kind(F.col(value), "$.stats.models"), "OBJECT"), F.try_variant_get(F.col(value), "$.stats.models", "variant"))
    rows = parsed.select(F.col(run), models.alias("__models")).filter(F.col("__models").isNotNull())
    each = rows.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("__models").outer())).select(run, F.col("key").alias("model"), F.col("value").alias("__one"))
    counts = each.select(run, "model", _is(_kind(F.col("__one"), "$"), "OBJECT").alias("__object"), _is(_kind(F.col("__one"), "$.tokens"), "OBJECT").alias("__tokens"), *(_count(F.col("__one"), f"$.tokens.{c}").alias(c) for c in COUNTS))
    missing = F.coalesce(*(F.when(F.col(c).isNull(), f"tokens.{c} must be a non-negative integer") for c in COUNTS))
    wrong = (
        F.when(F.btrim("model") == "", "model name must be a non-empty string")
        .when(~F.col("__object"), "a model must be an object")
        .when(~F.col("__tokens"), "tokens must be an object")
        .when(missing.isNotNull(), missing)
        .when(F.col("prompt") != F.col("input") + F.col("cached"), "prompt must equal input + cached")
        .when(F.col("total") < F.col("prompt") + F.col("candidates"), "total cannot be less than prompt + candidates")
    )
    return counts.filter(F.col("model").isNotNull()).select(run, "model", *COUNTS, wrong.alias("wrong"))


def envelope_outcomes(documents: DataFrame, run: str, text: str) -> DataFrame:
    """run, status (complete, provider_error or protocol_invalid), reason, response, models and summed counts of each document.

    An error object, else the first warning that ends a run, makes a provider error, for which no response is needed. The
    first malformed member makes the document invalid, and no other document. Models are a relation of their own rows,
    so a document's statistics are summed by Spark.
    """
    strict = documents.select(F.col(run), F.col(text).alias("__text"), strict_json(text)["ok"].alias("__ok"))
    parsed = strict.select(run, "__ok", F.when(F.col("__ok"), F.try_parse_json("__text")).alias("__v"))
    v = F.col("__v")
    warnings = F.when(_is(_kind(v, "$.warnings"), "ARRAY"), F.try_variant_get(v, "$.warnings", "array<variant>"))
    read = parsed.select(
        run,
        "__ok",
        _is(_kind(v, "$"), "OBJECT").alias("object"),
        (_kind(v, "$.session_id").isNotNull() & _text(v, "$.session_id").isNull()).alias("bad_session"),
        _kind(v, "$.error").alias("error"),
        _text(v, "$.error.type").alias("error_type"),
        _text(v, "$.error.message").alias("error_message"),
        F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.warnings", "variant")), F.lit("ARRAY")).alias("warned"),
        F.transform(warnings, lambda w: F.struct((F.schema_of_variant(w) == "STRING").alias("is_text"), w.try_cast("string").alias("w"))).alias("warnings"),
        _kind(v, "$.response").alias("response_kind"),
        F.try_variant_get(v, "$.response", "string").alias("response"),
        _kind(v, "$.stats").alias("stats"),
        _kind(v, "$.stats.models").alias("stats_models"),
        _kind(v, "$.stats.tools").alias("tools"),
        _count(v, "$.stats.tools.totalCalls").alias("tool_calls"),
    )
    usage = model_usage(parsed, run, "__v").groupBy(run).agg(
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.min("wrong").alias("bad_model"),
        *(F.sum(c).alias(f"{name}_tokens") for c, name in (("prompt", "input"), ("candidates", "output"), ("total", "total"), ("cached", "cache_read"))),
    )
    x = read.join(usage, run, "left")
    blank = lambda w: ~w.is_text | (F.btrim(w.w) == "")
    stop = F.get(F.filter("warnings", lambda w: terminal_warning(w.w)), 0)["w"]
    failure = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "error_type", "error_message")).otherwise(stop)
    no_response = (F.col("response_kind") != "STRING") | F.col("response_kind").isNull() | (F.btrim("response") == "")
    protocol = (
        F.when(~F.col("__ok"), "malformed JSON")
        .when(~F.col("object"), "output must be an object")
        .when(F.col("bad_session"), "session_id must be a non-empty string")
        .when(F.col("error").isNotNull() & ~_is(F.col("error"), "OBJECT"), "error must be an object")
        .when(F.col("error").isNotNull() & F.col("error_type").isNull(), "error.type must be a non-empty string")
        .when(F.col("error").isNotNull() & F.col("error_message").isNull(), "error.message must be a non-empty string")
        .when(~_is(F.col("warned"), "ARRAY"), "warnings must be an array")
        .when(F.exists("warnings", blank), "warning must be a non-empty string")
        .when(failure.isNull() & no_response, "response must be a non-empty string")
        .when(F.col("response_kind").isNotNull() & (F.col("response_kind") != "STRING"), "response must be a string when present")
        .when(F.col("stats").isNotNull() & ~_is(F.col("stats"), "OBJECT"), "stats must be an object")
        .when(F.col("stats").isNotNull() & ~_is(F.col("stats_models"), "OBJECT"), "stats.models must be an object")
        .when(F.col("bad_model").isNotNull(), F.col("bad_model"))
        .when(F.col("tools").isNotNull() & F.col("tool_calls").isNull(), "stats.tools.totalCalls must be a non-negative integer")
    )
    told = x.withColumns({"protocol": protocol, "failure": failure})
    good = F.col("protocol").isNull()
    return told.select(
        run,
        F.when(~good, "protocol_invalid").when(F.col("failure").isNotNull(), "provider_error").otherwise("complete").alias("status"),
        F.coalesce("protocol", "failure").alias("reason"),
        F.when(good, F.coalesce("response", F.lit(""))).alias("response"),
        *(F.when(good, F.col(c)).alias(c) for c in ("models", "input_tokens", "output_tokens", "total_tokens", "cache_read_tokens", "tool_calls")),
    )
