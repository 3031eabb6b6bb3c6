"""Usage and cost of raw provider streams (TRC6): deltas add up, a cumulative result wins, repeated lifecycle lines count once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sources, and the names under which each figure is given.
SOURCES = ("claude", "codex", "gemini", "generic", "jetty", "pi", "vibe")
TOKENS = {
    "input": ("input_tokens", "prompt_tokens", "input"),
    "output": ("output_tokens", "completion_tokens", "output"),
    "total": ("total_tokens", "totalTokens", "total"),
}
#: Fixed value: lines of the lifecycle that repeat the usage of a message that has ended.
REPEATED = ("turn_end", "agent_end")
AMOUNT = "decimal(28,9)"
_STRING, _CONSTANT, _WIDE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"-?\b(?:NaN|Infinity)\b", r"-?\d[\d.]*[eE]\+?\d+"


def _kind(value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))


def _number(value: Column, path: str) -> Column:
    """A number at path, exact; texts and booleans are none."""
    return F.when(F.rlike(_kind(value, path), F.lit("^(BIGINT|DOUBLE|DECIMAL)")), F.try_variant_get(value, path, AMOUNT))


def not_finite(line: Column) -> Column:
    """Whether a line is JSON but for a number that is not finite: NaN, Infinity, or a literal beyond a double."""
    parts = F.regexp_extract_all(line, F.lit(rf'{_STRING}|[^"]++|"'), F.lit(0))
    outside = F.filter(parts, lambda x: ~F.startswith(x, F.lit('"')))
    wide = F.exists(outside, lambda x: F.exists(F.regexp_extract_all(x, F.lit(_WIDE), F.lit(0)), lambda n: F.abs(n.try_cast("double")) == float("inf")))
    tamed = F.array_join(F.transform(parts, lambda x: F.when(F.startswith(x, F.lit('"')), x).otherwise(F.regexp_replace(x, _CONSTANT, "0"))), "")
    odd = wide | F.exists(outside, lambda x: F.rlike(x, F.lit(_CONSTANT)))
    suspect = F.rlike(line, F.lit(r"NaN|Infinity|[eE]\+?\d{3}"))  # few lines are taken apart
    return F.when(suspect, F.coalesce(odd & F.try_parse_json(tamed).isNotNull(), F.lit(False))).otherwise(False)


def stream_usage(lines: DataFrame, run: Sequence[str], source: str = "source") -> DataFrame:
    """TRC6: a row for each run: tokens, cost and currency of its raw lines, or the problem for which it has none.

    lines has the run's columns, source, line_number and line. Text that is no JSON object is passed over. Usage stands in
    `usage` or `message.usage`, cost in a number or object beside or inside it. Lines of type `result` are cumulative:
    the last one with a figure wins over the sum. Source `pi` repeats a message's usage in later lifecycle lines, which
    count nothing; other sources count every line. A total that is not given is input plus output. A source that is not
    known as it stands, a number that is not finite and an amount below zero spoil the whole stream; several currencies
    leave the cost missing.
    """
    raw = lines.select(*run, F.col(source).alias("source"), "line_number", F.try_parse_json("line").alias("v"), not_finite(F.col("line")).alias("infinite"))
    v, either = F.col("v"), lambda *paths: F.coalesce(*(_number(F.col("v"), p) for p in paths))
    tokens = {k: either(*(f"{at}.{n}" for at in ("$.usage", "$.message.usage") for n in names)) for k, names in TOKENS.items()}
    paths = [f"{at}.{f}" for at in ("$.usage", "$.message.usage", "$") for f in ("cost.total", "cost.amount", "cost.total_cost", "cost")]
    cost = either(*paths, "$.total_cost_usd")
    currency = F.coalesce(*(F.try_variant_get(v, f"{at}.cost.currency", "string") for at in ("$.usage", "$.message.usage", "$")), F.lit("USD"))
    kind = F.try_variant_get(v, "$.type", "string")
    counted = ~((F.col("source") == "pi") & F.coalesce(kind.isin(*REPEATED), F.lit(False)))
    known = F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
    figures = raw.select(
        *run, "line_number", F.coalesce(kind == "result", F.lit(False)).alias("final"),
        F.when(~known, "unsupported trace source").when(F.col("infinite"), "number not finite").when(reduce(lambda a, b: a | b, (F.coalesce(c < 0, F.lit(False)) for c in (*tokens.values(), cost))), "amount below zero").alias("problem"),
        *(F.when(counted, c).alias(k) for k, c in tokens.items()), F.when(counted, cost).alias("cost"), F.when(counted & cost.isNotNull(), currency).alias("currency"),
    )
    figures = figures.withColumn("total", F.coalesce("total", F.col("input") + F.col("output")))
    final = F.col("final")

    def settled(name: str) -> Column:
        at = F.when(final & F.col(name).isNotNull(), F.struct("line_number", name))
        return F.coalesce(F.max(at)[name], F.sum(F.when(~final, F.col(name)))).alias(name)

    # currencies of the lines that the cost rests on: the cumulative ones if there are any
    of = lambda f, some: f(F.when(some, F.col("currency")))
    low, high = (F.coalesce(of(f, final), of(f, ~final)) for f in (F.min, F.max))
    g = figures.groupBy(*run).agg(F.min("problem").alias("problem"), *(settled(k) for k in (*TOKENS, "cost")), low.alias("low"), high.alias("high"))
    fine, one = F.col("problem").isNull(), F.col("low") == F.col("high")
    whole = lambda name: F.when(fine, F.col(name).cast("long")).alias(f"{name}_tokens")
    priced = fine & one & F.col("cost").isNotNull()
    used = F.coalesce("input", "output", "total").isNotNull()
    told = lambda test: F.when(fine, F.when(test, "trace_normalized").otherwise("missing"))
    return g.select(
        *run, "problem", told(used).alias("usage_source"), *(whole(k) for k in TOKENS),
        told(F.coalesce(priced, F.lit(False))).alias("cost_source"), F.when(priced, F.col("cost").cast(AMOUNT)).alias("total_cost"), F.when(priced, F.col("low")).alias("currency"),
    )
