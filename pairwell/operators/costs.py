"""Telemetry comparison, cost ledgers, contamination and leakage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwell.functions.view import folded


def lift_per(lift: Column, denominator: Column, unit: float = 1.0) -> tuple[Column, Column]:
    """CST6: lift per unit of a positive denominator, else blocked."""
    ok = denominator > 0
    return F.when(ok, F.round(lift / denominator * unit, 9)), F.when(~F.coalesce(ok, F.lit(False)), "non_positive_denominator")


def cost_summary(measured: DataFrame, by: Sequence[str]) -> DataFrame:
    """CST7, CST8: coverage, known and complete totals and means of each group and currency; failed runs count."""
    known = F.col("availability") == "complete"
    g = measured.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.count_if(known).alias("observed"),
        F.count_if(F.col("availability") == "unavailable").alias("missing"),
        F.sum(F.when(known, F.col("amount"))).alias("known_total"),
    )
    return g.withColumn("complete_total", F.when(F.col("missing") == 0, F.col("known_total"))).withColumn(
        "mean", F.round(F.col("known_total").cast("double") / F.col("observed"), 4)
    )


def ledger(measured: DataFrame, top: int) -> DataFrame:
    """CST9: spend by variant and by case as grouping sets, and the dearest cases by rank."""
    g = measured.filter("availability = 'complete'").groupingSets(
        [[F.col("variant")], [F.col("case_id")]], F.col("variant"), F.col("case_id")
    ).agg(F.sum("amount").alias("spend"), F.count("*").alias("runs"))
    rank = F.row_number().over(Window.partitionBy(F.col("case_id").isNull()).orderBy(F.desc("spend"), "case_id", "variant"))
    return g.withColumn("rank", rank).filter(F.col("case_id").isNull() | (F.col("rank") <= top))


def normal_cost(scalar: Column, first: Column, second: Column, parts_complete: Column) -> Column:
    """CST16: a scalar, else the sum of parts that say they are complete."""
    return F.when(scalar.isNotNull(), scalar).when(parts_complete, first + second)


def budget_gate(cap: Column, estimate: Column) -> Column:
    """CST12: a cap without an estimate fails closed."""
    return F.when(cap.isNull(), "no_cap").when(estimate.isNull(), "blocked_no_estimate").when(estimate > cap, "over_budget").otherwise("within_budget")


def words(text: Column) -> Column:
    """Caseless white-space tokens (our choice of tokenizer)."""
    return F.filter(F.split(folded(text), r"[ \t\r\n]+"), lambda w: w != "")


def ngrams(text: Column, n: int) -> Column:
    """Distinct word n-grams as 64-bit hashes of their words' hashes; too short a text has none.

    The hashes are bound once, as a lambda's variable, so no n-gram is ever built as a string.
    """

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        each = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, n))))
        return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(F.transform(words(text), lambda w: F.xxhash64(w))), grams), 1)


#: Grams of answers that are broadcast at once (24 bytes each and their ids), and how often the outputs are read for them at most.
BLOCK_GRAMS, MOST_BLOCKS = 1 << 20, 4


def containment(outputs: DataFrame, answers: DataFrame, n: int, output_id: str, answer_id: str, least: float, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """CON2 at scale: share of an answer's n-grams found in an output, as equi-joins of hashed shingles.

    Pairs without a shared n-gram have containment 0 and are not listed. Answers are the smaller side, and are counted
    before they are sent: up to MOST_BLOCKS blocks of block_grams rows are broadcast one after the other, so that only
    shared grams of the outputs are ever shuffled; a larger set is joined by a shuffle of both sides. A shingle that many
    outputs share costs a row for each answer that has it, never a pair of outputs.
    """
    a = answers.select(answer_id, F.explode(ngrams(F.col("text"), n)).alias("gram"))
    o = outputs.select(output_id, F.explode(ngrams(F.col("text"), n)).alias("gram"))
    sizes = a.groupBy(answer_id).agg(F.count("*").alias("__size"))
    blocks = max(1, -(-a.count() // block_grams))
    if blocks > MOST_BLOCKS:
        shared = o.join(a, "gram")
    else:  # a block holds about block_grams rows: grams are spread by their hash
        block = lambda i: a if blocks == 1 else a.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == i)
        shared = reduce(DataFrame.unionByName, (o.join(F.broadcast(block(i)), "gram") for i in range(blocks)))
    hits = shared.groupBy(output_id, answer_id).agg(F.count("*").alias("__hits"))
    found = hits.join(sizes, answer_id).select(output_id, answer_id, F.round(F.col("__hits") / F.col("__size"), 6).alias("containment"))
    return found.filter(F.col("containment") >= least)


def period(text: Column, end: bool) -> Column:
    """CON3: a partial date as yyyymmdd, at its period's end or start; null if it cannot be read or is no day of the calendar."""
    y, m, d = (F.regexp_extract(text, r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$", i) for i in (1, 2, 3))
    first = F.try_to_date(F.concat_ws("-", y, F.when(m == "", "12" if end else "01").otherwise(m), F.when(d == "", "01").otherwise(d)), "yyyy-MM-dd")
    day = F.when(d == "", F.last_day(first)).otherwise(first) if end else first
    return F.when(y != "", F.date_format(day, "yyyyMMdd").cast("int"))


def before_cutoff(released: Column, cutoff: Column) -> Column:
    """CON3: flagged if the release's start is not after the cut-off's end; unreadable dates flag nothing."""
    return F.coalesce(period(released, False) <= period(cutoff, True), F.lit(False))


def leaked(prompt: Column, value: Column, min_chars: int) -> Column:
    """LEK1: an assertion's value stands in the prompt, if it is long enough."""
    return (F.length(folded(value)) >= min_chars) & F.contains(folded(prompt), folded(value))


def blind_side(key: Column, seed: int) -> Column:
    """CMP1: which side is A, by a keyed hash."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)) == 0, "primary").otherwise("baseline")


def winners(results: DataFrame) -> DataFrame:
    """CMP2: counts of primary, baseline, tie and unknown from trimmed, upper-case answers and the truth table."""
    w = F.upper(F.btrim("winner"))
    who = F.when(w == "TIE", "tie").when(w == "A", F.col("a_is")).when(w == "B", F.when(F.col("a_is") == "primary", "baseline").otherwise("primary")).otherwise("unknown")
    return results.groupBy(who.alias("outcome")).agg(F.count("*").alias("n"))
