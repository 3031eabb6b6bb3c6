"""Paired lift and inference: unit deltas, sign-flip tests, intervals, noise verdicts, reliability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Most moved units whose sign patterns are enumerated in SQL: 2**14 patterns.
EXACT_UNITS = 14
TOLERANCE = 1e-12
#: Bounds of the exact table: its sums, the sums before equal ones are merged, and the denominators of deltas.
MOST_CELLS, MOST_WORK, LARGEST_DENOMINATOR = 1 << 20, 1 << 22, 1_000_000
#: Looks of the sampled test, and the chance that any of them misjudges.
LOOKS, FAILURE = 4, 0.001
#: Points of reliability curves in a batch.
CURVE_POINTS = 1 << 16


def unit_deltas(paired: DataFrame, unit: Sequence[str], rate: str = "rate") -> DataFrame:
    """EST1: mean of each arm over the repetitions of a unit, and their difference."""
    good = paired.filter("status = 'pair'")
    return good.groupBy(*unit).agg(
        F.count("*").alias("pairs"), F.avg(f"treatment_{rate}").alias("with_rate"), F.avg(f"control_{rate}").alias("without_rate")
    ).withColumn("delta", F.col("with_rate") - F.col("without_rate"))


def summary(units: DataFrame, by: Sequence[str] = (), blocked: int = 0) -> DataFrame:
    """EST2: mean delta (withheld if any pair is blocked), normalised gain and how many units fell."""
    found = units.groupBy(*by).agg(
        F.count("*").alias("units"),
        F.round(F.avg("with_rate"), 9).alias("with_rate"),
        F.round(F.avg("without_rate"), 9).alias("without_rate"),
        F.round(F.avg("delta"), 9).alias("observed_delta"),
        F.count_if(F.col("delta") < 0).alias("negative_delta_units"),
    )
    w, n = F.col("with_rate"), F.col("without_rate")
    return found.withColumn("absolute_delta", F.when(F.lit(blocked == 0), F.col("observed_delta"))).withColumn(
        "normalized_gain", F.when((w >= n) & (n < 1), F.round((w - n) / (1 - n), 6))
    )


def sign_flip_exact(units: DataFrame, by: Sequence[str], delta: str = "delta") -> DataFrame:
    """EST3 in SQL: the share of sign patterns as extreme as what was seen, for up to EXACT_UNITS moved units.

    Zero deltas do not move the sum and are left out. Groups with more moved
    units get a null p here; `sign_flip` takes them.
    """
    moved = units.groupBy(*by).agg(
        F.count("*").alias("units"), F.array_sort(F.collect_list(F.when(F.col(delta) != 0, F.col(delta)))).alias("moved")
    )
    size = F.size("moved")
    patterns = F.when(size <= EXACT_UNITS, F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), size).cast("long") - 1))
    signed = lambda p: F.aggregate(
        F.zip_with("moved", F.sequence(F.lit(0), size - 1), lambda d, i: F.when((F.floor(p / F.pow(F.lit(2), i)) % 2) == 1, -d).otherwise(d)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    whole = F.abs(F.aggregate("moved", F.lit(0.0), lambda acc, x: acc + x))
    hits = F.size(F.filter(patterns, lambda p: F.abs(signed(p)) >= whole - TOLERANCE))
    return moved.select(
        *by,
        "units",
        size.alias("moved_units"),
        F.when(F.col("units") == 0, None).when(size == 0, 1.0).when(size <= EXACT_UNITS, hits / F.pow(F.lit(2.0), size)).alias("p_value"),
    )


def _steps(values: np.ndarray) -> tuple[np.ndarray, int] | None:
    """The values as whole multiples of 1 / scale, and the scale; None if no small common denominator is there."""
    fractions = [Fraction(v).limit_denominator(LARGEST_DENOMINATOR) for v in values.tolist()]
    if any(abs(float(f) - v) > 1e-12 * max(1.0, abs(v)) for f, v in zip(fractions, values.tolist())):
        return None
    scale = math.lcm(*(f.denominator for f in fractions))
    steps = [int(f * scale) for f in fractions]
    return (np.array(steps, np.int64), scale) if max(map(abs, steps), default=0) < 1 << 40 else None


def _binomial(n: int) -> np.ndarray:
    """Chances of 0 to n heads of n fair coins."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(n + 1)]
    return np.exp(np.array(logs))


class SignPatterns:
    """How the sum under random signs falls: sums of signed deltas, sums of signs, and the chance of each two.

    Shifting all deltas by t changes a pattern's sum from a to a - t * b, so one
    table serves every shift. Equal deltas move together: a value that occurs m
    times has m + 1 outcomes. Where the table would hold more than MOST_CELLS
    sums, `draws` seeded patterns stand for it.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray, draws: int = 0, seed: int = 0, shifts: bool = True) -> None:
        self.n, self.whole = int(counts.sum()), math.fsum((values * counts).tolist())
        found = None if draws else self._table(values, counts, shifts)
        self.exact = found is not None
        self.sums, self.signs, self.chance = found if self.exact else self._drawn(values, counts, draws or 4096, seed)

    @staticmethod
    def _table(values: np.ndarray, counts: np.ndarray, shifts: bool) -> tuple | None:
        lattice = _steps(values)
        if lattice is None:
            return None
        steps, scale = lattice
        sums, signs, chance, reach, width = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1), 0, 0
        for step, m in zip(steps.tolist(), counts.tolist()):
            if not (shifts or step):
                continue
            if len(sums) * (m + 1) > MOST_WORK:
                return None
            heads = 2 * np.arange(m + 1) - m
            sums = (sums[:, None] + step * heads).ravel()
            signs = (signs[:, None] + (heads if shifts else 0 * heads)).ravel()
            chance = (chance[:, None] * _binomial(m)).ravel()
            reach, width = reach + abs(step) * m, width + m * shifts
            key, span = (sums + reach) * (2 * width + 1) + signs + width, (2 * reach + 1) * (2 * width + 1)
            if span <= MOST_WORK:
                chance = np.bincount(key, chance, span)
                key = np.flatnonzero(chance)
                chance = chance[key]
            else:
                key, where = np.unique(key, return_inverse=True)
                chance = np.bincount(where, chance)
            sums, signs = key // (2 * width + 1) - reach, key % (2 * width + 1) - width
            if len(sums) > MOST_CELLS:
                return None
        return sums / scale, signs, chance

    @staticmethod
    def _drawn(values: np.ndarray, counts: np.ndarray, draws: int, seed: int) -> tuple:
        rng = np.random.default_rng(seed)
        sums, signs = np.zeros(draws), np.zeros(draws, np.int64)
        for v, m in zip(values.tolist(), counts.tolist()):
            heads = 2 * rng.binomial(m, 0.5, draws) - m
            sums += v * heads
            signs += heads
        return sums, signs, np.full(draws, 1.0)

    def p(self, shift: float = 0.0) -> float:
        """The two-sided p of the deltas less the shift; of draws, (hits + 1) / (draws + 1)."""
        extreme = np.abs(self.sums - shift * self.signs) >= abs(self.whole - shift * self.n) - TOLERANCE
        if self.exact:
            return float(min(1.0, self.chance[extreme].sum()))
        return (int(extreme.sum()) + 1) / (len(self.sums) + 1)

    def rejects(self, shift: float, alpha: float) -> bool:
        """Whether the test rejects the shift: by p, or of draws by the bound that a p just under alpha does not pass."""
        p = self.p(shift)
        return p <= alpha and (self.exact or _decided(p, len(self.sums), alpha))


class SignHalves(SignPatterns):
    """The same from tables of two halves of the deltas, where one of all would be too large: exact up to MOST_CELLS sums a half.

    That is 40 different deltas, on whatever grid. A pattern is a pattern of each
    half, so those as extreme as what was seen are counted by sorting one half's
    sums and looking up what each sum of the other leaves.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.n, self.whole = int(counts.sum()), math.fsum((values * counts).tolist())
        self.slack = TOLERANCE * max(1.0, float(np.abs(values) @ counts))
        halves, sizes = ([], []), [1, 1]
        for place in np.argsort(-counts, kind="stable").tolist():
            small = int(sizes[1] < sizes[0])
            halves[small].append(place)
            sizes[small] *= int(counts[place]) + 1
        self.exact = max(sizes) <= MOST_CELLS
        self.halves = [self._outcomes(values[h], counts[h]) for h in halves] if self.exact else []

    @staticmethod
    def _outcomes(values: np.ndarray, counts: np.ndarray) -> tuple:
        sums, signs, chance = np.zeros(1), np.zeros(1), np.ones(1)
        for v, m in zip(values.tolist(), counts.tolist()):
            heads = 2.0 * np.arange(m + 1) - m
            sums, signs, chance = (sums[:, None] + v * heads).ravel(), (signs[:, None] + heads).ravel(), (chance[:, None] * _binomial(m)).ravel()
        order = np.lexsort((sums, signs))  # a run for each sum of signs, which no shift disorders, so later sorts merge runs
        return sums[order], signs[order], chance[order]

    def p(self, shift: float = 0.0) -> float:
        """Opposite patterns are equally likely, so the lower tail of either half is its upper tail, and one tail counts twice."""
        away = abs(self.whole - shift * self.n) - self.slack
        if away <= 0:
            return 1.0
        one, other = (sums - shift * signs for sums, signs, _ in self.halves)
        order = np.argsort(other, kind="stable")
        below = np.concatenate([[0.0], np.cumsum(self.halves[1][2][order])])
        return float(min(1.0, 2 * (self.halves[0][2] @ below[np.searchsorted(other[order], one - away, "right")])))


def _decided(p: float, draws: int, alpha: float) -> bool:
    """Whether so many draws tell the side of alpha: Chernoff's bound with FAILURE shared out over the looks."""
    p = min(max(p, 1e-12), 1 - 1e-12)
    apart = p * math.log(p / alpha) + (1 - p) * math.log((1 - p) / (1 - alpha))
    return draws * apart >= math.log(LOOKS / FAILURE)


def sign_patterns(values: np.ndarray, counts: np.ndarray, alpha: float = 0.05, seed: int = 0, shifts: bool = True) -> SignPatterns:
    """EST4: the exact table, or two exact halves, or draws: 4096, and four times as many up to 2**18 until alpha is clearly passed or missed."""
    found, draws = SignPatterns(values, counts, shifts=shifts), 4096
    if not found.exact:
        found = SignHalves(values, counts)
    while not found.exact:
        found = SignPatterns(values, counts, draws, seed, shifts)
        if draws >= 4096 * 4 ** (LOOKS - 1) or _decided(found.p(), draws, alpha):
            break
        draws *= 4
    return found


def exact_p(deltas: np.ndarray, shift: float = 0.0) -> float:
    """Two-sided sign-flip p of deltas - shift from the table; not a number if that would be too large."""
    found = SignPatterns(*np.unique(np.asarray(deltas, float) - shift, return_counts=True), shifts=False)
    return found.p() if found.exact else math.nan


def sampled_p(deltas: np.ndarray, seed: int = 0, alpha: float = 0.05, start: int = 4096, most: int = 1 << 18) -> float:
    """EST4 by draws alone."""
    values, counts = np.unique(np.asarray(deltas, float), return_counts=True)
    draws = start
    while True:
        p = SignPatterns(values, counts, draws, seed).p()
        if draws >= most or _decided(p, draws, alpha):
            return p
        draws *= 4


def p_value(deltas: np.ndarray) -> float:
    return sign_patterns(*np.unique(np.asarray(deltas, float), return_counts=True), shifts=False).p()


def interval(deltas: np.ndarray, confidence: float = 0.95) -> tuple[float | None, float | None, bool]:
    return weighted_interval(*np.unique(np.asarray(deltas, float), return_counts=True), confidence)


def weighted_interval(
    values: np.ndarray, counts: np.ndarray, confidence: float = 0.95, patterns: SignPatterns | None = None, decimals: int = 6
) -> tuple[float | None, float | None, bool]:
    """EST5: the shifts that the test does not reject, of values that occur so many times; `patterns` are the test's own.

    Away from the mean the observed sum grows at least as fast as any pattern's,
    so p never rises again and bisection finds the ends. Unbounded where no
    shift is rejected (few deltas) and where all deltas are equal. An end half-way
    between two decimals is rounded outward: its neighbours inside are not rejected.
    """
    if not len(values):
        return None, None, False
    alpha = round(1 - confidence, 12)
    patterns = sign_patterns(values, counts, alpha) if patterns is None else patterns
    low, high = float(values.min()), float(values.max())
    margin, mean, ends = max(high - low, 1.0), patterns.whole / patterns.n, []
    for far in (low - margin, high + margin):
        if low == high or not patterns.rejects(far, alpha):
            return None, None, False
        inside, outside = mean, far
        for _ in range(60):
            if round(inside, decimals) == round(outside, decimals):
                break
            middle = (inside + outside) / 2
            if patterns.rejects(middle, alpha):
                outside = middle
            else:
                inside = middle
        ends.append(round(inside, decimals))
    return ends[0], ends[1], True


def cases_needed(alpha: float) -> int:
    """EST6: moved units before any pattern can reach alpha."""
    return math.ceil(math.log2(2 / alpha))


ESTIMATE = "units long, mean double, p_value double, low double, high double, bounded boolean"


def sign_flip(units: DataFrame, by: Sequence[str], delta: str = "delta", ends: bool = True, decimals: int = 6) -> DataFrame:
    """EST9: test and interval of each group from one set of deltas, and one of patterns where that is exact; without `ends` the test alone, and no interval is sought.

    Equal deltas are counted where they are, so a group sends a row per distinct
    delta, not per unit. Groups of nothing but nulls give no row. Groups are dealt
    out by number before: their deltas are a few bytes, which AQE would bring together in one task.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*by).schema) + ", " + ESTIMATE
    times = "__times"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(delta)
        values, counts = pdf[delta].to_numpy(dtype=float), pdf[times].to_numpy(dtype=np.int64)
        patterns = sign_patterns(values, counts, shifts=ends)
        low, high, bounded = weighted_interval(values, counts, patterns=patterns, decimals=decimals) if ends else (None, None, False)
        if ends and not patterns.exact:  # the test's own table is smaller and may be exact still
            patterns = sign_patterns(values, counts, shifts=False)
        row = (*key, patterns.n, patterns.whole / patterns.n, patterns.p(), low, high, bounded)
        return pd.DataFrame([row], columns=[*by, "units", "mean", "p_value", "low", "high", "bounded"])

    known = units.select(*by, F.col(delta).cast("double").alias(delta)).filter(F.col(delta).isNotNull() & ~F.isnan(delta))
    counted = known.groupBy(*by, delta).agg(F.count("*").alias(times))
    dealt = counted.repartition(max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
    return dealt.groupBy(*by).applyInPandas(one, schema)


def minimum_units_note(unit: str, alpha: float = 0.05) -> str:
    """EST13: how many units have to move before the test can reach alpha; unit is case, query, or another word with a plain plural."""
    needed = cases_needed(alpha)
    plural = "queries" if unit == "query" else f"{unit}s"
    note = f"p <= {alpha:g} needs at least {needed} {plural} that move the same way (the smallest reachable p with {needed} is {2 / 2**needed:g})"
    return note + ("; more repetitions sharpen each case's rate but do not add cases" if unit == "case" else "")


def smallest_achievable_p(moved: Column) -> Column:
    """EST6: min(1, 2 / 2**k)."""
    return F.least(F.lit(1.0), 2.0 / F.pow(F.lit(2.0), moved))


def extreme(with_rate: Column, without_rate: Column, eps: float = 1e-9) -> Column:
    """EST8: both arms at the ceiling, both at the floor, or null."""
    return F.when((with_rate >= 1 - eps) & (without_rate >= 1 - eps), "ceiling").when(
        (with_rate <= eps) & (without_rate <= eps), "floor"
    )


def noise_verdict(units: Column, moved: Column, half_width: Column, headroom: Column, min_lift: Column, alpha: float = 0.05) -> Column:
    """EST7: what stands between the data and a verdict, the first that applies."""
    return (
        F.when(units == 0, "no-data")
        .when(moved < cases_needed(alpha), "too-few-cases-moved")
        .when(half_width.isNull(), "unbounded")
        .when(half_width > headroom, "noise-exceeds-headroom")
        .when(min_lift.isNotNull() & (half_width > min_lift), "noise-exceeds-min-lift")
        .otherwise("resolvable")
    )


def projected_cases(units: Column, noise_floor: Column, target: Column) -> Column:
    """EST7: units after which noise falls to the target."""
    return F.ceil(units * F.pow(noise_floor / target, F.lit(2.0)))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """REL1: 1 - C(n-c, k) / C(n, k) as a product; null for k < 1, k > n or no runs."""
    miss = F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), F.lit(1.0), lambda a, i: a * F.greatest(n - c - i, F.lit(0)) / (n - i))
    return F.when((k >= 1) & (k <= n) & (n > 0), 1 - miss)


def pass_hat_k(n: Column, c: Column, k: Column) -> Column:
    """REL2: C(c, k) / C(n, k)."""
    hit = F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), F.lit(1.0), lambda a, i: a * F.greatest(c - i, F.lit(0)) / (n - i))
    return F.when((k >= 1) & (k <= n) & (n > 0), hit)


def _curve(n: int, c: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """k and both figures for k = 1 to n (or `most`), CURVE_POINTS at a time, each from the one before by a factor, so a curve costs its own length."""
    end, miss, hit = n if most is None else min(n, most), 1.0, 1.0
    for low in range(0, end, CURVE_POINTS):
        i = np.arange(low, min(low + CURVE_POINTS, end))
        steps = [np.maximum(good - i, 0) / (n - i) for good in (n - c, c)]
        steps[0][0] *= miss
        steps[1][0] *= hit
        misses, hits = map(np.cumprod, steps)
        miss, hit = misses[-1], hits[-1]
        yield i + 1, 1 - misses, hits


def reliability(rows: DataFrame, by: Sequence[str], most: int | None = None, rate: str = "rate") -> DataFrame:
    """REL3: n, c and both figures for every k up to n (or `most`); a run passes at rate 1, invalid rates are dropped.

    A group's curve is as long as its runs are many, so curves leave the workers in batches of CURVE_POINTS points.
    Groups are dealt out by number before: their counts are a few bytes, which AQE would bring together in one task.
    """
    good = rows.filter(F.col(rate).isNotNull() & ~F.isnan(rate) & F.col(rate).between(0, 1))
    counted = good.groupBy(*by).agg(F.count("*").cast("int").alias("n"), F.count_if(F.col(rate) == 1).cast("int").alias("c"))
    schema = T.StructType([*counted.schema, T.StructField("k", T.IntegerType()), T.StructField("pass_at_k", T.DoubleType()), T.StructField("pass_hat_k", T.DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(batch: pa.RecordBatch, points: list[tuple]) -> pa.RecordBatch:
            of = np.repeat([p[0] for p in points], [len(p[1]) for p in points])
            own = batch.take(pa.array(of, pa.int64()))
            figures = [pa.array(np.concatenate([p[j] for p in points]), out.field(len(own.columns) + j - 1).type) for j in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([*own.columns, *figures], schema=out)

        for batch in batches:
            points, held = [], 0
            for row, (n, c) in enumerate(zip(batch.column("n").to_pylist(), batch.column("c").to_pylist())):
                for k, miss, hit in _curve(n, c, most):
                    points.append((row, k, miss, hit))
                    held += len(k)
                    if held >= CURVE_POINTS:
                        yield batch_of(batch, points)
                        points, held = [], 0
            if points:
                yield batch_of(batch, points)

    dealt = counted if most is not None else counted.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
    each = dealt.mapInArrow(run, schema)
    return each.select(*by, "n", "c", "k", F.round("pass_at_k", 6).alias("pass_at_k"), F.round("pass_hat_k", 6).alias("pass_hat_k"))
