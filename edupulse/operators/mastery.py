"""Mastery estimation from ordered attempts (K1-K3).

A mastery rule maps mastery ``m`` and an outcome to the next ``m``. Both rules here are linear
fractional in ``m``: ``m' = (a*m + b) / (c*m + d)``. Ordinary chains are folded directly over
their sorted attempts; a chain too long for one task is folded by segment, where a segment is
summarised by the product of its 2x2 matrices, and the products are applied in segment order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edupulse.operators.skew import SEGMENT, join_segment_values, split_hot

CHAIN_KEYS = ("student_id", "topic_id")
ATTEMPT_ORDER = ("ts", "event_id")
_BLOCK = 128


def _clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class EmaRule:
    """Exponential moving average towards 1 (correct) or 0 (incorrect)."""

    rate: float = 0.3
    initial: float = 0.5

    def __post_init__(self) -> None:
        _require(0.0 < self.rate <= 1.0, f"rate must be in (0, 1], got {self.rate}")
        _require(0.0 <= self.initial <= 1.0, f"initial must be in [0, 1], got {self.initial}")

    def step(self, mastery: Column, correct: Column) -> Column:
        target = F.when(correct, F.lit(1.0)).otherwise(F.lit(0.0))
        return _clamp(mastery + F.lit(self.rate) * (target - mastery))

    def matrix(self, correct: bool) -> tuple[float, float, float, float]:
        return (1.0 - self.rate, self.rate if correct else 0.0, 0.0, 1.0)


# The fitted default parameters (prior, transit, slip, guess).
DEFAULT_BKT = (0.5639, 0.0274, 0.1870, 0.3521)
# The starting point of the fit, also the literature defaults.
INITIAL_BKT = (0.3, 0.2, 0.1, 0.25)


@dataclass(frozen=True)
class BktRule:
    """Bayesian knowledge tracing: condition on the outcome, then one learning step."""

    prior: float = DEFAULT_BKT[0]
    transit: float = DEFAULT_BKT[1]
    slip: float = DEFAULT_BKT[2]
    guess: float = DEFAULT_BKT[3]

    def __post_init__(self) -> None:
        _require(0.0 <= self.prior <= 1.0, f"prior must be in [0, 1], got {self.prior}")
        _require(0.0 <= self.transit <= 1.0, f"transit must be in [0, 1], got {self.transit}")
        _require(0.0 < self.slip < 1.0, f"slip must be in (0, 1), got {self.slip}")
        _require(0.0 < self.guess < 1.0, f"guess must be in (0, 1), got {self.guess}")

    @property
    def initial(self) -> float:
        return self.prior

    def _likelihood(self, correct: bool) -> tuple[float, float]:
        return (1.0 - self.slip, self.guess) if correct else (self.slip, 1.0 - self.guess)

    def step(self, mastery: Column, correct: Column) -> Column:
        (right_known, right_unknown), (wrong_known, wrong_unknown) = (
            self._likelihood(True), self._likelihood(False))
        known = mastery * F.when(correct, F.lit(right_known)).otherwise(F.lit(wrong_known))
        unknown = (1.0 - mastery) * F.when(correct, F.lit(right_unknown)).otherwise(F.lit(wrong_unknown))
        posterior = known / (known + unknown)
        return _clamp(posterior + (1.0 - posterior) * F.lit(self.transit))

    def matrix(self, correct: bool) -> tuple[float, float, float, float]:
        known, unknown = self._likelihood(correct)
        return (known - self.transit * unknown, self.transit * unknown, known - unknown, unknown)

    def predict(self, mastery: Column) -> Column:
        """P(correct) before the outcome is seen."""
        return mastery * F.lit(1.0 - self.slip) + (1.0 - mastery) * F.lit(self.guess)


MasteryRule = EmaRule | BktRule


def sorted_attempts(order: Sequence[str], correct: str, payload: Sequence[str] = ()) -> Column:
    extra = [c for c in payload if c not in (*order, correct)]
    return F.sort_array(F.collect_list(F.struct(*order, F.col(correct).alias("_correct"), *extra)))


def fold_attempts(attempts: Column, start: Column, rule: MasteryRule) -> Column:
    return F.aggregate(attempts, start, lambda m, x: rule.step(m, x["_correct"]))


def running_values(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The fold value *before* each item of an array, as an array.

    Works in blocks, since appending to an accumulator array copies it.
    """
    last = F.greatest(F.floor((F.size(items) - 1) / _BLOCK), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * _BLOCK + 1, F.lit(_BLOCK)))
    no_values = F.array().cast("array<double>")

    def one_block(value: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(value.alias("v"), no_values.alias("before")),
            lambda acc, x: F.struct(
                step(acc["v"], x).alias("v"),
                F.concat(acc["before"], F.array(acc["v"])).alias("before"),
            ),
        )

    def append(acc: Column, block: Column) -> Column:
        done = F.array(one_block(acc["v"], block))
        return F.transform(done, lambda d: F.struct(
            d["v"].alias("v"), F.concat(acc["done"], F.array(d["before"])).alias("done")))[0]

    start_acc = F.struct(start.alias("v"), F.array().cast("array<array<double>>").alias("done"))
    return F.flatten(F.aggregate(blocks, start_acc, append)["done"])


def _matrix_product(attempts: Column, rule: MasteryRule) -> Column:
    """Product of the step matrices of an ordered attempt array, scaled to stay in range."""
    right, wrong = rule.matrix(True), rule.matrix(False)

    def cell(x: Column, i: int) -> Column:
        return F.when(x["_correct"], F.lit(right[i])).otherwise(F.lit(wrong[i]))

    def times(acc: Column, x: Column) -> Column:
        a = cell(x, 0) * acc["a"] + cell(x, 1) * acc["c"]
        b = cell(x, 0) * acc["b"] + cell(x, 1) * acc["d"]
        c = cell(x, 2) * acc["a"] + cell(x, 3) * acc["c"]
        d = cell(x, 2) * acc["b"] + cell(x, 3) * acc["d"]
        scale = F.greatest(F.abs(a), F.abs(b), F.abs(c), F.abs(d))
        return F.struct((a / scale).alias("a"), (b / scale).alias("b"), (c / scale).alias("c"), (d / scale).alias("d"))

    identity = F.struct(*[F.lit(v).alias(n) for n, v in zip("abcd", (1.0, 0.0, 0.0, 1.0), strict=True)])
    return F.aggregate(attempts, identity, times)


def apply_segment(mastery: Column, segment: Column) -> Column:
    m = segment["matrix"]
    return _clamp((m["a"] * mastery + m["b"]) / (m["c"] * mastery + m["d"]))


def segment_summaries(hot: DataFrame, keys: Sequence[str], order: Sequence[str], correct: str, rule: MasteryRule) -> DataFrame:
    """One row per hot chain: its segment summaries in order."""
    per_segment = hot.groupBy(*keys, SEGMENT).agg(
        _matrix_product(sorted_attempts(order, correct), rule).alias("matrix"),
        F.count(F.lit(1)).alias("n"),
        F.max(order[0]).alias("last"),
        F.element_at(sorted_attempts(order, correct), -1)[order[-1]].alias("last_id"),
    )
    ordered = F.sort_array(F.collect_list(F.struct(SEGMENT, "n", "last", "last_id", "matrix")))
    return per_segment.groupBy(*keys).agg(ordered.alias("segments"))


def final_mastery(
    attempts: DataFrame,
    rule: MasteryRule,
    *,
    keys: Sequence[str] = CHAIN_KEYS,
    order: Sequence[str] = ATTEMPT_ORDER,
    correct: str = "correct",
    max_rows: float | None = None,
) -> DataFrame:
    """(keys, mastery, observation_count, updated_at): state of each chain after its last attempt."""
    columns = [*dict.fromkeys([*keys, *order, correct])]
    ordinary, hot = split_hot(attempts.select(*columns), keys, order, max_rows)
    result = ordinary.groupBy(*keys).agg(
        fold_attempts(sorted_attempts(order, correct), F.lit(rule.initial), rule).alias("mastery"),
        F.count(F.lit(1)).alias("observation_count"),
        F.max(order[0]).alias("updated_at"),
    )
    if hot is None:
        return result
    folded = segment_summaries(hot, keys, order, correct, rule).select(
        *keys,
        F.aggregate("segments", F.lit(rule.initial), apply_segment).alias("mastery"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + s["n"]).alias("observation_count"),
        F.array_max(F.transform("segments", lambda s: s["last"])).alias("updated_at"),
    )
    return result.unionByName(folded)


def mastery_before(
    attempts: DataFrame,
    rule: MasteryRule,
    *,
    keys: Sequence[str] = CHAIN_KEYS,
    order: Sequence[str] = ATTEMPT_ORDER,
    correct: str = "correct",
    max_rows: float | None = None,
) -> DataFrame:
    """All attempts with ``mastery_before``: the state just before each attempt."""
    ordinary, hot = split_hot(attempts, keys, order, max_rows)
    payload = [c for c in attempts.columns if c not in keys]

    def explode_rows(grouped: DataFrame) -> DataFrame:
        pairs = F.explode(F.arrays_zip("_attempts", "_before")).alias("_x")
        return grouped.select(*keys, pairs).select(
            *keys,
            *[F.col("_x._attempts." + ("_correct" if c == correct else c)).alias(c) for c in payload],
            F.col("_x._before").alias("mastery_before"),
        )

    def trace(grouped: DataFrame, start: Column) -> DataFrame:
        before = running_values(F.col("_attempts"), start, lambda m, x: rule.step(m, x["_correct"]))
        return explode_rows(grouped.withColumn("_before", before))

    collected = sorted_attempts(order, correct, payload).alias("_attempts")
    result = trace(ordinary.groupBy(*keys).agg(collected), F.lit(rule.initial))
    if hot is not None:
        starts = (
            segment_summaries(hot, keys, order, correct, rule)
            .withColumn("_start", running_values(F.col("segments"), F.lit(rule.initial), apply_segment))
            .select(*keys, F.explode(F.arrays_zip("segments", "_start")).alias("_s"))
            .select(*keys, F.col(f"_s.segments.{SEGMENT}").alias(SEGMENT), F.col("_s._start").alias("_start"))
        )
        grouped = join_segment_values(hot.groupBy(*keys, SEGMENT).agg(collected), starts, keys)
        result = result.unionByName(trace(grouped, F.col("_start")))
    return result.select(*attempts.columns, "mastery_before")


def ema_mastery(attempts: DataFrame, *, rate: float = 0.3, initial: float = 0.5, max_rows: float | None = None) -> DataFrame:
    """K1: moving-average mastery per (student, skill)."""
    return final_mastery(attempts, EmaRule(rate, initial), max_rows=max_rows)


def bkt_mastery(attempts: DataFrame, *, params: BktRule = BktRule(), max_rows: float | None = None) -> DataFrame:
    """K2: knowledge-tracing mastery per (student, skill)."""
    return final_mastery(attempts, params, max_rows=max_rows)


def bkt_trajectory(attempts: DataFrame, *, params: BktRule = BktRule(), max_rows: float | None = None) -> DataFrame:
    """K3: mastery and predicted P(correct) before each attempt.

    Predictions keep 12 places: the last bits depend on how a long chain was split, and must not
    break ties between equal histories.
    """
    traced = mastery_before(attempts, params, max_rows=max_rows)
    return traced.withColumn("predicted", F.round(params.predict(F.col("mastery_before")), 12))
