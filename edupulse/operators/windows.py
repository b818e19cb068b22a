"""Ordered-history columns (W4-W8) and the causal feature rows built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edupulse.functions.scalars import ratio
from edupulse.operators.mastery import ATTEMPT_ORDER, CHAIN_KEYS, BktRule, mastery_before
from edupulse.operators.sizes import broadcast_if_small
from edupulse.operators.skew import group_limit, lookback_window, running_totals

UNSEEN_SKILL_DIFFICULTY = 0.5
NUMERIC_FEATURES = [
    "student_total_attempts_before",
    "student_total_correct_rate_before",
    "student_skill_attempts_before",
    "student_skill_correct_rate_before",
    "attempts_since_last_seen_skill",
    "skill_train_difficulty",
    "bkt_mastery_before",
]
INDICATOR_FEATURES = ["has_prior_student_attempt", "has_prior_skill_attempt"]


def history_counts(attempts: DataFrame, *, max_rows: float | None = None) -> DataFrame:
    """Attempts and correct rate so far, per student and per (student, skill), attempts
    since the skill was last seen, and history indicators. Nothing at or after the row counts."""
    max_rows = group_limit(attempts, ["student_id"], max_rows)
    one, right = F.lit(1).cast("long"), F.col("correct").cast("long")
    rows = running_totals(
        attempts, ["student_id"], ATTEMPT_ORDER,
        {"student_total_attempts_before": one, "_student_correct": right}, max_rows)
    rows = running_totals(
        rows, CHAIN_KEYS, ATTEMPT_ORDER,
        {"student_skill_attempts_before": one, "_skill_correct": right}, max_rows)
    position = "student_total_attempts_before"
    rows = lookback_window(
        rows, CHAIN_KEYS, ATTEMPT_ORDER, 1,
        lambda df, w: df.withColumn("attempts_since_last_seen_skill", F.col(position) - F.lag(position).over(w)),
        max_rows)
    return rows.withColumns({
        "student_total_correct_rate_before": ratio(F.col("_student_correct"), F.col(position)),
        "student_skill_correct_rate_before": ratio(F.col("_skill_correct"), F.col("student_skill_attempts_before")),
        "has_prior_student_attempt": F.col(position) > 0,
        "has_prior_skill_attempt": F.col("student_skill_attempts_before") > 0,
    }).drop("_student_correct", "_skill_correct")


def transitions(
    df: DataFrame, *, key: Sequence[str], order: Sequence[str], value: str, name: str = "is_transition",
    max_rows: float | None = None,
) -> DataFrame:
    """Whether a value differs from the row before; the first row of a key never does."""
    def add(rows: DataFrame, window: Window) -> DataFrame:
        return rows.withColumn(name, F.coalesce(F.col(value) != F.lag(value).over(window), F.lit(False)))

    return lookback_window(df, key, order, 1, add, max_rows)


def previous_outcome(
    df: DataFrame, *, key: Sequence[str], order: Sequence[str], value: str, first: float | Column | None,
    name: str = "previous", max_rows: float | None = None,
) -> DataFrame:
    """The outcome of the row before; ``first`` (a constant, or None for the row's own value)
    at the start of a key."""
    start = F.col(value) if first is None else (first if isinstance(first, Column) else F.lit(first))

    def add(rows: DataFrame, window: Window) -> DataFrame:
        return rows.withColumn(name, F.coalesce(F.lag(value).over(window).cast("double"), start.cast("double")))

    return lookback_window(df, key, order, 1, add, max_rows)


def kt_features(
    attempts: DataFrame, *, difficulty: DataFrame, params: BktRule = BktRule(), max_rows: float | None = None
) -> DataFrame:
    """K9: one causal feature row per attempt.

    ``difficulty`` must come from training students only and be reused unchanged for every split.
    """
    attempts = attempts.select(*CHAIN_KEYS, *ATTEMPT_ORDER, "correct")
    max_rows = group_limit(attempts, ["student_id"], max_rows)
    rows = history_counts(attempts, max_rows=max_rows)
    rows = mastery_before(rows, params, max_rows=max_rows).withColumnRenamed("mastery_before", "bkt_mastery_before")
    return rows.join(broadcast_if_small(difficulty), "topic_id", "left").fillna(
        UNSEEN_SKILL_DIFFICULTY, subset=["skill_train_difficulty"])


def kt_vector(rows: DataFrame, *, policy: str, output: str = "features") -> DataFrame:
    """Feature vector and label. Missing history is NaN for ``tree`` and 0 for ``linear``;
    the indicator columns keep the two apart."""
    if policy not in ("tree", "linear"):
        raise ValueError(f"policy must be 'tree' or 'linear', got {policy!r}")
    missing = float("nan") if policy == "tree" else 0.0
    inputs = {"_v_" + c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in NUMERIC_FEATURES}
    inputs |= {"_v_" + c: F.col(c).cast("double") for c in INDICATOR_FEATURES}
    assembler = VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid="keep")
    return (
        assembler.transform(rows.withColumns(inputs))
        .drop(*inputs)
        .withColumn("label", F.col("correct").cast("double"))
    )
