"""Stored mastery brought forward by new attempts (S9 with K1/K2): batch or micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.operators.mastery import (
    ATTEMPT_ORDER,
    CHAIN_KEYS,
    MasteryRule,
    apply_segment,
    fold_attempts,
    segment_summaries,
)
from edupulse.operators.skew import split_hot


def advance_mastery(
    states: DataFrame, attempts: DataFrame, rule: MasteryRule, *, keys: Sequence[str] = CHAIN_KEYS,
    order: Sequence[str] = ATTEMPT_ORDER, correct: str = "correct", max_rows: float | None = None, last_id: str | None = None,
) -> DataFrame:
    """New states of the chains that have attempts; they fold on from the stored mastery.

    Equal to a fold over all attempts as long as the new ones come later than the stored ones. ``last_id`` names a
    column for the id (last of ``order``) of the last attempt.
    """
    stored = states.select(*keys, F.col("mastery").alias("_m"), F.col("observation_count").alias("_n"),
                           F.col("updated_at").alias("_at"))
    ordinary, hot = split_hot(attempts.select(*dict.fromkeys([*keys, *order, correct])), keys, order, max_rows)
    start = F.coalesce("_m", F.lit(rule.initial))

    # Stored states are grouped with the attempts, which takes no join and meets chains without a student or skill.
    rows = ordinary.withColumn("_is_new", F.lit(True)).unionByName(stored, allowMissingColumns=True)
    item = F.when(F.col("_is_new"), F.struct(*order, F.col(correct).alias("_correct")))
    grouped = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(item)).alias("_attempts"), F.count("_is_new").alias("_new"), F.max(order[0]).alias("_last"),
        *[F.max(c).alias(c) for c in ("_m", "_n", "_at")]).where("_new > 0")
    result = grouped.withColumn("mastery", fold_attempts(F.col("_attempts"), start, rule)).withColumn(
        "_id", F.element_at("_attempts", -1)[order[-1]])
    if hot is not None:
        chains = segment_summaries(hot, keys, order, correct, rule)
        names = {k: f"_of_{k}" for k in keys}
        same = F.lit(True)
        for key, name in names.items():
            same = same & F.col(key).eqNullSafe(F.col(name))
        chains = chains.join(stored.withColumnsRenamed(names), same, "left").drop(*names.values())
        folded = chains.withColumn("mastery", F.aggregate("segments", start, apply_segment)).withColumns({
            "_new": F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + s["n"]),
            "_last": F.array_max(F.transform("segments", lambda s: s["last"])),
            "_id": F.element_at("segments", -1)["last_id"]})
        result = result.drop("_attempts").unionByName(folded.drop("segments"))
    return result.select(
        *keys, "mastery",
        (F.coalesce("_n", F.lit(0).cast("long")) + F.col("_new")).alias("observation_count"),
        F.greatest("_at", "_last").alias("updated_at"), *([F.col("_id").alias(last_id)] if last_id else []))
