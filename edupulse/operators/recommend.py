"""Ranking of weak skills and suitable problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Reliability limits and the target success rate.
MIN_OBSERVATIONS = 3
TARGET_SUCCESS = 0.65
MIN_ANSWERS = 20
PROBLEM_LIMIT = 3


def skill_priority(class_mastery: DataFrame, *, min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """Reliable topics per class, weakest first; ties by more observations, then topic."""
    ranked = Window.partitionBy("class_id").orderBy(
        F.col("priority_score").desc(), F.col("observation_count").desc(), F.col("topic_id"))
    return (
        class_mastery.where(F.col("observation_count") >= min_observations)
        .withColumn("priority_score", 1.0 - F.col("average_mastery"))
        .withColumn("priority_rank", F.row_number().over(ranked))
    )


def problem_topk(
    problems_by_skill: DataFrame, *, target: float = TARGET_SUCCESS, min_answers: int = MIN_ANSWERS,
    k: int = PROBLEM_LIMIT,
) -> DataFrame:
    """Per skill the ``k`` problems closest to the target success rate, ties by problem id."""
    nearest = Window.partitionBy("topic_id").orderBy("distance_from_target", "problem_id")
    return (
        problems_by_skill.where(F.col("student_answer_count") >= min_answers)
        .withColumn("distance_from_target", F.abs(F.col("mean_correct") - target))
        .withColumn("problem_rank", F.row_number().over(nearest))
        .where(F.col("problem_rank") <= k)
    )


def class_recommendation(priorities: DataFrame, topk: DataFrame) -> DataFrame:
    """Each class's top skill with its problems; an empty list without reliable problems.

    Classes without a reliable skill have no row.
    """
    problem = F.struct("problem_rank", "problem_id", "mean_correct", "student_answer_count", "distance_from_target")
    per_skill = topk.groupBy("topic_id").agg(F.sort_array(F.collect_list(problem)).alias("problems"))
    empty = F.array().cast(per_skill.schema["problems"].dataType)
    return (
        priorities.where(F.col("priority_rank") == 1)
        .join(per_skill, "topic_id", "left")
        .select("class_id", "topic_id", "priority_score", "average_mastery", "observation_count",
                F.coalesce("problems", empty).alias("problems"))
    )
