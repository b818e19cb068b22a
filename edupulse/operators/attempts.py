"""Attempt facts, rosters and the problem catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edupulse.functions.lists import first_item, parse_list
from edupulse.operators.ordinal import with_surrogate_key


def attempts(problem_logs: DataFrame, assignment_logs: DataFrame, problems: DataFrame) -> DataFrame:
    """Scoreable attempts as (student_id, topic_id, ts, event_id, correct).

    A problem with several skills counts for its first. Problem logs without an ``id`` get one.
    """
    if "id" not in problem_logs.columns:
        problem_logs = with_surrogate_key(problem_logs, sorted(problem_logs.columns), "id")
    skills = problems.where(F.col("skills").isNotNull()).select(
        "problem_id", first_item(F.col("skills")).alias("topic_id")
    ).where(F.col("topic_id").isNotNull())
    scored = problem_logs.where(F.col("correct").isNotNull()).select(
        "log_id", "problem_id", F.col("start_time").alias("ts"), F.col("id").alias("event_id"), "correct")
    return (
        scored.join(skills, "problem_id")
        .join(assignment_logs.select("log_id", "student_id"), "log_id")
        .select("student_id", "topic_id", "ts", "event_id", "correct")
    )


def eligible_students(attempt_rows: DataFrame) -> DataFrame:
    """Students with at least one scoreable attempt."""
    return attempt_rows.select("student_id").distinct()


def class_rosters(attempt_rows: DataFrame, student_classes: DataFrame) -> DataFrame:
    """Distinct (class, eligible student). Attempts outside the class count too."""
    members = student_classes.select("class_id", "student_id").distinct()
    return members.join(eligible_students(attempt_rows), "student_id", "left_semi")


ROSTER_CAP = 15


def cap_roster(rosters: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Per class the ``cap`` lowest student ids (a partial top-k runs before the shuffle); all without a cap."""
    if cap is None:
        return rosters
    by_id = Window.partitionBy("class_id").orderBy("student_id")
    return rosters.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= cap).drop("_n")


def roster_counts(rosters: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Students used and eligible per class, and whether the cap applied."""
    eligible = rosters.groupBy("class_id").agg(F.count(F.lit(1)).alias("students_eligible"))
    return eligible.select(
        "class_id",
        F.least("students_eligible", F.lit(cap).cast("long")).alias("students_used"),  # least skips a missing cap
        "students_eligible",
        F.coalesce(F.col("students_eligible") > F.lit(cap).cast("long"), F.lit(False)).alias("roster_capped"),
    )


def problems_by_skill(problems: DataFrame) -> DataFrame:
    """One row per (skill, problem) for every skill in a problem's list."""
    usable = problems.where(F.col("skills").isNotNull() & F.col("mean_correct").isNotNull())
    skill = F.explode(F.array_distinct(parse_list(F.col("skills")))).alias("topic_id")
    return usable.select(skill, "problem_id", "mean_correct", "mean_time_on_task", "student_answer_count")
