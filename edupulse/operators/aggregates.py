"""Course-activity and tutoring aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.functions.scalars import ratio
from edupulse.operators.clean import events_until
from edupulse.operators.sizes import in_even_tasks

COURSE = ["code_module", "code_presentation"]
ENROLLMENT = [*COURSE, "id_student"]


def click_rollup(raw_clicks: DataFrame, *, rows: int | None = None) -> DataFrame:
    """A1: clicks summed on (course, student, site, day).

    ``rows``: about how many rows there are, if the caller knows it, or 0 if they are dealt by student already; else they
    are counted. An enrollment's rows, at most its days times its sites times a day's repeats, meet in one task.
    """
    raw_clicks = in_even_tasks(raw_clicks, ["id_student"], raw_clicks.count() if rows is None else rows)
    return raw_clicks.groupBy(*ENROLLMENT, "id_site", "date").agg(F.sum("sum_click").alias("sum_click"))


def merge_enrollments(info: DataFrame, registration: DataFrame) -> DataFrame:
    """Student info with registration dates, one row per enrollment on both sides."""
    return info.join(registration, ENROLLMENT)


def due_counts(assessments: DataFrame, *, cutoff_day: int, types: Sequence[str] | None = None) -> DataFrame:
    """A2: assessments due by the cutoff per course; undated ones are never due."""
    due = assessments.where(F.col("date") <= cutoff_day)
    if types:
        due = due.where(F.col("assessment_type").isin(*types))
    return due.groupBy(*COURSE).agg(F.count(F.lit(1)).alias("assessments_due_count"))


def submission_stats(
    submissions: DataFrame, assessments: DataFrame, *, cutoff_day: int, types: Sequence[str] | None = None
) -> DataFrame:
    """A3: submissions by the cutoff and their mean score; ungraded ones are counted, not averaged."""
    if types:
        assessments = assessments.where(F.col("assessment_type").isin(*types))
    known = events_until(submissions, day_col="date_submitted", cutoff_day=cutoff_day)
    return (
        known.join(assessments.select("id_assessment", *COURSE), "id_assessment")
        .groupBy(*ENROLLMENT)
        .agg(
            F.count(F.lit(1)).alias("assessments_submitted_count"),
            F.avg("score").alias("assessments_mean_score"),
        )
    )


def click_stats(clicks: DataFrame, *, cutoff_day: int) -> DataFrame:
    """A4: click total, distinct days and sites, last day by the cutoff.

    Every row counts once for its day, with its clicks, and once for its site. All steps are then sums of fixed width, which
    need no sort; a set of days in the aggregate would.
    """
    known = events_until(clicks, day_col="date", cutoff_day=cutoff_day)
    types = dict(known.dtypes)
    none = {c: F.lit(None).cast(types[c]) for c in ("date", "id_site", "sum_click")}
    sides = F.array(
        F.struct(F.col("date").alias("_day"), none["id_site"].alias("_site"), F.col("sum_click").alias("_clicks")),
        F.struct(none["date"].alias("_day"), F.col("id_site").alias("_site"), none["sum_click"].alias("_clicks")))
    return (
        known.select(*ENROLLMENT, F.inline(sides))
        .groupBy(*ENROLLMENT, "_day", "_site")
        .agg(F.sum("_clicks").alias("_clicks"))
        .groupBy(*ENROLLMENT)
        .agg(
            F.sum("_clicks").alias("vle_total_clicks"),
            F.count("_day").alias("vle_active_days"),
            F.count("_site").alias("vle_distinct_sites"),
            F.max("_day").alias("vle_last_active_day"),
        )
    )


def with_activity_rates(df: DataFrame, *, cutoff_day: int) -> DataFrame:
    """A5: counts become 0 where nothing happened; the rate and recency stay NULL."""
    counts = ["assessments_submitted_count", "assessments_due_count", "vle_total_clicks",
              "vle_active_days", "vle_distinct_sites"]
    rate = ratio(F.coalesce("assessments_submitted_count", F.lit(0)), F.col("assessments_due_count"))
    return (
        df.withColumn("assessments_submission_rate", rate)
        .withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in counts})
        .withColumn("vle_days_since_last_click", F.lit(cutoff_day) - F.col("vle_last_active_day"))
        .drop("vle_last_active_day")
    )


def skill_difficulty(train_attempts: DataFrame) -> DataFrame:
    """Mean correctness per skill over the given attempts."""
    return train_attempts.groupBy("topic_id").agg(
        F.avg(F.col("correct").cast("double")).alias("skill_train_difficulty"))


def correct_rate(train_attempts: DataFrame) -> DataFrame:
    """Overall share of correct attempts, one row."""
    return train_attempts.agg(F.avg(F.col("correct").cast("double")).alias("correct_rate"))


def confusion_matrix(df: DataFrame, *, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Rows per (label, prediction)."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def prediction_counts(df: DataFrame) -> DataFrame:
    """Predictions, chains, distinct students and skills, one row.

    Chains come first, so the distinct counts run over one row per (student, skill).
    """
    chains = df.groupBy("student_id", "topic_id").agg(F.count(F.lit(1)).alias("_n"))
    return chains.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_predictions"),
        F.count(F.lit(1)).alias("n_sequences"),
        F.countDistinct("student_id").alias("n_students"),
        F.countDistinct("topic_id").alias("n_skills"),
    )
