"""Leakage-safe feature snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edupulse.functions.scalars import day_of_week, ratio
from edupulse.operators.aggregates import (
    COURSE,
    ENROLLMENT,
    click_stats,
    due_counts,
    submission_stats,
    with_activity_rates,
)
from edupulse.operators.clean import completed, eligible_at, is_passed, is_withdrawn
from edupulse.operators.skew import lookback_window

SCORED_TYPES = ("TMA", "CMA")
PROFILE = ["gender", "highest_education", "imd_band", "age_band", "num_of_prev_attempts",
           "studied_credits", "disability", "date_registration"]
ACTIVITY = ["assessments_submitted_count", "assessments_mean_score", "assessments_due_count",
            "assessments_submission_rate", "vle_total_clicks", "vle_active_days",
            "vle_distinct_sites", "vle_days_since_last_click"]


def _activity_snapshot(
    eligible: DataFrame, assessments: DataFrame, submissions: DataFrame, clicks: DataFrame,
    *, cutoff_day: int, types: Sequence[str] | None, label: Column, label_name: str,
) -> DataFrame:
    """The eligible enrollments with three pre-aggregated sides."""
    joined = (
        eligible.withColumn(label_name, label)
        .join(submission_stats(submissions, assessments, cutoff_day=cutoff_day, types=types), ENROLLMENT, "left")
        .join(click_stats(clicks, cutoff_day=cutoff_day), ENROLLMENT, "left")
        .join(due_counts(assessments, cutoff_day=cutoff_day, types=types), COURSE, "left")
    )
    return with_activity_rates(joined, cutoff_day=cutoff_day).select(*ENROLLMENT, *PROFILE, *ACTIVITY, label_name)


def dropout_snapshot(
    enrollments: DataFrame, assessments: DataFrame, submissions: DataFrame, clicks: DataFrame, *, cutoff_day: int = 30
) -> DataFrame:
    """M9: enrollments still active at the cutoff, with ``is_dropout``."""
    return _activity_snapshot(
        eligible_at(enrollments, cutoff_day=cutoff_day), assessments, submissions, clicks,
        cutoff_day=cutoff_day, types=None, label=is_withdrawn(), label_name="is_dropout")


def performance_snapshot(
    enrollments: DataFrame, assessments: DataFrame, submissions: DataFrame, clicks: DataFrame, *, cutoff_day: int = 30
) -> DataFrame:
    """Enrollments with an outcome, exams left out everywhere, with ``is_pass``."""
    return _activity_snapshot(
        completed(enrollments), assessments, submissions, clicks,
        cutoff_day=cutoff_day, types=SCORED_TYPES, label=is_passed(), label_name="is_pass")


def attendance_snapshot(
    attendance: DataFrame, *, window: int = 10, threshold: float = 0.10, tie_break: Sequence[str] | None = None,
    max_rows: float | None = None,
) -> DataFrame:
    """Per school day the previous rate and the trailing mean and sample deviation over
    the ``window`` days before it; days without a full window are left out.

    A school may report a day twice: such rows follow the stored ``id``, or where there is none their counts.
    """
    rates = attendance.where(F.col("enrolled") > 0).withColumn("_rate", ratio(F.col("absent"), F.col("enrolled")))

    def add(df: DataFrame, days) -> DataFrame:
        before = days.rowsBetween(-window, -1)
        return df.withColumns({
            "absence_rate_lag1": F.lag("_rate").over(days),
            "absence_rate_rolling_mean": F.avg("_rate").over(before),
            "absence_rate_rolling_std": F.stddev_samp("_rate").over(before),
            "_seen": F.count("_rate").over(before),
        })

    if tie_break is None:
        tie_break = ["id"] if "id" in attendance.columns else [c for c in ("enrolled", "present", "absent", "released") if c in attendance.columns]
    order = ["attendance_date", *tie_break]
    return (
        lookback_window(rates, ["school_id"], order, window, add, max_rows)
        .where(F.col("_seen") == window)
        .select(
            "school_id", "attendance_date", "school_year",
            day_of_week(F.col("attendance_date")).alias("day_of_week"),
            F.month("attendance_date").alias("month"),
            "absence_rate_lag1", "absence_rate_rolling_mean", "absence_rate_rolling_std",
            F.when(F.col("_rate") > threshold, 1).otherwise(0).alias("is_high_absence_day"),
        )
    )


def room_snapshot(readings: DataFrame) -> DataFrame:
    """The four measurements and the label; order by ``recorded_at`` when splitting."""
    return readings.select(
        "source_file", "recorded_at", "temperature_c", "humidity_pct", "co2_ppm", "light_lux", "occupancy")


# Columns of the absence-bucket snapshot.
ABSENCE_CATEGORIES = ["stage_id", "grade_id", "section_id", "topic", "semester",
                      "parent_answering_survey", "parent_school_satisfaction"]
ABSENCE_COUNTS = ["raised_hands", "visited_resources", "announcements_view", "discussion"]


def absence_snapshot(records: DataFrame) -> DataFrame:
    """Record id, class context, survey answers and counts with the absence bucket; no
    demographics and no other outcome."""
    return records.select("record_id", *ABSENCE_CATEGORIES, *ABSENCE_COUNTS, "student_absence_days")
