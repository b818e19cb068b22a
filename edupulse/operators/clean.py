"""Cleaning, eligibility and label operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edupulse.functions.identity import uuid5_col, uuid5_of
from edupulse.functions.scalars import day_to_timestamp, with_percent
from edupulse.operators.quality import require_columns


def prune_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the named source columns under their new names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is complete."""
    return df.dropna(subset=list(keys))


def normalize_band(df: DataFrame, col: str) -> DataFrame:
    """Percent sign on every band."""
    return df.withColumn(col, with_percent(F.col(col)))


def drop_full_duplicates(df: DataFrame) -> DataFrame:
    """P5: one copy of rows equal in all columns; run before any column is pruned."""
    return df.dropDuplicates()


def drop_content_duplicates(df: DataFrame, *, id_col: str) -> DataFrame:
    """One row per content (all columns but the id), with the lowest id."""
    content = [c for c in df.columns if c != id_col]
    return df.groupBy(*content).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def distinct_dimension(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct key rows of a fact table."""
    return df.select(*keys).distinct()


def eligible_at(enrollments: DataFrame, *, cutoff_day: int) -> DataFrame:
    """Still registered after the cutoff; no unregistration date means never left."""
    left = F.col("date_unregistration")
    return enrollments.where(left.isNull() | (left > cutoff_day))


def completed(enrollments: DataFrame) -> DataFrame:
    """P10: enrollments with a pass/fail outcome."""
    return enrollments.where(F.col("final_result").isin("Pass", "Fail", "Distinction"))


def events_until(df: DataFrame, *, day_col: str, cutoff_day: int, exclude_banked: bool = True) -> DataFrame:
    """Events dated on or before the cutoff, without carried-over results."""
    known = df.where(F.col(day_col) <= cutoff_day)
    return known.where(~F.col("is_banked")) if exclude_banked and "is_banked" in df.columns else known


def is_withdrawn() -> Column:
    """Dropout label."""
    return F.when(F.col("final_result") == "Withdrawn", 1).otherwise(0)


def is_passed() -> Column:
    """Pass label."""
    return F.when(F.col("final_result").isin("Pass", "Distinction"), 1).otherwise(0)


def is_absence_bucket(col: str = "student_absence_days", bucket: str = "Above-7") -> Column:
    """Absence-bucket label."""
    return F.when(F.col(col) == bucket, 1).otherwise(0)


def verify_identity(df: DataFrame, *, dataset: str, id_col: str, identity_col: str) -> DataFrame:
    """Rows whose supplied identity is the one derived from the dataset and id."""
    return df.where(F.col(identity_col) == uuid5_col(dataset, F.col(id_col)))


def features_and_target(df: DataFrame, *, features: Sequence[str], target: str, table: str = "snapshot") -> DataFrame:
    """The model's inputs and its target, identifiers left out."""
    require_columns(df, [*features, target], table=table)
    return df.select(*features, target)


def restrict_to(df: DataFrame, ids: DataFrame, *, key: str) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def lookup(df: DataFrame, **key: object) -> DataFrame:
    """The row(s) of one key; the filter reaches the scan."""
    for column, value in key.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def interactions_from_clicks(clicks: DataFrame) -> DataFrame:
    """One resource view per click row; site and clicks are kept as metadata."""
    return clicks.select(
        F.col("id_student").alias("student_id"),
        day_to_timestamp(F.col("date")).alias("ts"),
        F.lit("resource_view").alias("type"),
        F.lit(None).cast("string").alias("topic_id"),
        F.lit(None).cast("boolean").alias("outcome"),
        F.create_map(
            F.lit("id_site"), F.col("id_site").cast("string"),
            F.lit("sum_click"), F.col("sum_click").cast("string"),
        ).alias("metadata"),
        "code_module", "code_presentation",
    )


def results_from_submissions(submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Graded, non-banked submissions as assessment results."""
    graded = submissions.where(~F.col("is_banked") & F.col("score").isNotNull())
    courses = assessments.select("id_assessment", "code_module", "code_presentation")
    return graded.join(courses, "id_assessment").select(
        F.col("id_student").alias("student_id"),
        uuid5_of(F.concat(F.lit("oulad-assessment-"), F.col("id_assessment").cast("string"))).alias("assessment_id"),
        "score",
        day_to_timestamp(F.col("date_submitted")).alias("submitted_at"),
        "code_module", "code_presentation",
    )


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """Homogeneous parts under one another, matched by name."""
    parts = list(parts)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
