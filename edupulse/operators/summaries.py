"""Per-student and per-class summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edupulse.functions.scalars import ratio
from edupulse.operators.attempts import cap_roster, roster_counts
from edupulse.operators.skew import running_totals


def _trend(recent: Column, earlier: Column, eps: float, up: str, down: str) -> Column:
    """Label of recent minus earlier with a dead band; NULL without an earlier mean.

    The difference is rounded to nine places so that summation order cannot flip a label.
    """
    delta = F.round(recent - earlier, 9)
    return F.when(delta > eps, up).when(delta < -eps, down).when(delta.isNotNull(), "stable")


def student_engagement(interactions: DataFrame, *, window: int = 3, eps: float = 1.0) -> DataFrame:
    """Interaction totals, active days and the trend of interactions per active day.

    Days come first (a map-side sum), so a student is at most one element per calendar day.
    """
    daily = interactions.groupBy("student_id", F.to_date("ts").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("type") == "resource_view").alias("_views"),
        F.count_if(F.col("type") == "problem_attempt").alias("_tries"),
        F.count_if(F.col("outcome")).alias("_right"),
        F.count_if(~F.col("outcome")).alias("_wrong"),
        F.max("ts").alias("_last"),
    )
    students = daily.groupBy("student_id").agg(
        F.sum("_n").alias("total_interactions"),
        F.sum("_views").alias("resource_interaction_days"),
        F.sum("_tries").alias("problem_attempts"),
        F.sum("_right").alias("correct_attempts"),
        F.sum("_wrong").alias("incorrect_attempts"),
        F.count(F.lit(1)).alias("active_days"),
        F.sort_array(F.collect_list(F.struct(F.col("_day"), F.col("_n"))), asc=False).alias("_days"),
        F.max("_last").alias("last_interaction_at"),
    )
    add = lambda acc, d: acc + d["_n"]
    recent = F.aggregate(F.slice("_days", 1, window), F.lit(0).cast("long"), add)
    earlier = ratio(F.col("total_interactions") - recent, F.col("active_days") - window)
    trend = F.when(F.col("active_days") > window, _trend(
        recent / F.lit(float(window)), earlier, eps, "increasing", "decreasing"))
    return students.withColumn("trend", trend).drop("_days")


def student_assessment(
    results: DataFrame, *, window: int = 3, eps: float = 1.0, tie_break: str = "assessment_id"
) -> DataFrame:
    """Results, mean, mean of the last ``window`` by time, and the score trend."""
    newest = Window.partitionBy("student_id").orderBy(F.col("submitted_at").desc(), F.col(tie_break).desc())
    # row_number with a filter keeps window rows per student in every map task before the shuffle.
    recent = (
        results.select("student_id", "submitted_at", tie_break, "score")
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= window)
        .groupBy("student_id")
        .agg(F.sum("score").alias("_recent_sum"), F.count(F.lit(1)).alias("_recent_n"))
    )
    totals = results.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("total_results"),
        F.sum("score").alias("_sum"),
        F.max("submitted_at").alias("last_assessment_at"),
    )
    recent_mean = ratio(F.col("_recent_sum"), F.col("_recent_n"))
    earlier = ratio(F.col("_sum") - F.col("_recent_sum"), F.col("total_results") - F.col("_recent_n"))
    return totals.join(recent, "student_id").select(
        "student_id", "total_results",
        ratio(F.col("_sum"), F.col("total_results")).alias("average_score"),
        recent_mean.alias("recent_average_score"),
        _trend(recent_mean, earlier, eps, "improving", "declining").alias("trend"),
        "last_assessment_at",
    )


def event_timeline(
    interactions: DataFrame, results: DataFrame, *, interaction_id: str = "event_id", result_id: str = "assessment_id",
    max_rows: float | None = None,
) -> DataFrame:
    """T4: both kinds of events of a student in one order (time, then kind and id), numbered from 0."""
    parts = [
        interactions.select("student_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("interaction").alias("kind"),
                            F.col(interaction_id).cast("string").alias("source_id")),
        results.select("student_id", F.col("submitted_at").cast("timestamp").alias("ts"), F.lit("result").alias("kind"),
                       F.col(result_id).cast("string").alias("source_id")),
    ]
    order = ["ts", "kind", "source_id"]
    return running_totals(
        reduce(DataFrame.unionByName, parts), ["student_id"], order, {"position": F.lit(1).cast("long")}, max_rows)


def student_totals(states: DataFrame, interactions: DataFrame, results: DataFrame) -> DataFrame:
    """Observation total and the time of the last event of either kind, per student."""
    parts = [
        states.select("student_id", F.col("observation_count").alias("_n"), F.lit(None).cast("timestamp").alias("_t")),
        interactions.select("student_id", F.lit(0).cast("long").alias("_n"), F.col("ts").cast("timestamp").alias("_t")),
        results.select("student_id", F.lit(0).cast("long").alias("_n"), F.col("submitted_at").cast("timestamp").alias("_t")),
    ]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("student_id").agg(F.sum("_n").alias("total_observations"), F.max("_t").alias("as_of"))


def student_state_totals(states: DataFrame) -> DataFrame:
    """Totals rebuilt from stored states; students without a state have no row."""
    return states.groupBy("student_id").agg(
        F.sum("observation_count").alias("total_observations"),
        F.count(F.lit(1)).alias("topics"),
        F.max("updated_at").alias("as_of"))


def class_mastery(states: DataFrame, rosters: DataFrame) -> DataFrame:
    """Per class and topic the mean of student mastery and the sum of observations."""
    members = rosters.select("class_id", "student_id")
    return members.join(states, "student_id").groupBy("class_id", "topic_id").agg(
        F.avg("mastery").alias("average_mastery"),
        F.sum("observation_count").alias("observation_count"))


def class_engagement(students: DataFrame, rosters: DataFrame) -> DataFrame:
    """Totals over the students of a class who have any interaction."""
    engaged = students.where(F.col("total_interactions") > 0)
    return rosters.select("class_id", "student_id").join(engaged, "student_id").groupBy("class_id").agg(
        F.count(F.lit(1)).alias("students_with_interactions"),
        F.sum("total_interactions").alias("total_interactions"),
        F.sum("correct_attempts").alias("total_correct_attempts"),
        F.sum("incorrect_attempts").alias("total_incorrect_attempts"),
        F.avg("active_days").alias("average_active_days"))


def class_assessment(students: DataFrame, rosters: DataFrame) -> DataFrame:
    """A10: mean of per-student means, one vote per student."""
    scored = students.where(F.col("average_score").isNotNull())
    return rosters.select("class_id", "student_id").join(scored, "student_id").groupBy("class_id").agg(
        F.count(F.lit(1)).alias("students_with_results"), F.avg("average_score").alias("average_score"))


def _latest_order(df: DataFrame, time: str, tie_break: Sequence[str]) -> Column:
    """An order for ``max_by``. A time with one whole-number tie-break becomes one decimal, which a hash aggregate
    can hold; a struct (any other tie-break) makes Spark sort the rows first. NULLs come first in both."""
    if not tie_break:
        return F.col(time)
    kinds = [df.schema[c].dataType for c in (time, *tie_break)]
    if len(tie_break) > 1 or not isinstance(kinds[0], T.TimestampType) or not isinstance(kinds[1], T.IntegralType):
        return F.struct(time, *tie_break)
    # Timestamps end at about 2.5e17 microseconds either way; the factor is over the range of a long.
    micros = F.coalesce(F.unix_micros(time), F.lit(-4 * 10**17)).cast("decimal(18,0)")
    tie = F.coalesce(F.col(tie_break[0]).cast("long"), F.lit(-(2**63))).cast("decimal(19,0)")
    return micros * F.lit(Decimal(2 * 10**19)) + tie


def environment_summary(readings: DataFrame, *, key: str = "sensor_id", tie_break: Sequence[str] = ()) -> DataFrame:
    """Reading count, means, and the battery level at the latest reading."""
    latest = _latest_order(readings, "recorded_at", tie_break)
    return readings.groupBy(key).agg(
        F.count(F.lit(1)).alias("reading_count"),
        F.avg("temperature_c").alias("average_temperature_c"),
        F.avg("humidity_pct").alias("average_humidity_pct"),
        F.avg("co2_ppm").alias("average_co2_ppm"),
        F.max_by("battery_pct", latest).alias("latest_battery_pct"),
        F.max("recorded_at").alias("last_recorded_at"))


def latest_rows(df: DataFrame, *, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The newest row per key (combines map-side, unlike a window)."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def class_as_of(students: DataFrame, rosters: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """Per class the latest student ``as_of`` or reading (readings carry ``class_id``)."""
    times = rosters.select("class_id", "student_id").join(students, "student_id").select("class_id", "as_of")
    if readings is not None:
        times = times.unionByName(readings.select("class_id", F.col("recorded_at").alias("as_of")))
    return times.groupBy("class_id").agg(F.max("as_of").alias("as_of"))


def class_state(
    rosters: DataFrame, states: DataFrame, *, cap: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """``(classes, mastery)`` for every class at once.

    ``classes``: roster counts, topics observed and the last update; ``mastery``: A8 over the
    roster, the lowest ``cap`` students of a class if a cap is given. A student's mastery is computed once and joined to each of their classes.
    ``keep`` may write the class mastery (one row per class and topic), which both tables read.
    """
    mastery = keep(class_mastery_with_time(states, cap_roster(rosters, cap=cap)))
    observed = mastery.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("topics_observed"), F.max("as_of").alias("as_of"))
    classes = roster_counts(rosters, cap=cap).join(observed, "class_id", "left").withColumn(
        "topics_observed", F.coalesce("topics_observed", F.lit(0).cast("long")))
    return classes, mastery.drop("as_of")


def class_mastery_with_time(states: DataFrame, rosters: DataFrame) -> DataFrame:
    """A8 with the latest update per class and topic."""
    return rosters.select("class_id", "student_id").join(states, "student_id").groupBy("class_id", "topic_id").agg(
        F.avg("mastery").alias("average_mastery"),
        F.sum("observation_count").alias("observation_count"),
        F.max("updated_at").alias("as_of"))


def class_overview(classes: DataFrame, engagement: DataFrame, assessment: DataFrame, environment: DataFrame | None = None) -> DataFrame:
    """D1 as one table: a class's state (D1) with its engagement (A9), assessment (A10) and, where
    readings are mapped to classes, environment (A11 keyed by class_id). Parts that a class lacks are NULL."""
    whole = classes.join(engagement, "class_id", "left").join(assessment, "class_id", "left")
    return whole if environment is None else whole.join(environment, "class_id", "left")


def student_snapshot(totals: DataFrame, engagement: DataFrame, assessment: DataFrame, *attached: DataFrame) -> DataFrame:
    """One row per student: totals (A14), engagement (A12), assessment (A13) and the latest rows
    ``attached`` (each keyed by student_id), NULL where a student has none."""
    parts = [engagement, assessment, *attached]
    shared = {"delta", "trend"}
    names = ["engagement", "assessment", *[f"attached{i}" for i in range(len(attached))]]
    for name, part in zip(names, parts, strict=True):
        renamed = part.select(*[F.col(c).alias(f"{name}_{c}" if c in shared else c) for c in part.columns])
        totals = totals.join(renamed, "student_id", "left")
    return totals


def attach_latest(base: DataFrame, updates: DataFrame, *, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``base`` with the newest update per key; base rows without one keep NULLs."""
    return base.join(latest_rows(updates, keys=keys, order_by=order_by), list(keys), "left")
