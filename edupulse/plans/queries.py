"""Named queries over the given tables: operators applied to the views of ``driver_tables``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edupulse.functions.identity import uuid5_col
from edupulse.operators import aggregates, attempts as att, clean, decision, mastery, metrics, quality, recommend
from edupulse.operators import snapshots, splits, summaries, windows
from edupulse.operators.ordinal import with_surrogate_key
from edupulse.plans import driver_tables as v
from edupulse.plans.classroom import class_skill_priorities, classroom_report
from edupulse.sources.tables import delete_keys, upsert_latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_q")] = function
    return function


def publish(df: DataFrame) -> DataFrame:
    """Portable output: doubles to six places, integers as long, times and dates as text."""

    def column(field: T.StructField) -> Column:
        c, t = F.col(field.name), field.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


# --- mastery -------------------------------------------------------------------------------


@query
def bkt_mastery(spark, d):
    return publish(mastery.bkt_mastery(v.attempts(spark, d)))


@query
def ema_mastery(spark, d):
    return publish(mastery.ema_mastery(v.attempts(spark, d)))


@query
def bkt_trajectory(spark, d):
    return publish(mastery.bkt_trajectory(v.attempts(spark, d)).select(
        "event_id", "student_id", "topic_id", "correct", "mastery_before", "predicted"))


@query
def bkt_metrics(spark, d):
    rows = mastery.bkt_trajectory(v.attempts(spark, d))
    return publish(metrics.evaluate_predictions(rows, label="correct", prob="predicted"))


@query
def constant_baseline_metrics(spark, d):
    return publish(metrics.constant_baseline(v.attempts(spark, d), 0.6))


@query
def persistence_baseline_metrics(spark, d):
    return publish(metrics.persistence_baseline(v.attempts(spark, d)))


@query
def skill_difficulty(spark, d):
    return publish(aggregates.skill_difficulty(v.attempts(spark, d)))


@query
def correct_rate(spark, d):
    return publish(aggregates.correct_rate(v.attempts(spark, d)))


@query
def prediction_counts(spark, d):
    return publish(aggregates.prediction_counts(v.attempts(spark, d)))


@query
def kt_features(spark, d):
    rows = v.attempts(spark, d)
    split = splits.split_by_key(rows, key="student_id", fractions=splits.EXPERIMENT_FRACTIONS)
    difficulty = aggregates.skill_difficulty(split.where(F.col("split") == "train_fit"))
    return publish(windows.kt_features(rows, difficulty=difficulty).drop("ts"))


# --- snapshots -----------------------------------------------------------------------------


def _course_tables(spark, d):
    enrolled = clean.normalize_band(v.enrollments(spark, d), "imd_band")
    return enrolled, v.assessments(spark, d), v.submissions(spark, d), v.clicks(spark, d)


@query
def dropout_snapshot(spark, d):
    return publish(snapshots.dropout_snapshot(*_course_tables(spark, d)))


@query
def performance_snapshot(spark, d):
    return publish(snapshots.performance_snapshot(*_course_tables(spark, d)))


@query
def attendance_snapshot(spark, d):
    return publish(snapshots.attendance_snapshot(v.attendance(spark, d), threshold=0.3))


@query
def click_rollup(spark, d):
    return publish(v.clicks(spark, d))


@query
def due_counts(spark, d):
    return publish(aggregates.due_counts(v.assessments(spark, d), cutoff_day=30, types=("TMA", "CMA")))


@query
def enrollment_merge(spark, d):
    both = v.enrollments(spark, d)
    info = clean.normalize_band(both.drop("date_registration", "date_unregistration"), "imd_band")
    registration = both.select(*aggregates.ENROLLMENT, "date_registration", "date_unregistration")
    return publish(aggregates.merge_enrollments(info, registration))


@query
def room_readings(spark, d):
    return publish(snapshots.room_snapshot(v.room_readings(spark, d)))


@query
def absence_snapshot_dedup(spark, d):
    snapshot = snapshots.absence_snapshot(v.absence_records(spark, d))
    return publish(clean.drop_content_duplicates(snapshot, id_col="record_id"))


@query
def click_interactions(spark, d):
    rows = clean.interactions_from_clicks(v.clicks(spark, d))
    return publish(rows.select(
        "student_id", "ts", "type", F.col("metadata")["id_site"].alias("id_site"),
        F.col("metadata")["sum_click"].alias("sum_click")))


@query
def submission_results(spark, d):
    rows = clean.results_from_submissions(v.submissions(spark, d), v.assessments(spark, d))
    return publish(rows.drop("assessment_id"))


# --- students and classes --------------------------------------------------------------------


@query
def student_engagement(spark, d):
    return publish(summaries.student_engagement(v.interactions(spark, d)))


@query
def student_assessment(spark, d):
    return publish(summaries.student_assessment(v.assessment_results(spark, d)))


@query
def student_state_totals(spark, d):
    return publish(summaries.student_state_totals(mastery.bkt_mastery(v.attempts(spark, d))))


@query
def student_totals(spark, d):
    states = mastery.bkt_mastery(v.attempts(spark, d))
    return publish(summaries.student_totals(states, v.interactions(spark, d), v.assessment_results(spark, d)))


@query
def event_timeline(spark, d):
    return publish(summaries.event_timeline(v.interactions(spark, d), v.assessment_results(spark, d)))


def _rosters(spark, d):
    return att.class_rosters(v.attempts(spark, d), v.student_classes(spark, d))


def _report(spark, d, **kwargs):
    return classroom_report(v.attempts(spark, d), v.student_classes(spark, d), v.problems(spark, d), **kwargs)


@query
def class_roster(spark, d):
    return publish(att.cap_roster(_rosters(spark, d), cap=att.ROSTER_CAP))


@query
def class_roster_counts(spark, d):
    return publish(att.roster_counts(_rosters(spark, d), cap=att.ROSTER_CAP))


@query
def class_mastery(spark, d):
    return publish(_report(spark, d).mastery)


@query
def class_state(spark, d):
    return publish(_report(spark, d).classes)


@query
def class_engagement(spark, d):
    students = summaries.student_engagement(v.interactions(spark, d))
    return publish(summaries.class_engagement(students, _rosters(spark, d)))


@query
def class_assessment(spark, d):
    students = summaries.student_assessment(v.assessment_results(spark, d))
    return publish(summaries.class_assessment(students, v.student_classes(spark, d)))


@query
def class_environment(spark, d):
    return publish(summaries.environment_summary(v.sensor_readings(spark, d), tie_break=["event_id"]))


@query
def class_as_of(spark, d):
    states = mastery.bkt_mastery(v.attempts(spark, d))
    students = summaries.student_state_totals(states).select("student_id", "as_of")
    return publish(summaries.class_as_of(students, _rosters(spark, d)))


@query
def skill_priority(spark, d):
    return publish(class_skill_priorities(v.attempts(spark, d), v.student_classes(spark, d)))


@query
def problem_topk(spark, d):
    return publish(recommend.problem_topk(att.problems_by_skill(v.problems(spark, d))))


@query
def class_recommendation(spark, d):
    rows = _report(spark, d).recommendation
    ids = F.transform("problems", lambda p: p["problem_id"].cast("string"))
    return publish(rows.withColumn("problems", F.array_join(ids, ",")))


@query
def decision_support(spark, d):
    rows = _report(spark, d).decision
    resources = F.transform("recommended_resources", lambda p: p["problem_id"].cast("string"))
    return publish(rows.select(
        "class_id", "summary", "priority_skill", "rationale", F.array_join(resources, ",").alias("problems"),
        F.array_join("evidence", "|").alias("evidence"), F.array_join("limitations", "|").alias("limitations"),
        "suggested_action"))


def _signals(spark, d):
    records = v.absence_records(spark, d)
    risk = records.select("record_id", ((F.col("raised_hands") + 1) / 101.0).alias("prob"))
    return decision.context_signals(decision.context_rows(
        v.context_mapping(spark, d), v.sensor_readings(spark, d), records, risk, tie_break=("event_id",)))


@query
def context_signals(spark, d):
    return publish(_signals(spark, d))


@query
def missing_context(spark, d):
    return publish(decision.missing_context(_rosters(spark, d), _signals(spark, d)))


# --- data quality ----------------------------------------------------------------------------


@query
def dq_unique(spark, d):
    return quality.check_unique(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], table="lineitem")


@query
def dq_foreign_key(spark, d):
    children = v.table(spark, d, "events").select(F.col("user_id").alias("k"))
    parents = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return quality.check_foreign_key(children, parents, ["k"], table="events")


@query
def dq_foreign_key_rows(spark, d):
    children = v.table(spark, d, "events").select(F.col("user_id").alias("k"))
    parents = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return quality.check_foreign_key_rows(children, parents, ["k"], table="events")


@query
def dq_duplicates(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return quality.check_duplicates(rows, table="lineitem")


@query
def dq_row_count(spark, d):
    both = v.enrollments(spark, d)
    return quality.check_row_count(v.table(spark, d, "customer"), both, table="enrollments")


@query
def dq_allowed(spark, d):
    return quality.check_allowed(v.table(spark, d, "lineitem"), "l_returnflag", ["A", "N"], table="lineitem")


@query
def dq_range(spark, d):
    return quality.check_range(v.submissions(spark, d), "score", 5, 95, table="submissions")


@query
def dq_nulls(spark, d):
    return quality.check_nulls(v.submissions(spark, d), table="submissions")


@query
def dq_identity(spark, d):
    return quality.check_identity(
        v.attendance(spark, d), "enrolled", ["present", "absent", "released"], table="attendance")


@query
def dq_unseen_values(spark, d):
    return quality.unseen_values(v.sensor_readings(spark, d), "sensor_id", ["CO2_01", "CO2_02", "CO2_03"])


@query
def dq_two_hop(spark, d):
    return quality.check_two_hop(
        v.submissions(spark, d), v.assessments(spark, d), v.enrollments(spark, d),
        bridge_key="id_assessment", parent_keys=aggregates.ENROLLMENT, table="submissions")


@query
def dq_one_to_one(spark, d):
    left = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    right = v.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return quality.check_one_to_one(left, right, ["k"], table="customer")


# --- ordering and splits -----------------------------------------------------------------------


@query
def transitions(spark, d):
    rows = windows.transitions(
        v.room_readings(spark, d), key=["source_file"], order=["recorded_at", "event_id"], value="occupancy")
    return publish(rows.select("event_id", "source_file", "occupancy", "is_transition"))


@query
def persistence_accuracy(spark, d):
    rows = windows.previous_outcome(
        v.room_readings(spark, d), key=["source_file"], order=["recorded_at", "event_id"], value="occupancy", first=None)
    return publish(rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("previous") == F.col("occupancy")).cast("double")).alias("accuracy")))


@query
def chronological_split(spark, d):
    rows = splits.chronological_split(v.room_readings(spark, d), order_by=["recorded_at", "event_id"])
    return publish(rows.select("event_id", "split"))


@query
def stratified_split(spark, d):
    rows = v.enrollments(spark, d).withColumn("is_dropout", clean.is_withdrawn()).select("id_student", "is_dropout")
    return publish(splits.stratified_split(rows, label="is_dropout", key="id_student"))


@query
def key_split(spark, d):
    rows = splits.split_by_key(v.attempts(spark, d), key="student_id", fractions=splits.EXPERIMENT_FRACTIONS)
    return publish(rows.select("event_id", "student_id", "split"))


@query
def surrogate_key(spark, d):
    rows = v.attempts(spark, d).select("student_id", "ts", "event_id")
    return publish(with_surrogate_key(rows, ["student_id", "ts", "event_id"], "id").select("event_id", "id"))


# --- identity and keyed state --------------------------------------------------------------------


@query
def twin_identity(spark, d):
    return v.table(spark, d, "customer").select(
        "c_custkey", uuid5_col("assistments", F.col("c_custkey")).alias("identity"))


@query
def upsert_latest_q(spark, d):
    base = v.table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("version"))
    updates = v.table(spark, d, "events").select(
        F.col("user_id").alias("k"), "value", (F.col("event_id") + 1_000_000_000).alias("version"))
    return publish(upsert_latest(base, updates, keys=["k"], order_by=["version"]))


@query
def delete_keys_q(spark, d):
    base = v.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    gone = v.table(spark, d, "events").select(F.col("user_id").alias("k"))
    return publish(delete_keys(base, gone, keys=["k"]))


# --- scored frames ---------------------------------------------------------------------------------


@query
def confusion_matrix(spark, d):
    rows = v.scored_lines(spark, d).withColumn("prediction", (F.col("prob") >= 0.5).cast("int"))
    return publish(aggregates.confusion_matrix(rows))


@query
def classification_report(spark, d):
    return publish(metrics.classification_report(v.scored_lines(spark, d)))


@query
def transition_report(spark, d):
    rows = windows.transitions(
        v.room_readings(spark, d), key=["source_file"], order=["recorded_at", "event_id"], value="occupancy")
    scored = rows.select(F.col("occupancy").alias("label"), (F.col("humidity_pct") / 100).alias("prob"), "is_transition")
    return publish(metrics.transition_report(scored))


@query
def threshold_sweep(spark, d):
    return publish(metrics.threshold_sweep(v.scored_lines(spark, d)))
