"""Templated decision support and context signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edupulse.functions.scalars import two_decimals
from edupulse.operators.recommend import MIN_ANSWERS, MIN_OBSERVATIONS, TARGET_SUCCESS
from edupulse.operators.summaries import latest_rows

# The published wording. {0}, {1}, … are filled with column values.
NON_CAUSAL = (
    "This summary describes patterns in already-recorded ASSISTments attempt history. "
    "It does not establish that any listed problem improves learning outcomes — no "
    "controlled or randomized comparison exists in this data."
)
CONTEXT_NOTE = (
    "The signals below come from datasets with no identity mapping to this "
    "classroom's roster or students (see each signal's own scope_description). "
    "They describe broader patterns in an unrelated cohort, room, or sensor — "
    "not this classroom — and must not be read as evidence about it."
)
SUMMARY = "Classroom {0} ({1}): {2} included, {3} topics observed."
ROSTER_CAPPED = "{0} of {1} eligible students"
ROSTER_ALL = "all {0} eligible students"
NO_SKILL_RATIONALE = (
    "No topic in this classroom has at least {0} pooled observations, the minimum this system "
    "requires before treating a topic's average mastery as reliable enough to rank."
)
NO_SKILL_EVIDENCE = (
    "No topic met the minimum observation-count reliability threshold used by "
    "skill_priority.recommend_skill_priorities."
)
NO_SKILL_ACTION = (
    "Consider assigning additional graded practice across topics, then re-run this analysis "
    "once more attempts are recorded."
)
RATIONALE = (
    "'{0}' is ranked as the top-priority topic because it has the lowest average mastery ({1}) "
    "among topics with at least {2} pooled observations (this topic has {3}), based on the {4} "
    "students included in this analysis."
)
SKILL_EVIDENCE = "'{0}': average_mastery={1}, priority_score={2}, observation_count={3}."
NO_RESOURCE_EVIDENCE = "No resource recommendation is currently available for '{0}'."
NO_PROBLEM_EVIDENCE = (
    "No catalog problem tagged '{0}' had at least {1} recorded answers, the minimum this system "
    "requires before trusting a problem's historical success rate."
)
PROBLEM_EVIDENCE = (
    "Problem {0}: historical mean_correct={1} over {2} recorded answers (target success rate ~{3})."
)
CAP_LIMITATION = (
    "Only {0} of {1} eligible students were included in this analysis; the remaining roster was "
    "not sampled and may differ."
)
RANKING_LIMITATION = (
    "Recommended problems are ranked by how close their own historical success rate is to a "
    "target range, not by any measured learning outcome."
)
PROBLEM_ACTION = (
    "Consider reviewing the listed problems for '{0}' with the class, then check mastery again "
    "after new attempts are recorded."
)
CATALOG_ACTION = (
    "Consider reviewing the ASSISTments catalog for '{0}' directly, since no ranked resource is "
    "currently available."
)
RECORD_SCOPE = "xapi_record_id={0} (explicitly configured for {1} class_id={2})"
COHORT_SCOPE = (
    "xAPI-Edu-Data cohort/class-section context ({0}); xAPI-Edu-Data has no student-identifying "
    "column and shares no identifier with ASSISTments or OULAD — this is not this classroom's "
    "or any specific student's data."
)
SENSOR_SCOPE = (
    "Independent environmental sensor reading (sensor_id='{0}'); no dataset links this sensor to "
    "any ASSISTments classroom or student."
)
RISK_SCOPE = (
    "xAPI-Edu-Data absence-risk model prediction for one explicitly mapped record ({0}); the "
    "underlying model predicts xAPI-Edu-Data's own coarse student_absence_days bucket, not a "
    "verified per-day attendance record. xAPI-Edu-Data has no student-identifying column and "
    "shares no identifier with ASSISTments or OULAD — this is not this classroom's or any "
    "specific student's data."
)
SENSOR_DATASET = "environmental_sensors"
RECORD_DATASET = "xapi_edu_data"
SENSOR_METRICS = ["co2_ppm", "temperature_c", "humidity_pct"]
RECORD_METRICS = ["raised_hands", "visited_resources", "announcements_view", "discussion"]
RISK_METRIC = "predicted_absence_risk"
CONTEXT_CATEGORIES = {
    SENSOR_DATASET: "environmental/CO2 sensor context",
    RECORD_DATASET: "xAPI-Edu-Data engagement/absence-risk context",
}
ALWAYS_UNAVAILABLE = (
    "UCI Occupancy Detection room-occupancy benchmark data (no inference-on-new-observation "
    "model exists for it in this system, so it is never available for any classroom)"
)


def _fill(template: str, *values: Column | str | float) -> Column:
    """The template with its numbered places filled, as one concat."""
    parts: list[Column] = []
    rest = template
    for i, value in enumerate(values):
        head, rest = rest.split("{%d}" % i, 1)
        parts += [F.lit(head), value.cast("string") if isinstance(value, Column) else F.lit(str(value))]
    return F.concat(*parts, F.lit(rest))


def decision_support(
    class_state: DataFrame, priorities: DataFrame, recommendation: DataFrame, *,
    source_dataset: str = "assistments", context: DataFrame | None = None,
) -> DataFrame:
    """D3: one explained record per class.

    ``class_state``: class_id, students_used, students_eligible, roster_capped, topics_observed.
    ``priorities`` is T1 and ``recommendation`` T5; a class may be in neither, or in the first
    only. ``context`` (D4) adds its signals and a note and changes nothing else.
    """
    top = priorities.where(F.col("priority_rank") == 1).select(
        "class_id", F.col("topic_id").alias("priority_skill"), "average_mastery", "priority_score", "observation_count")
    offered = recommendation.select("class_id", "problems")
    rows = class_state.join(top, "class_id", "left").join(offered, "class_id", "left")

    used, eligible, capped = F.col("students_used"), F.col("students_eligible"), F.col("roster_capped")
    skill, problems = F.col("priority_skill"), F.col("problems")
    roster = F.when(capped, _fill(ROSTER_CAPPED, used, eligible)).otherwise(_fill(ROSTER_ALL, used))
    has_problems = F.coalesce(F.size("problems") > 0, F.lit(False))
    problem_lines = F.transform("problems", lambda p: _fill(
        PROBLEM_EVIDENCE, p["problem_id"], two_decimals(p["mean_correct"]), p["student_answer_count"],
        f"{TARGET_SUCCESS:.2f}"))
    skill_line = _fill(SKILL_EVIDENCE, skill, two_decimals(F.col("average_mastery")),
                       two_decimals(F.col("priority_score")), F.col("observation_count"))
    evidence = (
        F.when(skill.isNull(), F.array(F.lit(NO_SKILL_EVIDENCE)))
        .when(problems.isNull(), F.array(skill_line, _fill(NO_RESOURCE_EVIDENCE, skill)))
        .when(~has_problems, F.array(skill_line, _fill(NO_PROBLEM_EVIDENCE, skill, MIN_ANSWERS)))
        .otherwise(F.concat(F.array(skill_line), problem_lines))
    )
    limitations = F.array_compact(F.array(
        F.lit(NON_CAUSAL),
        F.when(capped, _fill(CAP_LIMITATION, used, eligible)),
        F.when(skill.isNotNull(), F.lit(RANKING_LIMITATION)),
    ))
    action = (
        F.when(skill.isNull(), NO_SKILL_ACTION)
        .when(has_problems, _fill(PROBLEM_ACTION, skill))
        .otherwise(_fill(CATALOG_ACTION, skill))
    )
    rationale = F.when(skill.isNull(), _fill(NO_SKILL_RATIONALE, MIN_OBSERVATIONS)).otherwise(_fill(
        RATIONALE, skill, two_decimals(F.col("average_mastery")), MIN_OBSERVATIONS, F.col("observation_count"), used))
    result = rows.select(
        "class_id",
        _fill(SUMMARY, F.col("class_id"), source_dataset, roster, F.col("topics_observed")).alias("summary"),
        "priority_skill",
        rationale.alias("rationale"),
        F.when(has_problems, problems).otherwise(F.array().cast(rows.schema["problems"].dataType)).alias("recommended_resources"),
        evidence.alias("evidence"),
        limitations.alias("limitations"),
        action.alias("suggested_action"),
    )
    if context is None:
        return result.withColumn("context_note", F.lit(None).cast("string"))
    signal = F.struct("source_dataset", "scope_description", "metric_name", "value", "as_of")
    # A class has at most eight signals: three sensor, four record, one prediction.
    signals = context.groupBy("class_id").agg(F.sort_array(F.collect_list(signal)).alias("context_signals"))
    return result.join(signals, "class_id", "left").withColumn(
        "context_note", F.when(F.col("context_signals").isNotNull(), CONTEXT_NOTE))


def context_rows(mapping: DataFrame, readings: DataFrame, records: DataFrame, predictions: DataFrame,
                 *, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Each mapped class with its sensor's latest reading, record counts and prediction.

    Only explicitly mapped classes appear; a missing half stays NULL.
    """
    latest = latest_rows(
        readings.select("sensor_id", "recorded_at", *SENSOR_METRICS, *tie_break),
        keys=["sensor_id"], order_by=["recorded_at", *tie_break]).drop(*tie_break)
    counts = records.select("record_id", *RECORD_METRICS, F.lit(True).alias("has_record"))
    risk = predictions.select("record_id", F.col("prob").alias(RISK_METRIC))
    return (
        mapping.select("source_dataset", "class_id", "sensor_id", "record_id")
        .join(latest, "sensor_id", "left").join(counts, "record_id", "left").join(risk, "record_id", "left")
    )


def context_signals(rows: DataFrame) -> DataFrame:
    """Signals in long form with their provenance text, in no way tied to a student."""
    scope = _fill(RECORD_SCOPE, F.col("record_id"), F.col("source_dataset"), F.col("class_id"))
    no_time = F.lit(None).cast(rows.schema["recorded_at"].dataType)

    def signal(dataset: str, text: Column, metric: str, as_of: Column, present: Column) -> Column:
        return F.when(present, F.struct(
            F.lit(dataset).alias("source_dataset"), text.alias("scope_description"),
            F.lit(metric).alias("metric_name"), F.col(metric).cast("double").alias("value"), as_of.alias("as_of")))

    sensor = [signal(SENSOR_DATASET, _fill(SENSOR_SCOPE, F.col("sensor_id")), m, F.col("recorded_at"),
                     F.col("recorded_at").isNotNull()) for m in SENSOR_METRICS]
    record = [signal(RECORD_DATASET, _fill(COHORT_SCOPE, scope), m, no_time, F.col("has_record")) for m in RECORD_METRICS]
    risk = signal(RECORD_DATASET, _fill(RISK_SCOPE, scope), RISK_METRIC, no_time,
                  F.col("has_record") & F.col(RISK_METRIC).isNotNull())
    return rows.select("class_id", F.explode(F.array_compact(F.array(*sensor, *record, risk))).alias("_s")).select(
        "class_id", "_s.*")


def missing_context(class_ids: DataFrame, signals: DataFrame) -> DataFrame:
    """The context categories each class has no signal of, by label."""
    wanted = class_ids.select("class_id").distinct().select("class_id", F.explode(
        F.array(*[F.lit(c) for c in CONTEXT_CATEGORIES])).alias("source_dataset"))
    absent = wanted.join(signals.select("class_id", "source_dataset").distinct(), ["class_id", "source_dataset"], "left_anti")
    label = F.create_map(*[F.lit(x) for pair in CONTEXT_CATEGORIES.items() for x in pair])[F.col("source_dataset")]
    always = class_ids.select("class_id").distinct().select("class_id", F.lit(ALWAYS_UNAVAILABLE).alias("unavailable"))
    return absent.select("class_id", label.alias("unavailable")).unionByName(always)
