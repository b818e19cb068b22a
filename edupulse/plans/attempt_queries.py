"""Named queries that start from raw logs: attempt facts, list lookups, cleaning, and attached latest rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edupulse.functions.identity import uuid5_col
from edupulse.functions.lists import contains_item
from edupulse.operators import aggregates, attempts as att, clean, mastery, splits, summaries, windows
from edupulse.plans import driver_tables as v
from edupulse.plans.classroom import classroom_report
from edupulse.plans.oracles import BODIES, ORACLES, TS
from edupulse.plans.oracle_views import with_views
from edupulse.plans.queries import publish, query


def problem_logs(spark: SparkSession, d: str) -> DataFrame:
    """Line items as problem logs: line 7 has no outcome, every 13th order no problem."""
    return v.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("log_id"), F.when(F.col("l_orderkey") % 13 > 0, F.col("l_partkey")).alias("problem_id"),
        F.col("l_shipdate").alias("start_time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_returnflag") != "R").alias("correct"))


def assignment_logs(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.col("o_custkey").alias("student_id"))


def skill_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parts as problems: of seven sizes one has no list, one an empty and one a malformed one."""
    first, second = v._pick(v.SKILLS, F.col("p_partkey") % 5), v._pick(v.SKILLS, F.col("p_size") % 5)
    kind = F.col("p_size") % 7
    literal = (F.when(kind == 0, None).when(kind == 1, "[]").when(kind == 2, F.concat(F.lit("['"), first))
               .otherwise(F.concat(F.lit("['"), first, F.lit("', \""), second, F.lit("\"]"))))
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("problem_id"), literal.alias("skills"))


_FIRST = f"({v.SKILLS!r})[p_partkey % 5 + 1]"
_SECOND = f"({v.SKILLS!r})[p_size % 5 + 1]"
_LOGS = "(SELECT *, CASE WHEN l_orderkey % 13 > 0 THEN l_partkey END AS problem_id FROM lineitem)"


@query
def attempt_facts(spark, d):
    return publish(att.attempts(problem_logs(spark, d), assignment_logs(spark, d), skill_lists(spark, d)))


@query
def skill_lookup(spark, d):
    """Whole items only: "lick" is in no list."""
    skills = F.col("skills")
    return skill_lists(spark, d).select(
        "problem_id", contains_item(skills, F.lit("click")).alias("has_click"), contains_item(skills, F.lit("lick")).alias("has_lick"))


@query
def attempts_with_keys(spark, d):
    kept = clean.drop_null_keys(problem_logs(spark, d), ["log_id", "problem_id"])
    return kept.groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.min("problem_id").alias("first_problem"))


@query
def full_dedupe(spark, d):
    return clean.drop_full_duplicates(v.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_returnflag"))


@query
def fact_dimension(spark, d):
    return clean.distinct_dimension(v.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query
def verified_identity(spark, d):
    """Every third customer carries another's identity."""
    key = F.col("c_custkey")
    supplied = F.when(key % 3 > 0, uuid5_col("assistments", key)).otherwise(uuid5_col("assistments", key + 1))
    rows = v.table(spark, d, "customer").select("c_custkey", supplied.alias("identity"))
    return clean.verify_identity(rows, dataset="assistments", id_col="c_custkey", identity_col="identity").select("c_custkey")


@query
def course_members(spark, d):
    members = clean.lookup(v.enrollments(spark, d), code_module="BUILDING", code_presentation="ASIA")
    return clean.restrict_to(members, v.submissions(spark, d), key="id_student").select("id_student", "final_result")


@query
def merged_parts(spark, d):
    events = v.table(spark, d, "events").select("event_id", "event_type")
    parts = [events.where(F.col("event_type") == t).withColumn("part", F.lit(t)) for t in v.SKILLS]
    return clean.union_all(parts).select("part", "event_id")


@query
def latest_attached(spark, d):
    """Every customer with the newest result; those without one keep nulls."""
    base = v.table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"))
    rows = summaries.attach_latest(base, v.assessment_results(spark, d), keys=["student_id"], order_by=["submitted_at", "assessment_id"])
    return publish(rows.select("student_id", "assessment_id", "score"))


def _rosters(spark, d):
    return att.class_rosters(v.attempts(spark, d), v.student_classes(spark, d))


@query
def class_overview(spark, d):
    classes = classroom_report(v.attempts(spark, d), v.student_classes(spark, d), v.problems(spark, d)).classes
    rosters = _rosters(spark, d)
    engagement = summaries.class_engagement(summaries.student_engagement(v.interactions(spark, d)), rosters)
    assessment = summaries.class_assessment(summaries.student_assessment(v.assessment_results(spark, d)), rosters)
    # Classes 0 to 5 hold the six sensors.
    readings = v.sensor_readings(spark, d).withColumn("class_id", F.substring("sensor_id", 6, 1).cast("long") - 1)
    environment = summaries.environment_summary(readings, key="class_id", tie_break=["event_id"])
    return publish(summaries.class_overview(classes, engagement, assessment, environment))


@query
def student_snapshot(spark, d):
    states = mastery.bkt_mastery(v.attempts(spark, d))
    interactions, results = v.interactions(spark, d), v.assessment_results(spark, d)
    engagement = summaries.student_engagement(interactions).select("student_id", "total_interactions", "active_days", "trend")
    assessment = summaries.student_assessment(results).select("student_id", "total_results", "average_score", "trend")
    return publish(summaries.student_snapshot(summaries.student_totals(states, interactions, results), engagement, assessment))


@query
def kt_vector(spark, d):
    rows = v.attempts(spark, d)
    split = splits.split_by_key(rows, key="student_id", fractions=splits.EXPERIMENT_FRACTIONS)
    difficulty = aggregates.skill_difficulty(split.where(F.col("split") == "train_fit"))
    vectors = windows.kt_vector(windows.kt_features(rows, difficulty=difficulty), policy="linear").select(
        "event_id", "label", vector_to_array("features").alias("x"))
    names = [*windows.NUMERIC_FEATURES, *windows.INDICATOR_FEATURES]
    return publish(vectors.select("event_id", "label", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]))


_SQL = {
    "attempt_facts": f"""
        SELECT o_custkey AS student_id, {_FIRST} AS topic_id, strftime(l_shipdate, {TS}) AS ts, l_orderkey * 10 + l_linenumber AS event_id,
               l_returnflag <> 'R' AS correct
        FROM {_LOGS} JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = problem_id
        WHERE l_linenumber <> 7 AND p_size % 7 > 2""",
    "skill_lookup": f"""
        SELECT p_partkey AS problem_id, p_size % 7 > 2 AND 'click' IN ({_FIRST}, {_SECOND}) AS has_click, FALSE AS has_lick FROM part""",
    "attempts_with_keys": f"""
        SELECT CASE WHEN l_linenumber <> 7 THEN l_returnflag <> 'R' END AS correct, count(*) AS n, min(problem_id) AS first_problem
        FROM {_LOGS} WHERE problem_id IS NOT NULL GROUP BY 1""",
    "full_dedupe": "SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag FROM lineitem",
    "fact_dimension": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "verified_identity": "SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0",
    "course_members": """SELECT id_student, final_result FROM enrollments WHERE code_module = 'BUILDING' AND code_presentation = 'ASIA'
                         AND id_student IN (SELECT id_student FROM submissions)""",
    "merged_parts": "SELECT event_type AS part, event_id FROM events",
    "latest_attached": """
        SELECT c_custkey AS student_id, assessment_id, round(score, 6) AS score
        FROM customer LEFT JOIN (SELECT * FROM assessment_results QUALIFY row_number() OVER (
            PARTITION BY student_id ORDER BY submitted_at DESC, assessment_id DESC) = 1) r ON r.student_id = c_custkey""",
    "class_overview": f"""
        SELECT * FROM ({BODIES["class_state"]})
        LEFT JOIN ({BODIES["class_engagement"]}) USING (class_id)
        LEFT JOIN ({BODIES["class_assessment"].replace("FROM student_classes JOIN", "FROM rosters JOIN")}) USING (class_id)
        LEFT JOIN (SELECT substr(sensor_id, 6, 1)::BIGINT - 1 AS class_id, * EXCLUDE (sensor_id) FROM ({BODIES["class_environment"]})) USING (class_id)""",
    "student_snapshot": f"""
        SELECT t.*, total_interactions, active_days, e.trend AS engagement_trend, total_results, round(average_score, 6) AS average_score,
               a.trend AS assessment_trend
        FROM ({BODIES["student_totals"]}) t LEFT JOIN student_engagement e USING (student_id) LEFT JOIN student_assessment a USING (student_id)""",
    "kt_vector": f"""
        SELECT event_id, correct::INT::DOUBLE AS label, {", ".join(f"coalesce({n}::DOUBLE, 0) AS {n}" for n in windows.NUMERIC_FEATURES)},
               {", ".join(f"{n}::INT::DOUBLE AS {n}" for n in windows.INDICATOR_FEATURES)} FROM ({BODIES["kt_features"]})""",
}
BODIES.update(_SQL)
ORACLES.update({name: with_views(body) for name, body in _SQL.items()})
