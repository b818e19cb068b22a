"""The given tables seen as learning-analytics tables.

Each view is a function of (spark, directory). ``VIEW_SQL`` in ``oracle_views`` states the same
definitions in SQL for the cross-check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edupulse.operators.aggregates import click_rollup
from edupulse.operators.sizes import in_even_tasks

SKILLS = ["click", "error", "purchase", "signup", "view"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once in an application."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("student_id"), F.col("event_type").alias("topic_id"), "ts", "event_id",
        (F.col("value") >= 30).alias("correct"))


def student_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every customer in the class of the nation; those with a large balance also in the next."""
    home = F.col("c_nationkey").cast("long")
    both = F.when(F.col("c_acctbal") >= 6000, F.array(home, (home + 1) % 25)).otherwise(F.array(home))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("student_id"), F.explode(both).alias("class_id"))


def problems(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.avg((F.col("l_returnflag") != "R").cast("double")).alias("mean_correct"),
        F.avg("l_quantity").alias("mean_time_on_task"),
        F.count(F.lit(1)).alias("student_answer_count"))
    first = _pick(SKILLS, F.col("p_partkey") % 5)
    second = _pick(SKILLS, F.col("p_size") % 5)
    literal = F.concat(F.lit("['"), first, F.when(first != second, F.concat(F.lit("', '"), second)).otherwise(F.lit("")), F.lit("']"))
    return table(spark, d, "part").join(usage, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("problem_id"), literal.alias("skills"), "mean_correct", "mean_time_on_task",
        "student_answer_count")


def courses(spark: SparkSession, d: str) -> DataFrame:
    e = enrollments(spark, d)
    return e.select("code_module", "code_presentation").distinct()


def enrollments(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, band = F.col("c_custkey"), F.floor(F.col("c_acctbal") / 1000).cast("long")
    outcome = key % 10
    result = (F.when(outcome <= 1, "Withdrawn").when(outcome <= 3, "Fail").when(outcome <= 8, "Pass")
              .otherwise("Distinction"))
    return customer.select(
        F.col("c_mktsegment").alias("code_module"),
        F.col("r_name").alias("code_presentation"),
        key.alias("id_student"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.col("n_name").alias("highest_education"),
        F.when(band >= 0, F.concat((band * 10).cast("string"), F.lit("-"), (band * 10 + 10).cast("string"),
                                   F.when(band == 1, "").otherwise("%"))).alias("imd_band"),
        _pick(["0-35", "35-55", "55<="], F.col("c_nationkey") % 3).alias("age_band"),
        (key % 4).alias("num_of_prev_attempts"),
        ((key % 6 + 1) * 30).alias("studied_credits"),
        F.when(key % 11 == 0, "Y").otherwise("N").alias("disability"),
        F.when(key % 50 != 0, -(key % 120)).alias("date_registration"),
        F.when((outcome <= 1) & (key % 7 != 0), key % 97).alias("date_unregistration"),
        result.alias("final_result"),
    )


def assessments(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("p_partkey")
    kind = _pick(["TMA", "CMA", "Exam"], F.col("p_size") % 3)
    return table(spark, d, "part").select(
        part.alias("id_assessment"),
        _pick(SEGMENTS, part % 5).alias("code_module"),
        _pick(REGIONS, F.floor(part / 5) % 5).alias("code_presentation"),
        kind.alias("assessment_type"),
        F.when(kind != "Exam", F.col("p_size").cast("long")).alias("date"),
        F.lit(10.0).alias("weight"),
    )


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Line items with the customer of their order, and how many line items there are (read from the file's footers).

    The tasks are sized by the longer table, so a task's orders fit a hash table and its line items need no sort.
    """
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = line.count()
    longer = max(rows, orders.count())
    orders = in_even_tasks(orders, ["o_orderkey"], longer).hint("shuffle_hash")
    return in_even_tasks(line, ["l_orderkey"], longer).join(orders, F.col("l_orderkey") == F.col("o_orderkey")), rows


def submissions(spark: SparkSession, d: str) -> DataFrame:
    line, rows = _lines(spark, d)
    # Dealt by assessment alone: the first deliveries and their assessments then meet without another shuffle.
    first = in_even_tasks(line, ["l_partkey"], rows).groupBy("l_partkey", "o_custkey").agg(
        F.min("l_quantity").alias("day"), F.min("l_extendedprice").alias("price"),
        F.max("l_linenumber").alias("line"), F.max("l_discount").alias("discount"))
    return first.select(
        F.col("l_partkey").alias("id_assessment"),
        F.col("o_custkey").alias("id_student"),
        F.col("day").cast("long").alias("date_submitted"),
        F.when(F.col("line") != 7, F.floor("price") % 101).cast("double").alias("score"),
        (F.col("discount") >= 0.09).alias("is_banked"),
    )


def raw_clicks(spark: SparkSession, d: str) -> DataFrame:
    course = enrollments(spark, d).select("code_module", "code_presentation", "id_student")
    line, rows = _lines(spark, d)
    return (
        in_even_tasks(line, ["o_custkey"], rows)
        .join(course, F.col("o_custkey") == F.col("id_student"))
        .select("code_module", "code_presentation", "id_student", F.col("l_suppkey").alias("id_site"),
                (F.col("l_partkey") % 60).alias("date"), F.col("l_quantity").cast("long").alias("sum_click"))
    )


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return click_rollup(raw_clicks(spark, d), rows=0)


def attendance(spark: SparkSession, d: str) -> DataFrame:
    month = F.to_date(F.date_trunc("month", F.col("l_shipdate")))
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("school_id"), month.alias("attendance_date"),
    ).agg(
        F.count(F.lit(1)).alias("enrolled"), F.count_if(flag == "A").alias("present"),
        F.count_if(flag == "R").alias("absent"), F.count_if(flag == "N").alias("released"),
    ).withColumn("school_year", F.year("attendance_date").cast("string"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    tried = F.col("event_type").isin("click", "purchase", "error")
    return table(spark, d, "events").select(
        F.col("user_id").alias("student_id"), "ts", "event_id",
        F.when(tried, "problem_attempt").otherwise("resource_view").alias("type"),
        F.when(tried, F.col("event_type")).alias("topic_id"),
        F.when(tried, F.col("value") >= 30).alias("outcome"))


def assessment_results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("student_id"), F.col("o_orderkey").alias("assessment_id"),
        (F.col("o_totalprice") % 101).alias("score"), F.col("o_orderdate").alias("submitted_at"))


def room_readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("room"), (F.col("user_id") % 10).cast("string")).alias("source_file"),
        F.col("ts").alias("recorded_at"), "event_id",
        F.col("value").alias("temperature_c"), (F.col("event_id") % 100).cast("double").alias("humidity_pct"),
        (F.col("value") * 2).alias("light_lux"), (F.col("value") * 10 + 400).alias("co2_ppm"),
        (F.col("value") >= 30).cast("int").alias("occupancy"))


def sensor_readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("CO2_0"), (F.col("user_id") % 6 + 1).cast("string")).alias("sensor_id"),
        F.col("ts").alias("recorded_at"), "event_id",
        F.col("value").alias("temperature_c"), (F.col("event_id") % 100).cast("double").alias("humidity_pct"),
        F.floor(F.col("value") * 10 + 400).alias("co2_ppm"),
        (F.col("event_id") % 101).cast("double").alias("battery_pct"))


def absence_records(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    n = F.col("n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("record_id"),
        F.col("lang").alias("stage_id"), F.col("source").alias("grade_id"),
        F.lit("A").alias("section_id"), F.col("lang").alias("topic"), F.lit("F").alias("semester"),
        F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("parent_answering_survey"),
        F.when(F.col("quality") == 1, "Good").otherwise("Bad").alias("parent_school_satisfaction"),
        (n % 100).alias("raised_hands"), (n % 10).alias("visited_resources"),
        (n % 5).alias("announcements_view"), (n % 4).alias("discussion"),
        F.when(F.col("toxic") == 1, "Above-7").otherwise("Under-7").alias("student_absence_days"))


def context_mapping(spark: SparkSession, d: str) -> DataFrame:
    """One mapping row per class: no sensor in region 4, no record in region 3."""
    key = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(
        F.lit("assistments").alias("source_dataset"), key.alias("class_id"),
        F.when(F.col("n_regionkey") != 4, F.concat(F.lit("CO2_0"), (key % 6 + 1).cast("string"))).alias("sensor_id"),
        F.when(F.col("n_regionkey") != 3, key).alias("record_id"))


def scored_lines(spark: SparkSession, d: str) -> DataFrame:
    """A closed-form score and a label per line item, for the metric queries."""
    return table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        ((F.col("l_quantity") / 50 + F.col("l_discount") * 5) / 2).alias("prob"))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        attempts, student_classes, problems, courses, enrollments, assessments, submissions, raw_clicks, clicks,
        attendance, interactions, assessment_results, room_readings, sensor_readings, absence_records,
        context_mapping, scored_lines)
}
