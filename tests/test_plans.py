"""Plan shapes that matter at scale."""

from __future__ import annotations

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "bkt_mastery", "bkt_trajectory", "kt_features", "dropout_snapshot", "attendance_snapshot", "student_engagement",
    "student_assessment", "class_roster", "skill_priority", "problem_topk", "decision_support", "transitions",
    "key_split", "stratified_split", "chronological_split", "upsert_latest", "delete_keys", "event_timeline"])
def test_no_single_partition(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


@pytest.mark.parametrize("name", ["class_roster", "problem_topk", "student_assessment"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    partial, final = text.rfind("WindowGroupLimit"), text.find("WindowGroupLimit")
    assert final != -1 and "Exchange" in text[final:partial]


def test_histories_share_one_shuffle(spark):
    """Windows per student and per (student, skill), and the fold, run on one hash shuffle."""
    text = plan(QUERIES["kt_features"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark):
    from edupulse.operators.attempts import attempts

    logs = spark.createDataFrame(
        [(1, 1, 1, None, True, 0.5)],
        "id long, log_id long, problem_id long, start_time timestamp, correct boolean, time_on_task double")
    folder = __import__("tempfile").mkdtemp(prefix="spark-")
    logs.write.parquet(f"{folder}/logs")
    others = spark.createDataFrame([(1, 7)], "log_id long, student_id long"), spark.createDataFrame(
        [(1, "['a']")], "problem_id long, skills string")
    text = plan(attempts(spark.read.parquet(f"{folder}/logs"), *others))
    scan = text[text.index("FileScan"):]
    assert "time_on_task" not in scan and "IsNotNull(correct)" in scan
