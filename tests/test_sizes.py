from __future__ import annotations

from pyspark.sql import functions as F

from edupulse.operators import aggregates, sizes

CLICKS = "'AAA' AS code_module, '2013J' AS code_presentation, id % 40 AS id_student, id % 3 AS id_site, id % 7 AS date, id AS sum_click"


def test_rollup_tasks_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(sizes, "TASK_ROWS", 100)
    raw = spark.range(2000).selectExpr(*CLICKS.split(", "))
    rolled = aggregates.click_rollup(raw)
    # Twenty tasks of a hundred rows, although their few bytes would fit one.
    assert rolled.select(F.spark_partition_id().alias("p")).distinct().count() > 10
    assert rolled.agg(F.sum("sum_click"), F.count("*")).first() == (1999 * 1000, 840)


def test_few_rows_are_left_alone(spark):
    raw = spark.range(20).selectExpr(*CLICKS.split(", "))
    assert sizes.in_even_tasks(raw, ["id_student"], 20) is raw
