from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from edupulse.functions.identity import uuid5_col
from edupulse.functions.lists import contains_item, first_item, parse_list
from edupulse.functions.scalars import bucket_of, day_to_timestamp, two_decimals, with_percent
from edupulse.operators.clean import drop_content_duplicates, eligible_at, interactions_from_clicks, verify_identity
from edupulse.operators.ordinal import exact_medians, global_ordinal, with_surrogate_key


def test_uuid5_equals_the_library(spark):
    ids = [0, 1, 7, 52964, 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("u", uuid5_col("assistments", F.col("id")))
    for row in df.collect():
        assert row.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"assistments:{row.id}"))
    assert verify_identity(df, dataset="assistments", id_col="id", identity_col="u").count() == len(ids)
    assert verify_identity(df, dataset="oulad", id_col="id", identity_col="u").count() == 0


def test_list_literals(spark):
    cases = {"['a', 'b']": "a", '["it\'s", \'b\']': "it's", "[]": None, None: None, "['a": None, "a": None, "['x',]": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", first_item(F.col("s")).alias("f"))
    assert {r.s: r.f for r in df.collect()} == cases
    lists = spark.createDataFrame([("['7.G.B.6-2', 'b']",)], "s string")
    row = lists.select(
        contains_item(F.col("s"), F.lit("7.G.B.6")).alias("part"), contains_item(F.col("s"), F.lit("b")).alias("whole"),
        parse_list(F.col("s")).alias("all")).first()
    assert (row.part, row.whole, row["all"]) == (False, True, ["7.G.B.6-2", "b"])


def test_two_decimals_round_like_python(spark):
    rng = random.Random(5)
    values = [i / 200 for i in range(201)] + [i / 1000 for i in range(1001)] + [rng.random() for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows if r.t != f"{r.v:.2f}"] == []


def test_small_scalars(spark):
    row = spark.createDataFrame([("10-20", -3)], "b string, d int").select(
        with_percent(F.col("b")).alias("b"), with_percent(F.lit("20-30%")).alias("c"),
        with_percent(F.lit(None).cast("string")).alias("n"),
        day_to_timestamp(F.col("d")).cast("string").alias("t")).first()
    assert (row.b, row.c, row.n, row.t) == ("10-20%", "20-30%", None, "2019-12-29 00:00:00")


def test_buckets_are_fixed(spark):
    import hashlib

    rows = spark.range(50).select("id", bucket_of(F.col("id"), 42).alias("b")).collect()
    for r in rows:
        assert r.b == int(hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:8], 16) % 10_000


def test_ordinal_over_many_partitions(spark):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 2_000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = {r.v: r.ordinal for r in global_ordinal(df, order_by=["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_surrogate_keys_of_copies(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3, "v string").repartition(5)
    rows = with_surrogate_key(df, ["v"]).collect()
    assert sorted(r.id for r in rows) == list(range(1, 54))
    assert {r.id for r in rows if r.v == "b"} == {51, 52, 53}


def test_exact_medians(spark):
    rng = random.Random(2)
    rows = [(rng.random() if rng.random() > 0.1 else None, rng.randint(0, 9), None) for _ in range(1001)]
    got = exact_medians(spark.createDataFrame(rows, "a double, b long, c double"), ["a", "b", "c"])
    import statistics

    assert got["a"] == statistics.median([r[0] for r in rows if r[0] is not None])
    assert got["b"] == statistics.median([r[1] for r in rows]) and got["c"] == 0.0


def test_content_duplicates_keep_the_lowest_id(spark):
    df = spark.createDataFrame([(4, "x", None), (2, "x", None), (3, "y", 1), (1, "y", 2)], "id long, a string, b long")
    assert sorted(r.id for r in drop_content_duplicates(df, id_col="id").collect()) == [1, 2, 3]


def test_eligibility_keeps_null(spark):
    df = spark.createDataFrame([(1, None), (2, 30), (3, 31)], "id long, date_unregistration long")
    assert sorted(r.id for r in eligible_at(df, cutoff_day=30).collect()) == [1, 3]


def test_click_interactions(spark):
    df = spark.createDataFrame([("m", "p", 1, 9, 2, 5)],
                               "code_module string, code_presentation string, id_student long, id_site long, date long, sum_click long")
    row = interactions_from_clicks(df).first()
    assert (row.type, row.topic_id, row.outcome, row.metadata) == ("resource_view", None, None, {"id_site": "9", "sum_click": "5"})


def test_surrogate_keys_do_not_depend_on_the_order_of_the_rows(spark):
    rows = [(i % 3, f"p{i % 17}") for i in range(400)]

    def keys(data, parts):
        df = spark.createDataFrame(data, "v long, payload string").repartition(parts)
        return sorted((r.id, r.v, r.payload) for r in with_surrogate_key(df, ["v"]).collect())

    first = keys(rows, 3)
    assert [k for k, *_ in first] == list(range(1, 401)) and first == keys(rows[::-1], 7)
