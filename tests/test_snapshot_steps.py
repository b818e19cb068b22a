"""The steps that the course snapshots spend their time on."""

from __future__ import annotations

import random

from edupulse.operators.aggregates import ENROLLMENT, click_stats
from edupulse.plans import driver_tables as v
from edupulse.plans import model_queries as m

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_click_stats_needs_no_sorted_aggregate(spark):
    rng = random.Random(3)
    rows = [("m", "p", rng.randrange(3), rng.choice([None, *range(9)]), rng.randrange(-300, 40), rng.choice([None, 1, 2, 5])) for _ in range(3000)]
    rows.append(("m", "p", 7, None, 3, None))
    clicks = spark.createDataFrame(rows, "code_module string, code_presentation string, id_student long, id_site long, date long, sum_click long")
    stats = click_stats(clicks, cutoff_day=30)
    assert "ObjectHashAggregate" not in _plan(stats) and "SortAggregate" not in _plan(stats)
    want = {}
    for student in {r[2] for r in rows}:
        known = [r for r in rows if r[2] == student and r[4] <= 30]
        clicked = [r[5] for r in known if r[5] is not None]
        want["m", "p", student] = (sum(clicked) if clicked else None, len({r[4] for r in known}), len({r[3] for r in known} - {None}), max(r[4] for r in known))
    names = ("vle_total_clicks", "vle_active_days", "vle_distinct_sites", "vle_last_active_day")
    assert {tuple(r[k] for k in ENROLLMENT): tuple(r[n] for n in names) for r in stats.collect()} == want


def test_line_items_meet_their_orders_without_a_sort(spark):
    assert "ShuffledHashJoin" in _plan(v._lines(spark, SF)[0])


def test_the_split_reads_a_written_snapshot(spark, monkeypatch):
    made = []
    monkeypatch.setattr(m, "materialize", lambda df: made.append(df) or df)
    snapshot = spark.range(40).selectExpr("id", "id % 2 AS y")
    assert m._split_snapshot(snapshot, "y", "id").count() == 40
    assert made == [snapshot]
