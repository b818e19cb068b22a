from __future__ import annotations

from datetime import timedelta

import pytest
from helpers import START

from edupulse.operators import attempts as att
from edupulse.operators import decision as d
from edupulse.operators import recommend, summaries

STATE = "student_id long, topic_id string, mastery double, observation_count long, updated_at timestamp"
PRIORITY_IN = "class_id long, topic_id string, average_mastery double, observation_count long"
SKILL = "topic_id string, problem_id long, mean_correct double, mean_time_on_task double, student_answer_count long"


def day(n, hour=0):
    return START + timedelta(days=n, hours=hour)


def interactions(spark, days, student=1):
    rows = [(student, day(n, h), "resource_view", None, None) for n, count in enumerate(days) for h in range(count)]
    return spark.createDataFrame(rows, "student_id long, ts timestamp, type string, topic_id string, outcome boolean")


def results(spark, scores, student=1):
    rows = [(student, i, float(s), day(i)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows[::-1], "student_id long, assessment_id long, score double, submitted_at timestamp")


@pytest.mark.parametrize(("days", "trend"), [
    ([1], None), ([1, 1, 1], None), ([1, 5, 5, 5], "increasing"), ([9, 1, 1, 1], "decreasing"),
    ([2, 3, 3, 3], "stable"), ([3, 3, 3, 3], "stable")])
def test_engagement_trend(spark, days, trend):
    row = summaries.student_engagement(interactions(spark, days)).first()
    assert (row.trend, row.active_days, row.total_interactions) == (trend, len(days), sum(days))


def test_engagement_counts(spark):
    rows = [(1, day(0), "resource_view", None, None), (1, day(0, 1), "problem_attempt", "a", True),
            (1, day(1), "problem_attempt", "a", False), (1, day(2), "problem_attempt", None, None)]
    df = spark.createDataFrame(rows, "student_id long, ts timestamp, type string, topic_id string, outcome boolean")
    r = summaries.student_engagement(df).first()
    assert (r.total_interactions, r.resource_interaction_days, r.problem_attempts, r.correct_attempts,
            r.incorrect_attempts, r.active_days) == (4, 1, 3, 1, 1, 3)
    assert r.last_interaction_at == day(2)


@pytest.mark.parametrize(("scores", "trend", "recent"), [
    ([50], None, 50), ([50, 60, 70], None, 60), ([50, 60, 70, 80], "improving", 70), ([90, 60, 60, 60], "declining", 60),
    ([60, 61, 61, 61], "stable", 61), ([60, 60, 60, 60], "stable", 60)])
def test_assessment_trend(spark, scores, trend, recent):
    row = summaries.student_assessment(results(spark, scores)).first()
    assert (row.trend, row.total_results) == (trend, len(scores))
    assert row.recent_average_score == pytest.approx(recent)
    assert row.average_score == pytest.approx(sum(scores) / len(scores))


def test_mean_of_means(spark):
    df = results(spark, [100, 100, 100, 100], 1).unionByName(results(spark, [50], 2))
    rosters = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "class_id long, student_id long")
    row = summaries.class_assessment(summaries.student_assessment(df), rosters).first()
    assert (row.students_with_results, row.average_score) == (2, 75.0)


def test_class_mastery_and_totals(spark):
    states = spark.createDataFrame(
        [(1, "a", 0.2, 5, day(0)), (2, "a", 0.6, 1, day(3)), (2, "b", 0.9, 2, day(1))], STATE)
    rosters = spark.createDataFrame([(7, 1), (7, 2), (8, 2)], "class_id long, student_id long")
    got = {(r.class_id, r.topic_id): (round(r.average_mastery, 9), r.observation_count)
           for r in summaries.class_mastery(states, rosters).collect()}
    assert got == {(7, "a"): (0.4, 6), (7, "b"): (0.9, 2), (8, "a"): (0.6, 1), (8, "b"): (0.9, 2)}
    totals = {r.student_id: (r.total_observations, r.as_of) for r in summaries.student_state_totals(states).collect()}
    assert totals == {1: (5, day(0)), 2: (3, day(3))}
    as_of = summaries.class_as_of(summaries.student_state_totals(states), rosters, spark.createDataFrame(
        [(8, day(9))], "class_id long, recorded_at timestamp")).collect()
    assert {r.class_id: r.as_of for r in as_of} == {7: day(3), 8: day(9)}


def test_environment_takes_the_latest_battery(spark):
    rows = [("s", day(2), 20.0, 40.0, 500, 0.0), ("s", day(1), 22.0, 60.0, 700, 90.0)]
    df = spark.createDataFrame(rows, "sensor_id string, recorded_at timestamp, temperature_c double, humidity_pct double, co2_ppm long, battery_pct double")
    r = summaries.environment_summary(df).first()
    assert (r.reading_count, r.average_temperature_c, r.average_co2_ppm, r.latest_battery_pct, r.last_recorded_at) == (2, 21.0, 600.0, 0.0, day(2))


def test_roster_cap(spark):
    rosters = spark.createDataFrame([(1, s) for s in range(20)] + [(2, 5)], "class_id long, student_id long")
    used = att.cap_roster(rosters, cap=15)
    assert sorted(r.student_id for r in used.where("class_id = 1").collect()) == list(range(15))
    counts = {r.class_id: (r.students_used, r.students_eligible, r.roster_capped) for r in att.roster_counts(rosters, cap=15).collect()}
    assert counts == {1: (15, 20, True), 2: (1, 1, False)}


def test_no_cap_by_default(spark):
    rosters = spark.createDataFrame([(1, s) for s in range(40)], "class_id long, student_id long")
    assert att.cap_roster(rosters).count() == 40
    assert tuple(att.roster_counts(rosters).first()) == (1, 40, 40, False)
    states = spark.createDataFrame([(s, "a", 1.0 if s >= 15 else 0.0, 2, None) for s in range(40)], "student_id long, topic_id string, mastery double, observation_count long, updated_at timestamp")
    classes, mastery = summaries.class_state(rosters, states)
    assert (classes.first().students_used, classes.first().roster_capped) == (40, False) and mastery.first().average_mastery == 25 / 40


def test_attempt_facts(spark):
    logs = spark.createDataFrame(
        [(1, 10, 100, day(0), True), (2, 10, 101, day(1), False), (3, 10, 102, day(2), True), (4, 11, 100, day(0), None)],
        "id long, log_id long, problem_id long, start_time timestamp, correct boolean")
    assignment_logs = spark.createDataFrame([(10, 7), (11, 8)], "log_id long, student_id long")
    problems = spark.createDataFrame([(100, "['a', 'b']"), (101, None), (102, "[]")], "problem_id long, skills string")
    rows = att.attempts(logs, assignment_logs, problems).collect()
    assert [(r.student_id, r.topic_id, r.event_id, r.correct) for r in rows] == [(7, "a", 1, True)]


def test_priority_order(spark):
    df = spark.createDataFrame([
        (1, "strong", 0.9, 9), (1, "weak", 0.1, 3), (1, "tie_few", 0.5, 4), (1, "tie_many", 0.5, 8), (1, "thin", 0.0, 2)], PRIORITY_IN)
    rows = recommend.skill_priority(df).orderBy("priority_rank").collect()
    assert [r.topic_id for r in rows] == ["weak", "tie_many", "tie_few", "strong"]
    assert rows[0].priority_score == pytest.approx(0.9)


def test_topk_and_recommendation(spark):
    catalog = spark.createDataFrame([
        ("a", 1, 0.64, None, 50), ("a", 2, 0.66, None, 50), ("a", 3, 0.9, None, 50), ("a", 4, 0.1, None, 50), ("a", 5, 0.65, None, 19)], SKILL)
    top = recommend.problem_topk(catalog)
    assert [r.problem_id for r in top.orderBy("problem_rank").collect()] == [1, 2, 3]
    priorities = recommend.skill_priority(spark.createDataFrame([(1, "a", 0.2, 9), (2, "b", 0.2, 9), (3, "c", 0.2, 1)], PRIORITY_IN))
    rows = {r.class_id: [p.problem_id for p in r.problems] for r in recommend.class_recommendation(priorities, top).collect()}
    assert rows == {1: [1, 2, 3], 2: []}


def decide(spark, context=None):
    classes = spark.createDataFrame(
        [(1, 15, 20, True, 2), (2, 3, 3, False, 1), (3, 1, 1, False, 1), (4, 2, 2, False, 1)],
        "class_id long, students_used long, students_eligible long, roster_capped boolean, topics_observed long")
    priorities = recommend.skill_priority(spark.createDataFrame(
        [(1, "a", 0.25, 9), (2, "b", 0.625, 4), (4, "a", 0.5, 3)], PRIORITY_IN))
    top = recommend.problem_topk(spark.createDataFrame([("a", 11, 0.625, None, 50)], SKILL))
    offered = recommend.class_recommendation(priorities, top).where("class_id <> 4")
    return {r.class_id: r for r in d.decision_support(classes, priorities, offered, context=context).collect()}


def test_decision_branches(spark):
    rows = decide(spark)
    full, no_problem, no_skill, no_resource = rows[1], rows[2], rows[3], rows[4]
    assert full.summary == "Classroom 1 (assistments): 15 of 20 eligible students included, 2 topics observed."
    assert no_problem.summary == "Classroom 2 (assistments): all 3 eligible students included, 1 topics observed."
    assert full.priority_skill == "a" and [p.problem_id for p in full.recommended_resources] == [11]
    assert full.evidence == [
        "'a': average_mastery=0.25, priority_score=0.75, observation_count=9.",
        "Problem 11: historical mean_correct=0.62 over 50 recorded answers (target success rate ~0.65)."]
    assert len(full.limitations) == 3 and full.limitations[0] == d.NON_CAUSAL
    assert full.suggested_action.startswith("Consider reviewing the listed problems for 'a'")
    assert "(this topic has 9), based on the 15 students included" in full.rationale
    assert no_problem.recommended_resources == [] and "at least" not in no_problem.evidence[0]
    assert no_problem.evidence[1].startswith("No catalog problem tagged 'b' had at least 20 recorded answers")
    assert no_problem.suggested_action.startswith("Consider reviewing the ASSISTments catalog for 'b' directly")
    assert no_skill.priority_skill is None and no_skill.evidence == [d.NO_SKILL_EVIDENCE]
    assert no_skill.rationale.startswith("No topic in this classroom has at least 3 pooled observations")
    assert no_skill.limitations == [d.NON_CAUSAL] and no_skill.suggested_action == d.NO_SKILL_ACTION
    assert no_resource.evidence[1] == "No resource recommendation is currently available for 'a'."
    assert all(r.context_note is None for r in rows.values())


def test_wording_is_not_causal(spark):
    for row in decide(spark).values():
        for text in [row.summary, row.rationale, row.suggested_action, *row.evidence]:
            assert not any(word in text.lower() for word in ("improves", "causes", "will increase", "proven"))


def signals(spark):
    mapping = spark.createDataFrame(
        [("assistments", 1, "CO2_01", 5), ("assistments", 2, None, 6), ("assistments", 3, "CO2_09", None)],
        "source_dataset string, class_id long, sensor_id string, record_id long")
    readings = spark.createDataFrame(
        [("CO2_01", day(0), 1.0, 2.0, 400), ("CO2_01", day(2), 21.5, 40.0, 500)],
        "sensor_id string, recorded_at timestamp, temperature_c double, humidity_pct double, co2_ppm long")
    records = spark.createDataFrame([(5, 1, 2, 3, 4)], "record_id long, raised_hands long, visited_resources long, announcements_view long, discussion long")
    predictions = spark.createDataFrame([(5, 0.75)], "record_id long, prob double")
    return d.context_signals(d.context_rows(mapping, readings, records, predictions))


def test_context_signals_change_nothing_else(spark):
    rows = signals(spark)
    got = {(r.class_id, r.metric_name): (r.value, r.as_of) for r in rows.collect()}
    assert got == {
        (1, "co2_ppm"): (500.0, day(2)), (1, "temperature_c"): (21.5, day(2)), (1, "humidity_pct"): (40.0, day(2)),
        (1, "raised_hands"): (1.0, None), (1, "visited_resources"): (2.0, None), (1, "announcements_view"): (3.0, None),
        (1, "discussion"): (4.0, None), (1, "predicted_absence_risk"): (0.75, None)}
    assert not {"student_id", "identity"} & set(rows.columns)
    text = {r.metric_name: r.scope_description for r in rows.collect()}
    assert "sensor_id='CO2_01'" in text["co2_ppm"]
    assert "xapi_record_id=5 (explicitly configured for assistments class_id=1)" in text["discussion"]
    plain, with_context = decide(spark), decide(spark, rows)
    assert with_context[1].context_note == d.CONTEXT_NOTE and with_context[2].context_note is None
    assert len(with_context[1].context_signals) == 8
    for class_id, row in plain.items():
        for name in ("summary", "rationale", "evidence", "recommended_resources", "limitations", "suggested_action"):
            assert row[name] == with_context[class_id][name]


def test_missing_context(spark):
    ids = spark.createDataFrame([(1,), (2,)], "class_id long")
    rows = d.missing_context(ids, signals(spark)).collect()
    assert sorted((r.class_id, r.unavailable) for r in rows) == sorted(
        [(1, d.ALWAYS_UNAVAILABLE), (2, d.ALWAYS_UNAVAILABLE), *[(2, v) for v in d.CONTEXT_CATEGORIES.values()]])


def test_attach_latest_replaces(spark):
    base = spark.createDataFrame([(1,), (2,)], "k long")
    updates = spark.createDataFrame([(1, 0.2, 1), (1, 0.9, 2)], "k long, prob double, version long")
    rows = summaries.attach_latest(base, updates, keys=["k"], order_by=["version"]).orderBy("k").collect()
    assert [(r.k, r.prob) for r in rows] == [(1, 0.9), (2, None)]


def test_problem_catalogue_uses_whole_items(spark):
    df = spark.createDataFrame(
        [(1, "['a', 'b', 'a']", 0.5, 1.0, 30), (2, None, 0.5, 1.0, 30), (3, "['a-2']", 0.5, 1.0, 30), (4, "['a']", None, 1.0, 30)],
        "problem_id long, skills string, mean_correct double, mean_time_on_task double, student_answer_count long")
    rows = att.problems_by_skill(df).collect()
    assert sorted((r.topic_id, r.problem_id) for r in rows) == [("a", 1), ("a-2", 3), ("b", 1)]


def test_latest_reading_needs_no_sort(spark):
    """Extreme, null and negative times and tie-breaks keep the order of (time, tie-break); the aggregate hashes."""
    from datetime import datetime

    from edupulse.operators.summaries import environment_summary

    big, low = 2**63 - 1, -(2**63)
    times = [datetime(2020, 1, 1), datetime(1950, 5, 5), datetime(9999, 12, 31), datetime(1, 1, 2), None]
    rows = [(s, t, e, 20.0, 40.0, 500.0, float(100 * i + j))
            for s, chosen in enumerate([times, times[1:2], times[3:], times[4:]])
            for i, t in enumerate(chosen) for j, e in enumerate([5, big, low, -7])]
    df = spark.createDataFrame(
        rows, "sensor_id long, recorded_at timestamp, event_id long, temperature_c double, humidity_pct double, co2_ppm double, battery_pct double")
    summary = environment_summary(df, tie_break=["event_id"])
    got = {r.sensor_id: r.latest_battery_pct for r in summary.collect()}
    want = {}
    for s, t, e, *_, battery in rows:
        want[s] = max(want.get(s, (datetime.min, low - 1, 0.0)), (t or datetime.min, e, battery))
    assert got == {s: w[2] for s, w in want.items()}
    assert "SortAggregate" not in summary._jdf.queryExecution().executedPlan().toString()
