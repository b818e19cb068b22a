"""SQL for the cross-check of ``queries``: the same results over the same tables."""

from __future__ import annotations

from edupulse.models import bootstrap
from edupulse.operators import decision as t
from edupulse.operators.mastery import DEFAULT_BKT, INITIAL_BKT
from edupulse.plans.oracle_views import VIEW_SQL, with_views
from edupulse.plans.parameters import CANDIDATE_BKT

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(template: str, *values: str) -> str:
    """SQL concatenation of a numbered template."""
    parts, rest = [], template
    for i, value in enumerate(values):
        head, rest = rest.split("{%d}" % i, 1)
        parts += [_q(head), f"({value})::VARCHAR"]
    return "(" + " || ".join([*parts, _q(rest)]) + ")"


def _metrics(source: str, label: str, prob: str) -> str:
    """K6 as SQL; the AUC is the rank-sum statistic with average ranks."""
    return f"""
    SELECT count(*) AS n_predictions,
           round(avg(CASE WHEN y = 1 THEN -ln(c) ELSE -ln(1 - c) END), 6) AS log_loss,
           round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy,
           round(avg((y - p) * (y - p)), 6) AS brier_score, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
           round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
                 (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) END, 6) AS auc
    FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r
          FROM (SELECT ({label})::INT AS y, ({prob})::DOUBLE AS p,
                       least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, ({prob})::DOUBLE)) AS c FROM {source}))"""


def _report(source: str, where: str = "TRUE", extra: str = "") -> str:
    return f"""
    SELECT 0.5::DOUBLE AS threshold, round((tp + tn) / (pos + neg)::DOUBLE, 6) AS accuracy,
           round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
           round(coalesce(tp / nullif(pos, 0)::DOUBLE, 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, auc,
           pos AS positives, neg AS negatives, tp, fp, tn, fn{extra}
    FROM (SELECT sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg,
                 count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp,
                 count(*) FILTER (label = 0 AND prob < 0.5) AS tn, count(*) FILTER (label = 1 AND prob < 0.5) AS fn,
                 round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
                       / (sum(label)::DOUBLE * sum(1 - label)), 6) AS auc
          FROM (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS r
                FROM {source} WHERE {where}))"""


def _bucket(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR), 1, 8))::BIGINT % 10000)"


_SPLIT = f"""CASE WHEN {_bucket('student_id')} < 6400 THEN 'train_fit'
                  WHEN {_bucket('student_id')} < 8000 THEN 'val' ELSE 'test' END"""


def _snapshot(where: str, label: str, types: str) -> str:
    return f"""
    SELECT e.code_module, e.code_presentation, e.id_student, gender, highest_education,
           CASE WHEN imd_band NOT LIKE '%\\%' ESCAPE '\\' THEN imd_band || '%' ELSE imd_band END AS imd_band, age_band,
           num_of_prev_attempts, studied_credits, disability, date_registration,
           coalesce(submitted, 0) AS assessments_submitted_count, round(mean_score, 6) AS assessments_mean_score,
           coalesce(due, 0) AS assessments_due_count,
           round(coalesce(submitted, 0) / nullif(due, 0)::DOUBLE, 6) AS assessments_submission_rate,
           coalesce(total, 0)::BIGINT AS vle_total_clicks, coalesce(days, 0) AS vle_active_days,
           coalesce(sites, 0) AS vle_distinct_sites, 30 - last_day AS vle_days_since_last_click, {label}
    FROM enrollments e
    LEFT JOIN (SELECT code_module, code_presentation, count(*) AS due FROM assessments
               WHERE date <= 30 AND {types} GROUP BY 1, 2) d USING (code_module, code_presentation)
    LEFT JOIN (SELECT id_student, code_module, code_presentation, count(*) AS submitted, avg(score) AS mean_score
               FROM submissions JOIN assessments USING (id_assessment)
               WHERE date_submitted <= 30 AND NOT is_banked AND {types} GROUP BY 1, 2, 3) s
           USING (id_student, code_module, code_presentation)
    LEFT JOIN (SELECT id_student, code_module, code_presentation, sum(sum_click) AS total, count(DISTINCT date) AS days,
                      count(DISTINCT id_site) AS sites, max(date) AS last_day FROM clicks WHERE date <= 30 GROUP BY 1, 2, 3) c
           USING (id_student, code_module, code_presentation)
    WHERE {where}"""


def _dq(check: str, table: str, bad: str, rows: str, source: str) -> str:
    return f"""SELECT '{check}' AS "check", '{table}' AS "table", coalesce({bad}, 0)::BIGINT AS n_bad,
               coalesce({rows}, 0)::BIGINT AS n_rows FROM {source}"""


_PROBLEM_LINE = _fill(
    t.PROBLEM_EVIDENCE, "problem_id", "printf('%.2f', mean_correct)", "student_answer_count", "'0.65'")
_DECISION = f"""
    SELECT c.class_id,
           {_fill(t.SUMMARY, "c.class_id", "'assistments'",
                  "CASE WHEN roster_capped THEN " + _fill(t.ROSTER_CAPPED, "students_used", "students_eligible")
                  + " ELSE " + _fill(t.ROSTER_ALL, "students_used") + " END", "coalesce(observed, 0)")} AS summary,
           p.topic_id AS priority_skill,
           CASE WHEN p.topic_id IS NULL THEN {_q(t.NO_SKILL_RATIONALE.format(3))} ELSE
             {_fill(t.RATIONALE, "p.topic_id", "printf('%.2f', average_mastery)", "'3'", "observation_count",
                    "students_used")} END AS rationale,
           coalesce(k.ids, '') AS problems,
           CASE WHEN p.topic_id IS NULL THEN {_q(t.NO_SKILL_EVIDENCE)} ELSE
             {_fill(t.SKILL_EVIDENCE, "p.topic_id", "printf('%.2f', average_mastery)",
                    "printf('%.2f', priority_score)", "observation_count")}
             || '|' || coalesce(k.lines, {_fill(t.NO_PROBLEM_EVIDENCE, "p.topic_id", "'20'")}) END AS evidence,
           {_q(t.NON_CAUSAL)}
             || CASE WHEN roster_capped THEN '|' || {_fill(t.CAP_LIMITATION, "students_used", "students_eligible")} ELSE '' END
             || CASE WHEN p.topic_id IS NOT NULL THEN '|' || {_q(t.RANKING_LIMITATION)} ELSE '' END AS limitations,
           CASE WHEN p.topic_id IS NULL THEN {_q(t.NO_SKILL_ACTION)}
                WHEN k.ids IS NOT NULL THEN {_fill(t.PROBLEM_ACTION, "p.topic_id")}
                ELSE {_fill(t.CATALOG_ACTION, "p.topic_id")} END AS suggested_action
    FROM class_counts c
    LEFT JOIN (SELECT * FROM priorities WHERE priority_rank = 1) p USING (class_id)
    LEFT JOIN (SELECT class_id, count(*) AS observed FROM mastery_by_class GROUP BY 1) o USING (class_id)
    LEFT JOIN (SELECT topic_id, string_agg(problem_id::VARCHAR, ',' ORDER BY problem_rank) AS ids,
                      string_agg({_PROBLEM_LINE}, '|' ORDER BY problem_rank) AS lines FROM topk GROUP BY 1) k
           ON k.topic_id = p.topic_id"""

_RECORD_SCOPE = _fill(t.RECORD_SCOPE, "record_id", "source_dataset", "class_id")


def _signal(dataset: str, scope: str, metric: str, as_of: str, where: str) -> str:
    return f"""SELECT class_id, '{dataset}' AS source_dataset, {scope} AS scope_description, '{metric}' AS metric_name,
               round({metric}::DOUBLE, 6) AS value, {as_of} AS as_of FROM context WHERE {where}"""


_SIGNALS = "\nUNION ALL\n".join(
    [_signal(t.SENSOR_DATASET, _fill(t.SENSOR_SCOPE, "sensor_id"), m, f"strftime(recorded_at, {TS})",
             "recorded_at IS NOT NULL") for m in t.SENSOR_METRICS]
    + [_signal(t.RECORD_DATASET, _fill(t.COHORT_SCOPE, _RECORD_SCOPE), m, "NULL", "has_record") for m in t.RECORD_METRICS]
    + [_signal(t.RECORD_DATASET, _fill(t.RISK_SCOPE, _RECORD_SCOPE), t.RISK_METRIC, "NULL", "has_record")])

_CONTENT = ("stage_id, grade_id, section_id, topic, semester, parent_answering_survey, parent_school_satisfaction, "
            "raised_hands, visited_resources, announcements_view, discussion, student_absence_days")

_EMA = """SELECT student_id, topic_id, round(list_reduce(
             list_transform(outcomes, lambda x: x::INT::DOUBLE), lambda m, x: m + 0.3 * (x - m), 0.5::DOUBLE), 6) AS mastery,
             n AS observation_count, strftime(last, {ts}) AS updated_at FROM chains""".format(ts=TS)

_STRATA = f"""
    SELECT id_student, is_dropout::BIGINT AS is_dropout,
           CASE WHEN k < floor(round(n * 0.6, 6)) THEN 'train' WHEN k < floor(round(n * 0.8, 6)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY is_dropout ORDER BY h, id_student) - 1 AS k,
                 count(*) OVER (PARTITION BY is_dropout) AS n
          FROM (SELECT id_student, (final_result = 'Withdrawn')::INT AS is_dropout, {_bucket('id_student')} AS h
                FROM enrollments))"""

_SWEEP = """
    SELECT threshold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1, eligible, eligible AND threshold = min(CASE WHEN eligible AND recall = best THEN threshold END)
           OVER () AS selected
    FROM (SELECT *, max(CASE WHEN eligible THEN recall END) OVER () AS best
          FROM (SELECT m.*, m.recall > b.recall AND m.precision >= b.precision * (1 - 0.10::DOUBLE)
                       AND m.f1 >= b.f1 * (1 - 0.10::DOUBLE) AS eligible
                FROM {m} m, (SELECT * FROM {m} WHERE threshold = 0.5) b))"""
_SWEEP_RATES = """(
    SELECT t AS threshold, (tp + n - fp) / (p + n)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
           coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS recall,
           coalesce(2 * tp / nullif(2 * tp + fp + (p - tp), 0)::DOUBLE, 0) AS f1
    FROM (SELECT t, count(*) FILTER (label = 1 AND prob >= t) AS tp, count(*) FILTER (label = 0 AND prob >= t) AS fp,
                 sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n
          FROM scored_lines, (SELECT round(0.2 + 0.01 * i, 2)::DOUBLE AS t FROM range(31) r(i)) GROUP BY t))"""

_EVENT_KEYS = "(SELECT user_id AS k, count(*) AS n, user_id NOT IN (SELECT s_suppkey FROM supplier) AS orphan FROM events GROUP BY 1)"

BODIES: dict[str, str] = {
    "bkt_mastery": f"""SELECT student_id, topic_id, round(mastery, 6) AS mastery, observation_count,
                       strftime(updated_at, {TS}) AS updated_at FROM states""",
    "ema_mastery": _EMA,
    "bkt_trajectory": """SELECT event_id, student_id, topic_id, correct, round(mastery_before, 6) AS mastery_before,
                         round(prob, 6) AS predicted FROM predictions""",
    "bkt_metrics": _metrics("predictions", "correct", "prob"),
    "constant_baseline_metrics": _metrics("attempts", "correct", "0.6"),
    "persistence_baseline_metrics": _metrics(
        "(SELECT correct, coalesce(lag(correct::INT::DOUBLE) OVER (PARTITION BY student_id, topic_id ORDER BY ts, event_id), 0.5::DOUBLE)"
        " AS prev FROM attempts)", "correct", "prev"),
    "skill_difficulty": "SELECT topic_id, round(avg(correct::INT), 6) AS skill_train_difficulty FROM attempts GROUP BY 1",
    "correct_rate": "SELECT round(avg(correct::INT), 6) AS correct_rate FROM attempts",
    "prediction_counts": """SELECT count(*) AS n_predictions, count(DISTINCT (student_id, topic_id)) AS n_sequences,
                            count(DISTINCT student_id) AS n_students, count(DISTINCT topic_id) AS n_skills FROM attempts""",
    "kt_features": f"""
        SELECT student_id, topic_id, event_id, correct, total AS student_total_attempts_before,
               round(ok / nullif(total, 0)::DOUBLE, 6) AS student_total_correct_rate_before,
               sk AS student_skill_attempts_before, round(sk_ok / nullif(sk, 0)::DOUBLE, 6) AS student_skill_correct_rate_before,
               total - lag(total) OVER (PARTITION BY student_id, topic_id ORDER BY ts, event_id) AS attempts_since_last_seen_skill,
               round(coalesce(dif, 0.5), 6) AS skill_train_difficulty, round(mastery_before, 6) AS bkt_mastery_before,
               total > 0 AS has_prior_student_attempt, sk > 0 AS has_prior_skill_attempt
        FROM (SELECT *, count(*) OVER s AS total, coalesce(sum(correct::INT) OVER s, 0)::BIGINT AS ok,
                     count(*) OVER k AS sk, coalesce(sum(correct::INT) OVER k, 0)::BIGINT AS sk_ok
              FROM trajectory
              WINDOW s AS (PARTITION BY student_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     k AS (PARTITION BY student_id, topic_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        LEFT JOIN (SELECT topic_id, avg(correct::INT) AS dif FROM attempts WHERE {_SPLIT} = 'train_fit' GROUP BY 1) USING (topic_id)""",
    "dropout_snapshot": _snapshot(
        "date_unregistration IS NULL OR date_unregistration > 30",
        "CASE WHEN final_result = 'Withdrawn' THEN 1 ELSE 0 END::BIGINT AS is_dropout", "TRUE"),
    "performance_snapshot": _snapshot(
        "final_result IN ('Pass', 'Fail', 'Distinction')",
        "CASE WHEN final_result IN ('Pass', 'Distinction') THEN 1 ELSE 0 END::BIGINT AS is_pass",
        "assessment_type IN ('TMA', 'CMA')"),
    "attendance_snapshot": """
        SELECT school_id, attendance_date::VARCHAR AS attendance_date, school_year,
               dayofweek(attendance_date) AS day_of_week, month(attendance_date) AS month,
               round(lag1, 6) AS absence_rate_lag1, round(m, 6) AS absence_rate_rolling_mean,
               round(s, 6) AS absence_rate_rolling_std, CASE WHEN rate > 0.3 THEN 1 ELSE 0 END::BIGINT AS is_high_absence_day
        FROM (SELECT *, lag(rate) OVER w AS lag1, row_number() OVER w AS day_rank,
                     avg(rate) OVER b AS m, stddev_samp(rate) OVER b AS s
              FROM (SELECT *, absent / enrolled::DOUBLE AS rate FROM attendance WHERE enrolled > 0)
              WINDOW w AS (PARTITION BY school_id ORDER BY attendance_date),
                     b AS (PARTITION BY school_id ORDER BY attendance_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        WHERE day_rank > 10""",
    "click_rollup": "SELECT * FROM clicks",
    "due_counts": """SELECT code_module, code_presentation, count(*) AS assessments_due_count FROM assessments
                     WHERE date <= 30 AND assessment_type IN ('TMA', 'CMA') GROUP BY 1, 2""",
    "enrollment_merge": """SELECT * REPLACE (CASE WHEN right(imd_band, 1) <> '%' THEN imd_band || '%' ELSE imd_band END AS imd_band)
                           FROM enrollments""",
    "room_readings": f"""SELECT source_file, strftime(recorded_at, {TS}) AS recorded_at, round(temperature_c, 6) AS temperature_c,
                         humidity_pct, round(co2_ppm, 6) AS co2_ppm, round(light_lux, 6) AS light_lux,
                         occupancy::BIGINT AS occupancy FROM room_readings""",
    "absence_snapshot_dedup": f"SELECT min(record_id) AS record_id, {_CONTENT} FROM absence_records GROUP BY ALL",
    "click_interactions": f"""SELECT id_student AS student_id, strftime(TIMESTAMP '2020-01-01' + to_days(date::INT), {TS}) AS ts,
                              'resource_view' AS type, id_site::VARCHAR AS id_site, sum_click::VARCHAR AS sum_click FROM clicks""",
    "submission_results": f"""SELECT id_student AS student_id, score,
                              strftime(TIMESTAMP '2020-01-01' + to_days(date_submitted::INT), {TS}) AS submitted_at,
                              code_module, code_presentation
                              FROM submissions JOIN assessments USING (id_assessment) WHERE NOT is_banked AND score IS NOT NULL""",
    "student_engagement": f"""SELECT * EXCLUDE (delta) REPLACE (strftime(last_interaction_at, {TS}) AS last_interaction_at)
                              FROM student_engagement""",
    "student_assessment": f"""SELECT student_id, total_results, round(average_score, 6) AS average_score,
                              round(recent_average_score, 6) AS recent_average_score, trend,
                              strftime(last_assessment_at, {TS}) AS last_assessment_at FROM student_assessment""",
    "student_state_totals": f"""SELECT student_id, sum(observation_count)::BIGINT AS total_observations, count(*) AS topics,
                                strftime(max(updated_at), {TS}) AS as_of FROM states GROUP BY 1""",
    "student_totals": f"""
        SELECT student_id, coalesce(sum(n), 0)::BIGINT AS total_observations, strftime(max(t), {TS}) AS as_of FROM (
            SELECT student_id, observation_count AS n, NULL::TIMESTAMP AS t FROM states
            UNION ALL SELECT student_id, 0, ts FROM interactions
            UNION ALL SELECT student_id, 0, submitted_at FROM assessment_results) GROUP BY 1""",
    "event_timeline": f"""
        SELECT student_id, strftime(ts, {TS}) AS ts, kind, source_id,
               row_number() OVER (PARTITION BY student_id ORDER BY ts, kind, source_id) - 1 AS position
        FROM (SELECT student_id, ts, 'interaction' AS kind, event_id::VARCHAR AS source_id FROM interactions
              UNION ALL SELECT student_id, submitted_at, 'result', assessment_id::VARCHAR FROM assessment_results)""",
    "class_roster": "SELECT class_id, student_id FROM capped",
    "class_roster_counts": "SELECT * FROM capped_counts",
    "class_mastery": """SELECT class_id, topic_id, round(average_mastery, 6) AS average_mastery, observation_count
                        FROM mastery_by_class""",
    "class_state": f"""
        SELECT c.*, coalesce(topics, 0) AS topics_observed, strftime(last, {TS}) AS as_of FROM class_counts c
        LEFT JOIN (SELECT class_id, count(DISTINCT topic_id) AS topics, max(updated_at) AS last
                   FROM rosters JOIN states USING (student_id) GROUP BY 1) USING (class_id)""",
    "class_engagement": """
        SELECT class_id, count(*) AS students_with_interactions, sum(total_interactions)::BIGINT AS total_interactions,
               sum(correct_attempts)::BIGINT AS total_correct_attempts, sum(incorrect_attempts)::BIGINT AS total_incorrect_attempts,
               round(avg(active_days), 6) AS average_active_days
        FROM rosters JOIN student_engagement USING (student_id) WHERE total_interactions > 0 GROUP BY 1""",
    "class_assessment": """
        SELECT class_id, count(*) AS students_with_results, round(avg(average_score), 6) AS average_score
        FROM student_classes JOIN student_assessment USING (student_id) WHERE average_score IS NOT NULL GROUP BY 1""",
    "class_environment": f"""
        SELECT sensor_id, count(*) AS reading_count, round(avg(temperature_c), 6) AS average_temperature_c,
               round(avg(humidity_pct), 6) AS average_humidity_pct, round(avg(co2_ppm), 6) AS average_co2_ppm,
               first(battery_pct ORDER BY recorded_at DESC, event_id DESC) AS latest_battery_pct,
               strftime(max(recorded_at), {TS}) AS last_recorded_at FROM sensor_readings GROUP BY 1""",
    "class_as_of": f"""SELECT class_id, strftime(max(ts), {TS}) AS as_of FROM rosters JOIN attempts USING (student_id) GROUP BY 1""",
    "skill_priority": """SELECT class_id, priority_rank, topic_id, round(average_mastery, 6) AS average_mastery,
                         round(priority_score, 6) AS priority_score, observation_count FROM priorities""",
    "problem_topk": """SELECT topic_id, problem_id, round(mean_correct, 6) AS mean_correct, round(mean_time_on_task, 6) AS
                       mean_time_on_task, student_answer_count, round(distance_from_target, 6) AS distance_from_target,
                       problem_rank FROM topk""",
    "class_recommendation": """
        SELECT class_id, p.topic_id, round(priority_score, 6) AS priority_score, round(average_mastery, 6) AS average_mastery,
               observation_count, coalesce(ids, '') AS problems
        FROM priorities p LEFT JOIN (SELECT topic_id, string_agg(problem_id::VARCHAR, ',' ORDER BY problem_rank) AS ids
                                     FROM topk GROUP BY 1) k ON k.topic_id = p.topic_id
        WHERE priority_rank = 1""",
    "decision_support": _DECISION,
    "context_signals": _SIGNALS,
    "missing_context": f"""
        SELECT class_id, label AS unavailable FROM (SELECT DISTINCT class_id FROM rosters),
             (VALUES {", ".join(f"({_q(k)}, {_q(v)})" for k, v in t.CONTEXT_CATEGORIES.items())}) c(source_dataset, label)
        WHERE (class_id, source_dataset) NOT IN (SELECT (class_id, source_dataset) FROM ({_SIGNALS}))
        UNION ALL SELECT DISTINCT class_id, {_q(t.ALWAYS_UNAVAILABLE)} FROM rosters""",
    "dq_unique": _dq("unique", "lineitem", "sum(n) FILTER (n > 1)", "sum(n)",
                     "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"),
    "dq_foreign_key": _dq("foreign_key", "events", "count(*) FILTER (orphan)", "count(*)", _EVENT_KEYS),
    "dq_foreign_key_rows": f"""SELECT 'foreign_key_rows' AS "check", 'events' AS "table",
        coalesce(sum(n) FILTER (orphan), 0)::BIGINT AS n_bad, sum(n)::BIGINT AS n_rows,
        count(*) FILTER (orphan) AS n_bad_keys FROM {_EVENT_KEYS}""",
    "dq_duplicates": _dq("duplicates", "lineitem", "sum(n) FILTER (n > 1)", "sum(n)",
                         "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)"),
    "dq_row_count": _dq("row_count", "enrollments", "abs((SELECT count(*) FROM customer) - count(*))", "count(*)", "enrollments"),
    "dq_allowed": _dq("allowed", "lineitem", "count(*) FILTER (l_returnflag NOT IN ('A', 'N') OR l_returnflag IS NULL)",
                      "count(*)", "lineitem"),
    "dq_range": _dq("range", "submissions", "count(*) FILTER (score < 5 OR score > 95)", "count(*)", "submissions"),
    "dq_nulls": _dq("nulls", "submissions", "count(*) FILTER (id_assessment IS NULL OR id_student IS NULL OR date_submitted IS NULL"
                    " OR score IS NULL OR is_banked IS NULL)", "count(*)", "submissions"),
    "dq_identity": _dq("identity", "attendance", "count(*) FILTER (enrolled <> present + absent + released)", "count(*)", "attendance"),
    "dq_unseen_values": "SELECT DISTINCT sensor_id FROM sensor_readings WHERE sensor_id NOT IN ('CO2_01', 'CO2_02', 'CO2_03')",
    "dq_two_hop": _dq(
        "two_hop", "submissions", "count(*) FILTER (e.id_student IS NULL)", "count(*)",
        "(SELECT DISTINCT code_module, code_presentation, id_student FROM submissions LEFT JOIN assessments USING (id_assessment)) s"
        " LEFT JOIN (SELECT DISTINCT code_module, code_presentation, id_student FROM enrollments) e"
        " ON s.code_module = e.code_module AND s.code_presentation = e.code_presentation AND s.id_student = e.id_student"),
    "dq_one_to_one": _dq(
        "one_to_one", "customer", "count(*) FILTER (l <> 1 OR r <> 1)", "count(*)",
        "(SELECT k, sum(l) AS l, sum(r) AS r FROM (SELECT c_custkey AS k, 1 AS l, 0 AS r FROM customer"
        " UNION ALL SELECT o_custkey, 0, 1 FROM orders) GROUP BY k)"),
    "transitions": """SELECT event_id, source_file, occupancy::BIGINT AS occupancy, coalesce(occupancy <> lag(occupancy) OVER
                      (PARTITION BY source_file ORDER BY recorded_at, event_id), FALSE) AS is_transition FROM room_readings""",
    "persistence_accuracy": """SELECT source_file, count(*) AS n, round(avg((prev = occupancy)::INT), 6) AS accuracy
        FROM (SELECT *, coalesce(lag(occupancy) OVER (PARTITION BY source_file ORDER BY recorded_at, event_id), occupancy) AS prev
              FROM room_readings) GROUP BY 1""",
    "chronological_split": """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY recorded_at, event_id) <= floor(count(*) OVER () * 0.8)
                              THEN 'train' ELSE 'test' END AS split FROM room_readings""",
    "stratified_split": _STRATA,
    "key_split": f"SELECT event_id, student_id, {_SPLIT} AS split FROM attempts",
    "surrogate_key": "SELECT event_id, row_number() OVER (ORDER BY student_id, ts, event_id) AS id FROM attempts",
    "upsert_latest": """SELECT k, round(arg_max(value, version), 6) AS value, max(version) AS version FROM (
        SELECT o_custkey AS k, o_totalprice AS value, o_orderkey AS version FROM orders
        UNION ALL SELECT user_id, value, event_id + 1000000000 FROM events) GROUP BY 1""",
    "delete_keys": "SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)",
    "confusion_matrix": "SELECT label::BIGINT AS label, (prob >= 0.5)::BIGINT AS prediction, count(*) AS n FROM scored_lines GROUP BY 1, 2",
    "classification_report": _report("scored_lines"),
    "transition_report": (
        _report("tr", extra=", 'all' AS rows") + " UNION ALL " + _report("tr", "is_transition", ", 'transition' AS rows")
    ).replace("FROM tr WHERE", """FROM (SELECT occupancy AS label, humidity_pct / 100 AS prob, coalesce(occupancy <> lag(occupancy)
        OVER (PARTITION BY source_file ORDER BY recorded_at, event_id), FALSE) AS is_transition FROM room_readings) WHERE"""),
    "threshold_sweep": _SWEEP.format(m=_SWEEP_RATES),
}

# The name-based uuid has no SQL function: sha1 over the namespace bytes and the name.
BODIES["twin_identity"] = """
    SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
           || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS identity
    FROM (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('assistments:' || c_custkey::VARCHAR)) AS h
          FROM customer)"""

# A finished stream holds what the batch query computes.
BODIES["stream_mastery"] = BODIES["stream_advance"] = BODIES["bkt_mastery"]
BODIES["stream_environment"] = BODIES["class_environment"]

def _em_step(name: str, p: tuple[float, float, float, float]) -> str:
    """Forward and backward passes over every chain, and the shares of their expected counts."""
    prior, t, slip, guess = p
    return f"""SELECT '{name}' AS step, round(avg(g1) FILTER (rn = 1), 6) AS prior, round(sum(moved) / sum(g0) FILTER (rn < n), 6) AS transit,
      round(sum(g1) FILTER (NOT correct) / sum(g1), 6) AS slip, round(sum(g0) FILTER (correct) / sum(g0), 6) AS guess
    FROM (
      WITH RECURSIVE steps AS (
        SELECT student_id AS s, topic_id AS k, rn, correct, count(*) OVER (PARTITION BY student_id, topic_id) AS n,
          CASE WHEN correct THEN {guess} ELSE 1 - {guess} END::DOUBLE AS e0, CASE WHEN correct THEN 1 - {slip} ELSE {slip} END::DOUBLE AS e1 FROM numbered),
      forward AS (
        SELECT s, k, rn, (1 - {prior}) * e0 / ((1 - {prior}) * e0 + {prior} * e1) AS f0, {prior} * e1 / ((1 - {prior}) * e0 + {prior} * e1) AS f1 FROM steps WHERE rn = 1
        UNION ALL
        SELECT x.s, x.k, x.rn, p0 * e0 / (p0 * e0 + p1 * e1), p1 * e1 / (p0 * e0 + p1 * e1)
        FROM (SELECT s, k, rn, f0 * (1 - {t}) AS p0, f1 + f0 * {t} AS p1 FROM forward) f JOIN steps x ON x.s = f.s AND x.k = f.k AND x.rn = f.rn + 1),
      backward AS (
        SELECT s, k, rn, e0, e1, 1::DOUBLE AS b0, 1::DOUBLE AS b1 FROM steps WHERE rn = n
        UNION ALL
        SELECT x.s, x.k, x.rn, x.e0, x.e1, u / greatest(u, w), w / greatest(u, w)
        FROM (SELECT s, k, rn, (1 - {t}) * e0 * b0 + {t} * e1 * b1 AS u, e1 * b1 AS w FROM backward) b JOIN steps x ON x.s = b.s AND x.k = b.k AND x.rn = b.rn - 1)
      SELECT f.rn, x.n, x.correct, f0 * b.b0 / (f0 * b.b0 + f1 * b.b1) AS g0, f1 * b.b1 / (f0 * b.b0 + f1 * b.b1) AS g1,
        f0 * {t} * a.e1 * a.b1 / (f0 * ((1 - {t}) * a.e0 * a.b0 + {t} * a.e1 * a.b1) + f1 * a.e1 * a.b1) AS moved
      FROM forward f JOIN steps x USING (s, k, rn) JOIN backward b USING (s, k, rn) LEFT JOIN backward a ON a.s = f.s AND a.k = f.k AND a.rn = f.rn + 1)"""


BODIES["bkt_em_step"] = _em_step("from_initial", INITIAL_BKT) + " UNION ALL " + _em_step("from_default", DEFAULT_BKT)

_CANDIDATES = ", ".join(f"({i}, {prior}::DOUBLE, {t}::DOUBLE, {slip}::DOUBLE, {guess}::DOUBLE)" for i, (prior, t, slip, guess) in enumerate(CANDIDATE_BKT))
BODIES["bkt_candidate_losses"] = f"""SELECT candidate, round(-avg(ln(CASE WHEN correct THEN q ELSE 1 - q END)), 6) AS log_loss, count(*) AS n
    FROM (
      WITH RECURSIVE rules(candidate, prior, t, slip, guess) AS (VALUES {_CANDIDATES}),
      steps AS (SELECT student_id AS s, topic_id AS k, rn, correct FROM numbered WHERE {_SPLIT} = 'val'),
      traced AS (
        SELECT candidate, t, slip, guess, s, k, rn, correct, prior AS m FROM steps, rules WHERE rn = 1
        UNION ALL
        SELECT candidate, t, slip, guess, x.s, x.k, x.rn, x.correct, p + (1 - p) * t
        FROM (SELECT *, CASE WHEN correct THEN m * (1 - slip) / (m * (1 - slip) + (1 - m) * guess) ELSE m * slip / (m * slip + (1 - m) * (1 - guess)) END AS p FROM traced) y
        JOIN steps x ON x.s = y.s AND x.k = y.k AND x.rn = y.rn + 1)
      SELECT candidate, correct, least(1 - 1e-9, greatest(1e-9, round(m * (1 - slip) + (1 - m) * guess, 12))) AS q FROM traced)
    GROUP BY candidate"""


def _bootstrap(n: int = 2000, seed: int = 42) -> str:
    """Weights by the same hash, sums by replicate, and the interval's two places."""
    prior, _, slip, guess = INITIAL_BKT
    by_student, by_replicate = bootstrap.MULTIPLIERS
    x = f"(student_id % {bootstrap.PRIME} * {by_student} + r * {by_replicate} + {seed}) % {bootstrap.PRIME}"
    rounds = "".join(f", lambda_{i} AS (SELECT * REPLACE ((x * x + {add}) % {bootstrap.PRIME} AS x) FROM {f'lambda_{i - 1}' if i else 'drawn'})" for i, add in enumerate(bootstrap.ROUNDS))
    weight = " + ".join(f"(x >= {bound})::INT" for bound in bootstrap.BOUNDS)

    def loss(p: str) -> str:
        return f"-ln(CASE WHEN correct THEN least(1 - 1e-9, greatest(1e-9, {p})) ELSE 1 - least(1 - 1e-9, greatest(1e-9, {p})) END)"

    return f"""SELECT round((SELECT sum(d) / sum(n) FROM students), 6) AS point, round(v[{int(n * 0.025) + 1}], 6) AS low, round(v[{min(n - 1, int(n * 0.975)) + 1}], 6) AS high
    FROM (
      WITH drawn AS (SELECT d, n, r, {x} AS x FROM students, range({n}) t(r)){rounds}
      SELECT list(q ORDER BY q) AS v FROM (SELECT r, sum(w * d) / sum(w * n) AS q FROM (SELECT r, d, n, {weight} AS w FROM lambda_{len(bootstrap.ROUNDS) - 1}) GROUP BY r))""", (
        f"students AS (SELECT student_id, sum({loss('round(prob, 12)')} - {loss(f'(mastery_before * (1 - {slip}) + (1 - mastery_before) * {guess})')}) AS d, count(*) AS n "
        "FROM predictions GROUP BY student_id)")


# Arrivals of the ordered stream: a row is late if a later one of its chain was applied before it came.
_ARRIVALS = f"""arriving AS ({VIEW_SQL["attempts"]}),
    times AS (SELECT *, epoch_us(ts::TIMESTAMP) AS us, min(epoch_us(ts::TIMESTAMP)) OVER () AS low, max(epoch_us(ts::TIMESTAMP)) OVER () AS high FROM arriving),
    homes AS (SELECT *, least(3, (us - low) * 4 // (high - low + 1) + (event_id % 11 = 0)::INT) AS arrival FROM times),
    marks AS (SELECT a AS arrival, max(us) FILTER (homes.arrival <= a) - (max(high) - max(low)) // 8 AS mark FROM homes, range(4) r(a) GROUP BY a),
    judged AS (
      SELECT h.*, EXISTS (SELECT 1 FROM homes p JOIN marks m ON m.arrival = h.arrival - 1
        WHERE p.student_id = h.student_id AND p.topic_id = h.topic_id AND p.arrival < h.arrival AND p.us <= m.mark
          AND (p.us > h.us OR p.us = h.us AND p.event_id > h.event_id)) AS late
      FROM homes h)"""
BODIES["stream_late"] = f"""SELECT student_id, topic_id, strftime(ts, {TS}) AS ts, event_id, correct FROM attempts"""

ORACLES: dict[str, str] = {name: with_views(body) for name, body in BODIES.items()}


def _arriving(body: str, rows: str) -> str:
    """``body`` with the attempts narrowed to those on time, or late."""
    narrowed = f"{_ARRIVALS},\nattempts AS (SELECT student_id, topic_id, ts, event_id, correct FROM judged WHERE {rows})"
    return body.replace(f"attempts AS ({VIEW_SQL['attempts']})", narrowed)


_BODY, _STUDENTS = _bootstrap()
ORACLES["bootstrap_ci"] = with_views("SELECT * FROM predictions").replace("\nSELECT * FROM predictions", f",\n{_STUDENTS}\n{_BODY}")
ORACLES["stream_ordered"] = _arriving(ORACLES["bkt_mastery"], "NOT late")
ORACLES["stream_late"] = _arriving(ORACLES["stream_late"], "late")
