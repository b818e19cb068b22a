"""SQL definitions of the views in ``driver_tables``, for the cross-check."""

from __future__ import annotations

import re

VIEW_SQL = {
    "attempts": """
        SELECT user_id AS student_id, event_type AS topic_id, ts, event_id, value >= 30 AS correct FROM events""",
    "student_classes": """
        SELECT c_custkey AS student_id, CAST(c_nationkey AS BIGINT) AS class_id FROM customer
        UNION ALL
        SELECT c_custkey, CAST((c_nationkey + 1) % 25 AS BIGINT) FROM customer WHERE c_acctbal >= 6000""",
    "problems": """
        SELECT p_partkey AS problem_id,
               '[''' || s1 || CASE WHEN s1 <> s2 THEN ''', ''' || s2 ELSE '' END || ''']' AS skills,
               s1, s2, mean_correct, mean_time_on_task, student_answer_count
        FROM (SELECT p_partkey,
                     ['click', 'error', 'purchase', 'signup', 'view'][p_partkey % 5 + 1] AS s1,
                     ['click', 'error', 'purchase', 'signup', 'view'][p_size % 5 + 1] AS s2 FROM part)
        JOIN (SELECT l_partkey, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS mean_correct,
                     avg(l_quantity) AS mean_time_on_task, count(*) AS student_answer_count
              FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""",
    "enrollments": """
        SELECT c_mktsegment AS code_module, r_name AS code_presentation, c_custkey AS id_student,
               CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               n_name AS highest_education,
               CASE WHEN band >= 0 THEN (band * 10)::VARCHAR || '-' || (band * 10 + 10)::VARCHAR
                    || CASE WHEN band = 1 THEN '' ELSE '%' END END AS imd_band,
               ['0-35', '35-55', '55<='][c_nationkey % 3 + 1] AS age_band,
               c_custkey % 4 AS num_of_prev_attempts,
               (c_custkey % 6 + 1) * 30 AS studied_credits,
               CASE WHEN c_custkey % 11 = 0 THEN 'Y' ELSE 'N' END AS disability,
               CASE WHEN c_custkey % 50 <> 0 THEN -(c_custkey % 120) END AS date_registration,
               CASE WHEN c_custkey % 10 <= 1 AND c_custkey % 7 <> 0 THEN c_custkey % 97 END AS date_unregistration,
               CASE WHEN c_custkey % 10 <= 1 THEN 'Withdrawn' WHEN c_custkey % 10 <= 3 THEN 'Fail'
                    WHEN c_custkey % 10 <= 8 THEN 'Pass' ELSE 'Distinction' END AS final_result
        FROM (SELECT *, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band FROM customer)
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "courses": "SELECT DISTINCT code_module, code_presentation FROM enrollments",
    "assessments": """
        SELECT id_assessment, code_module, code_presentation, assessment_type,
               CASE WHEN assessment_type <> 'Exam' THEN p_size END AS date, 10.0::DOUBLE AS weight
        FROM (SELECT p_partkey AS id_assessment,
                     ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][p_partkey % 5 + 1] AS code_module,
                     ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][(p_partkey // 5) % 5 + 1] AS code_presentation,
                     ['TMA', 'CMA', 'Exam'][p_size % 3 + 1] AS assessment_type, CAST(p_size AS BIGINT) AS p_size
              FROM part)""",
    "submissions": """
        SELECT l_partkey AS id_assessment, o_custkey AS id_student, CAST(min(l_quantity) AS BIGINT) AS date_submitted,
               CASE WHEN max(l_linenumber) <> 7 THEN CAST(floor(min(l_extendedprice)) AS BIGINT) % 101 END::DOUBLE AS score,
               max(l_discount) >= 0.09 AS is_banked
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "raw_clicks": """
        SELECT code_module, code_presentation, id_student, l_suppkey AS id_site, l_partkey % 60 AS date,
               CAST(l_quantity AS BIGINT) AS sum_click
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN enrollments ON o_custkey = id_student""",
    "clicks": """
        SELECT code_module, code_presentation, id_student, id_site, date, CAST(sum(sum_click) AS BIGINT) AS sum_click
        FROM raw_clicks GROUP BY ALL""",
    "attendance": """
        SELECT 'S' || l_suppkey::VARCHAR AS school_id, date_trunc('month', l_shipdate)::DATE AS attendance_date,
               year(l_shipdate)::VARCHAR AS school_year, count(*) AS enrolled,
               count(*) FILTER (l_returnflag = 'A') AS present, count(*) FILTER (l_returnflag = 'R') AS absent,
               count(*) FILTER (l_returnflag = 'N') AS released
        FROM lineitem GROUP BY 1, 2, 3""",
    "interactions": """
        SELECT user_id AS student_id, ts, event_id,
               CASE WHEN tried THEN 'problem_attempt' ELSE 'resource_view' END AS type,
               CASE WHEN tried THEN event_type END AS topic_id, CASE WHEN tried THEN value >= 30 END AS outcome
        FROM (SELECT *, event_type IN ('click', 'purchase', 'error') AS tried FROM events)""",
    "assessment_results": """
        SELECT o_custkey AS student_id, o_orderkey AS assessment_id, o_totalprice % 101 AS score,
               o_orderdate AS submitted_at FROM orders""",
    "room_readings": """
        SELECT 'room' || (user_id % 10)::VARCHAR AS source_file, ts AS recorded_at, event_id, value AS temperature_c,
               (event_id % 100)::DOUBLE AS humidity_pct, value * 2 AS light_lux, value * 10 + 400 AS co2_ppm,
               (value >= 30)::INT AS occupancy FROM events""",
    "sensor_readings": """
        SELECT 'CO2_0' || (user_id % 6 + 1)::VARCHAR AS sensor_id, ts AS recorded_at, event_id,
               value AS temperature_c, (event_id % 100)::DOUBLE AS humidity_pct,
               CAST(floor(value * 10 + 400) AS BIGINT) AS co2_ppm, (event_id % 101)::DOUBLE AS battery_pct FROM events""",
    "absence_records": """
        SELECT l.doc_id AS record_id, lang AS stage_id, source AS grade_id, 'A' AS section_id, lang AS topic,
               'F' AS semester, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS parent_answering_survey,
               CASE WHEN quality = 1 THEN 'Good' ELSE 'Bad' END AS parent_school_satisfaction,
               n_chars % 100 AS raised_hands, n_chars % 10 AS visited_resources, n_chars % 5 AS announcements_view,
               n_chars % 4 AS discussion,
               CASE WHEN toxic = 1 THEN 'Above-7' ELSE 'Under-7' END AS student_absence_days
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "context_mapping": """
        SELECT 'assistments' AS source_dataset, CAST(n_nationkey AS BIGINT) AS class_id,
               CASE WHEN n_regionkey <> 4 THEN 'CO2_0' || (n_nationkey % 6 + 1)::VARCHAR END AS sensor_id,
               CASE WHEN n_regionkey <> 3 THEN CAST(n_nationkey AS BIGINT) END AS record_id FROM nation""",
    "scored_lines": """
        SELECT (l_returnflag = 'R')::INT AS label, (l_quantity / 50 + l_discount * 5) / 2 AS prob FROM lineitem""",
    # Mastery: a fold over each chain in order.
    "chains": """
        SELECT student_id, topic_id, list(correct ORDER BY ts, event_id) AS outcomes, count(*) AS n, max(ts) AS last
        FROM attempts GROUP BY 1, 2""",
    "states": """
        SELECT student_id, topic_id, n AS observation_count, last AS updated_at,
               list_reduce(outcomes, lambda m, ok: CASE WHEN ok
                   THEN m * 0.813 / (m * 0.813 + (1 - m) * 0.3521)
                        + (1 - m * 0.813 / (m * 0.813 + (1 - m) * 0.3521)) * 0.0274
                   ELSE m * 0.187 / (m * 0.187 + (1 - m) * 0.6479)
                        + (1 - m * 0.187 / (m * 0.187 + (1 - m) * 0.6479)) * 0.0274 END, 0.5639::DOUBLE) AS mastery
        FROM (SELECT * REPLACE (list_transform(outcomes, lambda x: x::INT::DOUBLE) AS outcomes) FROM chains)""",
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY student_id, topic_id ORDER BY ts, event_id) AS rn FROM attempts""",
    "trajectory": """
        SELECT student_id, topic_id, rn, 0.5639::DOUBLE AS mastery_before, correct, event_id, ts FROM numbered WHERE rn = 1
        UNION ALL
        SELECT n.student_id, n.topic_id, n.rn, p + (1 - p) * 0.0274, n.correct, n.event_id, n.ts
        FROM (SELECT *, CASE WHEN correct THEN mastery_before * 0.813 / (mastery_before * 0.813 + (1 - mastery_before) * 0.3521)
                        ELSE mastery_before * 0.187 / (mastery_before * 0.187 + (1 - mastery_before) * 0.6479) END AS p
              FROM trajectory) t
        JOIN numbered n ON n.student_id = t.student_id AND n.topic_id = t.topic_id AND n.rn = t.rn + 1""",
    "predictions": """
        SELECT *, mastery_before * 0.813 + (1 - mastery_before) * 0.3521 AS prob FROM trajectory""",
    "rosters": """
        SELECT DISTINCT class_id, student_id FROM student_classes
        WHERE student_id IN (SELECT student_id FROM attempts)""",
    "capped": """
        SELECT class_id, student_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY student_id) AS k
        FROM rosters) WHERE k <= 15""",
    "mastery_by_class": """
        SELECT class_id, topic_id, avg(mastery) AS average_mastery,
               CAST(sum(observation_count) AS BIGINT) AS observation_count
        FROM rosters JOIN states USING (student_id) GROUP BY 1, 2""",
    "priorities": """
        SELECT *, 1 - average_mastery AS priority_score, row_number() OVER (PARTITION BY class_id
               ORDER BY 1 - average_mastery DESC, observation_count DESC, topic_id) AS priority_rank
        FROM mastery_by_class WHERE observation_count >= 3""",
    "catalog": """
        SELECT s1 AS topic_id, problem_id, mean_correct, mean_time_on_task, student_answer_count FROM problems
        UNION ALL
        SELECT s2, problem_id, mean_correct, mean_time_on_task, student_answer_count FROM problems WHERE s1 <> s2""",
    "topk": """
        SELECT * FROM (SELECT *, abs(mean_correct - 0.65) AS distance_from_target,
               row_number() OVER (PARTITION BY topic_id ORDER BY abs(mean_correct - 0.65), problem_id) AS problem_rank
        FROM catalog WHERE student_answer_count >= 20) WHERE problem_rank <= 3""",
    "student_engagement": """
        SELECT *, CASE WHEN delta > 1 THEN 'increasing' WHEN delta < -1 THEN 'decreasing'
                       WHEN delta IS NOT NULL THEN 'stable' END AS trend
        FROM (SELECT student_id, sum(n)::BIGINT AS total_interactions, sum(views)::BIGINT AS resource_interaction_days,
                     sum(tries)::BIGINT AS problem_attempts, sum(good)::BIGINT AS correct_attempts,
                     sum(bad)::BIGINT AS incorrect_attempts, count(*) AS active_days, max(last) AS last_interaction_at,
                     round(avg(n) FILTER (k <= 3) - avg(n) FILTER (k > 3), 9) AS delta
              FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY day DESC) AS k
                    FROM (SELECT student_id, ts::DATE AS day, count(*) AS n, count(*) FILTER (type = 'resource_view') AS views,
                                 count(*) FILTER (type = 'problem_attempt') AS tries, count(*) FILTER (outcome) AS good,
                                 count(*) FILTER (NOT outcome) AS bad, max(ts) AS last
                          FROM interactions GROUP BY 1, 2)) GROUP BY 1)""",
    "student_assessment": """
        SELECT *, CASE WHEN delta > 1 THEN 'improving' WHEN delta < -1 THEN 'declining'
                       WHEN delta IS NOT NULL THEN 'stable' END AS trend
        FROM (SELECT student_id, count(*) AS total_results, avg(score) AS average_score,
                     avg(score) FILTER (k <= 3) AS recent_average_score, max(submitted_at) AS last_assessment_at,
                     round(avg(score) FILTER (k <= 3) - avg(score) FILTER (k > 3), 9) AS delta
              FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, assessment_id DESC) AS k
                    FROM assessment_results) GROUP BY 1)""",
    "class_counts": """
        SELECT class_id, count(*) AS students_used, count(*) AS students_eligible, false AS roster_capped FROM rosters GROUP BY 1""",
    "capped_counts": """
        SELECT class_id, least(count(*), 15) AS students_used, count(*) AS students_eligible, count(*) > 15 AS roster_capped
        FROM rosters GROUP BY 1""",
    "latest_sensor": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY recorded_at DESC, event_id DESC) AS k
        FROM sensor_readings) WHERE k = 1""",
    "context": """
        SELECT m.*, s.recorded_at, s.co2_ppm, s.temperature_c, s.humidity_pct, r.record_id IS NOT NULL AS has_record,
               r.raised_hands, r.visited_resources, r.announcements_view, r.discussion,
               (r.raised_hands + 1) / 101.0::DOUBLE AS predicted_absence_risk
        FROM context_mapping m LEFT JOIN latest_sensor s ON s.sensor_id = m.sensor_id
        LEFT JOIN absence_records r ON r.record_id = m.record_id""",
}


def with_views(body: str) -> str:
    """``body`` preceded by the views it mentions, in dependency order."""
    ordered: list[str] = []

    def need(text: str, own: str | None = None) -> None:
        for name in VIEW_SQL:
            if name != own and name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(VIEW_SQL[name], name)
                ordered.append(name)

    need(body)
    if not ordered:
        return body
    recursive = "RECURSIVE " if "trajectory" in ordered else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in ordered) + "\n" + body
