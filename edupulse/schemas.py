"""Stored tables: columns, keys and references (fixed values: names and types of the data sets)."""

from __future__ import annotations

import re

from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
           "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
           "timestamp_ntz": T.TimestampNTZType()}


def _table(ddl: str) -> T.StructType:
    pairs = (item.split() for item in ddl.split(","))
    return T.StructType([T.StructField(n, _SIMPLE[t.rstrip("?")], t.endswith("?")) for n, t in pairs])


_COURSE = "code_module string, code_presentation string"
_CLASS_SECTION = "stage_id string, grade_id string, section_id string, topic string, semester string"
_UNITS = ["credited", "enrolled", "evaluations", "approved", "grade", "without_evaluations"]
_SEMESTERS = ", ".join(
    f"curricular_units_{s}_sem_{u} {'double' if u == 'grade' else 'long'}" for s in ("1st", "2nd") for u in _UNITS)

TABLES: dict[str, T.StructType] = {
    "courses": _table(f"{_COURSE}, module_presentation_length long"),
    "vle_sites": _table(f"id_site long, {_COURSE}, activity_type string"),
    "assessments": _table(f"id_assessment long, {_COURSE}, assessment_type string, date long?, weight double"),
    "enrollments": _table(
        f"{_COURSE}, id_student long, gender string, highest_education string, imd_band string?, age_band string, "
        "num_of_prev_attempts long, studied_credits long, disability string, date_registration long?, "
        "date_unregistration long?, final_result string"),
    "assessment_submissions": _table(
        "id_assessment long, id_student long, date_submitted long, score double?, is_banked boolean"),
    "vle_interactions": _table(f"{_COURSE}, id_student long, id_site long, date long, sum_click long"),
    "xapi_class_sections": _table(_CLASS_SECTION),
    "xapi_student_records": _table(
        f"record_id long, {_CLASS_SECTION}, gender string, nationality string, place_of_birth string, "
        "relation string, raised_hands long, visited_resources long, announcements_view long, discussion long, "
        "parent_answering_survey string, parent_school_satisfaction string, student_absence_days string, "
        "class_label string"),
    "assist_districts": _table(
        "district_id long, location string, opportunity_zone string, locale_description string?"),
    "assist_classes": _table(
        "class_id long, teacher_id long, class_creation_date timestamp, student_count long, "
        "problem_sets_assigned long, skill_builders_assigned long"),
    "assist_problems": _table(
        "problem_id long, content_source string, skills string?, problem_type string, tutoring_types string?, "
        "student_answer_count long, mean_correct double?, mean_time_on_task double?"),
    "assist_student_classes": _table(
        "student_id long, class_id long, account_creation_date timestamp, started_problem_sets_count long, "
        "completed_problem_sets_count long, started_skill_builders_count long, mastered_skill_builders_count long, "
        "answered_problems_count long, mean_problem_correctness double?, mean_problem_time_on_task double?"),
    "assist_assignments": _table(
        "assignment_id long, class_id long, release_date timestamp, due_date timestamp, assignment_type string, "
        "started_student_count long, completed_or_mastered_student_count long, problem_count long, "
        "mean_correct double?, mean_time_on_task double?"),
    "assist_assignment_logs": _table(
        "log_id long, student_id long, assignment_id long, start_time timestamp, mean_correct double?, "
        "time_on_task double?, assignment_completed boolean"),
    "assist_problem_logs": _table(
        "id long, log_id long, problem_id long, start_time timestamp, time_on_task double?, "
        "answer_before_tutoring boolean?, fraction_of_hints_used double?, attempt_count long, answer_given boolean, "
        "problem_completed boolean, correct boolean?"),
    "co2_sensor_readings": _table(
        "sensor_id string, recorded_at timestamp, temperature_c double, humidity_pct double, co2_ppm long, "
        "battery_pct double"),
    "occupancy_readings": _table(
        "source_file string, recorded_at timestamp_ntz, source_row_id long, temperature_c double, "
        "humidity_pct double, light_lux double, co2_ppm double, humidity_ratio double, occupancy long"),
    "nyc_daily_attendance": _table(
        "id long, school_id string, attendance_date date, school_year string, enrolled long, present long, "
        "absent long, released long"),
    "dropout_records": _table(
        "id long, marital_status long, application_mode long, application_order long, course long, "
        "daytime_evening_attendance long, previous_qualification long, previous_qualification_grade double, "
        "nationality long, mothers_qualification long, fathers_qualification long, mothers_occupation long, "
        "fathers_occupation long, admission_grade double, displaced long, educational_special_needs long, "
        "debtor long, tuition_fees_up_to_date long, gender long, scholarship_holder long, age_at_enrollment long, "
        f"international long, {_SEMESTERS}, unemployment_rate double, inflation_rate double, gdp double, target string"),
    "student_knowledge_states": _table(
        "student_id string, topic_id string, mastery double, observation_count long, updated_at timestamp"),
    "classroom_context_mappings": _table(
        "source_dataset string, class_id long, sensor_id string?, record_id long?, updated_at timestamp"),
}

KEYS: dict[str, list[str]] = {
    "courses": ["code_module", "code_presentation"],
    "vle_sites": ["id_site"],
    "assessments": ["id_assessment"],
    "enrollments": ["code_module", "code_presentation", "id_student"],
    "assessment_submissions": ["id_assessment", "id_student"],
    "vle_interactions": ["code_module", "code_presentation", "id_student", "id_site", "date"],
    "xapi_class_sections": ["stage_id", "grade_id", "section_id", "topic", "semester"],
    "xapi_student_records": ["record_id"],
    "assist_districts": ["district_id"],
    "assist_classes": ["class_id"],
    "assist_problems": ["problem_id"],
    "assist_student_classes": ["student_id", "class_id"],
    "assist_assignments": ["assignment_id"],
    "assist_assignment_logs": ["log_id"],
    "assist_problem_logs": ["id"],
    "co2_sensor_readings": ["sensor_id", "recorded_at"],
    "occupancy_readings": ["source_file", "recorded_at"],
    "nyc_daily_attendance": ["id"],
    "dropout_records": ["id"],
    "student_knowledge_states": ["student_id", "topic_id"],
    "classroom_context_mappings": ["source_dataset", "class_id"],
}


def columns(table: str) -> list[str]:
    return TABLES[table].fieldNames()


# Source headers whose plain snake case is not the stored name.
_IRREGULAR = {
    "nacionality": "nationality", "published_at": "recorded_at", "temp": "temperature_c", "hum": "humidity_pct",
    "co2": "co2_ppm", "bat": "battery_pct", "temperature": "temperature_c", "humidity": "humidity_pct",
    "light": "light_lux", "humidityratio": "humidity_ratio", "stageid": "stage_id", "gradeid": "grade_id",
    "sectionid": "section_id", "placeofbirth": "place_of_birth", "raisedhands": "raised_hands",
    "visitedresources": "visited_resources", "announcementsview": "announcements_view",
    "parentansweringsurvey": "parent_answering_survey", "parentschoolsatisfaction": "parent_school_satisfaction",
    "studentabsencedays": "student_absence_days", "class": "class_label", "school": "school_id",
    "schoolyear": "school_year",
}


def stored_name(header: str) -> str:
    """Stored column name of a source header: lower case, words joined by underscores."""
    plain = re.sub(r"[^0-9a-z]+", "_", header.lower().replace("'", "")).strip("_")
    return _IRREGULAR.get(plain, plain)
