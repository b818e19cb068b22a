"""Load pipelines (S14): raw files to checked parquet tables, parents before children.

Each stage is read, cleaned, written once, and read back for the checks of later stages. What can be
counted row by row (rows, domains, ranges, the end of a numbered key) is observed by the write itself. Fatal
checks raise before any table of the data set is published: stages go to a staging folder, and are moved to
their places, one after the other, when all checks are done.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from edupulse import schemas
from edupulse.operators import quality as q
from edupulse.operators.aggregates import click_rollup, merge_enrollments
from edupulse.operators.clean import distinct_dimension, drop_full_duplicates, drop_null_keys, normalize_band
from edupulse.operators.ordinal import with_surrogate_key
from edupulse.sources.files import cast_to, clean_counts, csv_header, parse_date, read_csv, read_quoted_csv, read_tagged

# Sensors seen before, source file names, allowed values and plausible ranges.
KNOWN_SENSORS = ["CO2_01", "CO2_02", "CO2_03", "CO2_04", "CO2_05", "CO2_06"]
OCCUPANCY_FILES = {"training": "datatraining.txt", "test": "datatest.txt", "test2": "datatest2.txt"}
TARGETS = ["Graduate", "Dropout", "Enrolled"]
BINARY_COLUMNS = ["daytime_evening_attendance", "displaced", "educational_special_needs", "debtor",
                  "tuition_fees_up_to_date", "gender", "scholarship_holder", "international"]
RANGES = {
    "dropout_records": {"age_at_enrollment": (15, 80), "admission_grade": (0, 200),
                        "previous_qualification_grade": (0, 200), "curricular_units_1st_sem_grade": (0, 20),
                        "curricular_units_2nd_sem_grade": (0, 20)},
    "xapi_student_records": {c: (0, 100) for c in
                             ("raised_hands", "visited_resources", "announcements_view", "discussion")},
    "co2_sensor_readings": {"temperature_c": (0, 50), "humidity_pct": (0, 100), "co2_ppm": (300, 5000),
                            "battery_pct": (0, 100)},
    "occupancy_readings": {"temperature_c": (0, 50), "humidity_pct": (0, 100), "light_lux": (0, 2000),
                           "co2_ppm": (300, 5000), "humidity_ratio": (0, 0.03)},
    "nyc_daily_attendance": {c: (0, 10_000) for c in ("enrolled", "present", "absent", "released")},
    "assist_problems": {"mean_correct": (0, 1)},
    "assist_problem_logs": {"attempt_count": (0, None), "time_on_task": (0, None)},
}
COURSE = ["code_module", "code_presentation"]


class _Load:
    """Stages of one data set: written under a staging folder, published after all checks."""

    def __init__(self, spark: SparkSession, out_dir: str, name: str) -> None:
        self.spark, self.out = spark, out_dir.rstrip("/")
        self.staging = f"{self.out}/_staging_{name}"
        self.tables: dict[str, DataFrame] = {}
        self.written: dict[str, int] = {}
        self.warnings: list[dict] = []

    def write(self, table: str, df: DataFrame, *, source: DataFrame | None = None, numbered: bool = False,
              allowed: Mapping[str, Sequence] | None = None) -> DataFrame:
        """Writes a stage with its columns in stored order and checks it.

        ``source``: rows that must all have arrived. ``numbered``: the key counts from 1, so its
        largest value tells whether it is whole. ``allowed``: values of columns.
        """
        path, ranges, domains = f"{self.staging}/{table}", RANGES.get(table, {}), allowed or {}
        bad = {f"range {c}": q.outside_range(c, low, high) for c, (low, high) in ranges.items()}
        bad |= {f"allowed {c}": q.outside_domain(c, values) for c, values in domains.items()}
        key = schemas.KEYS[table]
        seen = Observation(f"load of {table}")
        df.select(*schemas.columns(table)).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.max(key[0]).alias("last"), *[F.count_if(c).alias(n) for n, c in bad.items()]
        ).write.mode("overwrite").parquet(path)
        found = seen.get
        rows = found["rows"]
        self.written[table] = rows
        stored = self.spark.read.parquet(path)
        self.tables[table] = stored
        for column in domains:
            self._fail("allowed", table, found[f"allowed {column}"], rows)
        if source is not None:
            self._fail("row_count", table, abs(source.count() - rows), rows)
        if numbered:
            self._fail("unique", table, abs((found["last"] or 0) - rows), rows)
        else:
            self.require(q.check_unique(stored, key, table=table))
        self.warnings += [{"check": "range", "table": table, "n_bad": n, "n_rows": rows, "column": c} for c in ranges if (n := found[f"range {c}"])]
        return stored

    def _fail(self, check: str, table: str, n_bad: int, n_rows: int) -> None:
        if n_bad:
            raise q.QualityError(f"{table}: {check} failed for {n_bad} of {n_rows}")

    def keep(self, table: str, df: DataFrame) -> DataFrame:
        """Writes a table that describes the load, beside the loaded ones."""
        path = f"{self.staging}/{table}"
        df.write.mode("overwrite").parquet(path)
        self.tables[table] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[table]

    def require(self, *checks: DataFrame) -> None:
        q.enforce(checks)

    def warn(self, *checks: DataFrame, **about: str) -> None:
        self.warnings += [{**row.asDict(), **about} for row in q.report(checks) if row["n_bad"]]

    def references(self, table: str, parent: str, keys: list[str]) -> None:
        parent_rows = self.tables[parent]
        self.require(q.check_foreign_key(self.tables[table], parent_rows, keys, table=table))

    def publish(self) -> list[dict]:
        """Moves the checked stages to their final folders; returns the warnings."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        moves = [(table, path(f"{self.staging}/{table}"), path(f"{self.out}/{table}")) for table in self.tables]
        fs = path(self.out).getFileSystem(self.spark._jsc.hadoopConfiguration())
        # Nothing moves unless everything can.
        for table, _, target in moves:
            if fs.exists(target):
                raise FileExistsError(f"{self.out}/{table} exists; load into a new folder")
        for table, source, target in moves:
            if not fs.rename(source, target):
                raise OSError(f"could not publish {table}")
        return self.warnings


def _plain(spark: SparkSession, path: str, table: str, **kwargs) -> DataFrame:
    return read_csv(spark, path, schemas.TABLES[table], **kwargs)


def load_oulad(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """Courses, sites, assessments, enrollments, submissions, clicks."""
    load = _Load(spark, out_dir, "oulad")
    load.write("courses", _plain(spark, f"{raw_dir}/courses.csv", "courses"))
    for table, file in (("vle_sites", "vle.csv"), ("assessments", "assessments.csv")):
        load.write(table, _plain(spark, f"{raw_dir}/{file}", table))
        load.references(table, "courses", COURSE)

    enrollments = schemas.TABLES["enrollments"]
    dates = ["date_registration", "date_unregistration"]
    info = read_csv(spark, f"{raw_dir}/studentInfo.csv", enrollments,
                    [c for c in enrollments.fieldNames() if c not in dates])
    registration = read_csv(spark, f"{raw_dir}/studentRegistration.csv", enrollments, [*schemas.KEYS["enrollments"], *dates])
    load.require(q.check_one_to_one(info, registration, schemas.KEYS["enrollments"], table="enrollments"))
    load.write("enrollments", merge_enrollments(normalize_band(info, "imd_band"), registration))
    load.references("enrollments", "courses", COURSE)

    submissions = schemas.TABLES["assessment_submissions"]
    raw = read_csv(spark, f"{raw_dir}/studentAssessment.csv", submissions)
    load.write("assessment_submissions", raw)
    load.references("assessment_submissions", "assessments", ["id_assessment"])
    load.require(q.check_two_hop(
        load.tables["assessment_submissions"], load.tables["assessments"], load.tables["enrollments"],
        bridge_key="id_assessment", parent_keys=schemas.KEYS["enrollments"], table="assessment_submissions"))

    load.write("vle_interactions", click_rollup(_plain(spark, f"{raw_dir}/studentVle.csv", "vle_interactions")))
    if not load.written["vle_interactions"]:
        raise q.QualityError("vle_interactions: no rows")
    load.references("vle_interactions", "vle_sites", ["id_site"])
    load.references("vle_interactions", "enrollments", schemas.KEYS["enrollments"])
    return load.publish()


def load_assistments(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """Districts, classes, problems, rosters, assignments, assignment logs, problem logs."""
    load = _Load(spark, out_dir, "assistments")
    load.write("assist_districts", _plain(spark, f"{raw_dir}/ddets.csv", "assist_districts"))
    load.write("assist_classes", _plain(spark, f"{raw_dir}/cdets.csv", "assist_classes"))
    problems = _plain(spark, f"{raw_dir}/pdets.csv", "assist_problems")
    load.warn(q.check_nulls(problems.select("problem_id"), table="assist_problems"), column="problem_id")
    load.write("assist_problems", drop_null_keys(problems, ["problem_id"]))
    for table, file in (("assist_student_classes", "sdets.csv"), ("assist_assignments", "adets.csv")):
        rows = _plain(spark, f"{raw_dir}/{file}", table)
        load.write(table, rows, source=rows)
        load.references(table, "assist_classes", ["class_id"])
    load.write("assist_assignment_logs", _plain(spark, f"{raw_dir}/alogs.csv", "assist_assignment_logs"))
    load.references("assist_assignment_logs", "assist_assignments", ["assignment_id"])
    load.references("assist_assignment_logs", "assist_student_classes", ["student_id"])

    names = [c for c in schemas.columns("assist_problem_logs") if c != "id"]
    logs = read_csv(spark, f"{raw_dir}/plogs.csv", schemas.TABLES["assist_problem_logs"], names)
    load.write("assist_problem_logs", with_surrogate_key(logs, ["start_time", "log_id", "problem_id", *[
        c for c in names if c not in ("start_time", "log_id", "problem_id")]], "id"), source=logs, numbered=True)
    load.references("assist_problem_logs", "assist_assignment_logs", ["log_id"])
    load.warn(q.check_foreign_key_rows(
        load.tables["assist_problem_logs"], load.tables["assist_problems"], ["problem_id"], table="assist_problem_logs"))
    return load.publish()


def load_xapi(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """Class sections and student records from one file; full duplicates are kept."""
    load = _Load(spark, out_dir, "xapi")
    schema = schemas.TABLES["xapi_student_records"]
    names = [c for c in schema.fieldNames() if c != "record_id"]
    records = read_csv(spark, f"{raw_dir}/xAPI-Edu-Data.csv", schema, names)
    load.require(q.check_nulls(records, table="xapi_student_records"))
    load.write("xapi_class_sections", distinct_dimension(records, schemas.KEYS["xapi_class_sections"]))
    load.warn(q.check_duplicates(records, table="xapi_student_records"))
    load.write("xapi_student_records", with_surrogate_key(records, names, "record_id"), source=records, numbered=True)
    load.references("xapi_student_records", "xapi_class_sections", schemas.KEYS["xapi_class_sections"])
    return load.publish()


def load_dropout(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """One semicolon-separated file with 37 renamed columns."""
    load = _Load(spark, out_dir, "dropout")
    schema = schemas.TABLES["dropout_records"]
    names = [c for c in schema.fieldNames() if c != "id"]
    header = spark.createDataFrame([], ", ".join(f"`{schemas.stored_name(h)}` string" for h in csv_header(spark, f"{raw_dir}/data.csv", sep=";")))
    q.check_columns(header, names, table="dropout_records")
    records = read_csv(spark, f"{raw_dir}/data.csv", schema, names, sep=";")
    load.require(q.check_nulls(records, table="dropout_records"))
    load.write("dropout_records", with_surrogate_key(records, names, "id"), source=records, numbered=True,
               allowed={"target": TARGETS, **{c: [0, 1] for c in BINARY_COLUMNS}})
    return load.publish()


def load_environmental_sensors(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """Quoted-line sensor file; retransmitted rows are dropped on all source columns."""
    load = _Load(spark, out_dir, "sensors")
    schema = schemas.TABLES["co2_sensor_readings"]
    raw = read_quoted_csv(spark, f"{raw_dir}/environmental_sensors.csv", schema, keep_raw=True)
    load.require(q.check_nulls(raw, table="co2_sensor_readings"))
    unique = drop_full_duplicates(raw.withColumn("sensor_id", F.trim("sensor_id")))
    stored = load.write("co2_sensor_readings", cast_to(unique, schema))
    unseen = load.keep("co2_unseen_sensors", q.unseen_values(stored, "sensor_id", KNOWN_SENSORS))
    if n_unseen := unseen.count():
        load.warnings.append({"check": "unseen", "table": "co2_sensor_readings", "values_in": "co2_unseen_sensors", "n_bad": n_unseen})
    return load.publish()


def load_occupancy(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """Three room files, tagged; duplicate rows in a file are an error."""
    load = _Load(spark, out_dir, "occupancy")
    schema = schemas.TABLES["occupancy_readings"]
    rows = read_tagged(spark, {k: f"{raw_dir}/{v}" for k, v in OCCUPANCY_FILES.items()}, schema)
    # Duplicates are rows equal but for the row id, within one file.
    load.require(q.check_nulls(rows, table="occupancy_readings"),
                 q.check_duplicates(rows.drop("source_row_id"), table="occupancy_readings"))
    load.write("occupancy_readings", rows, source=rows, allowed={"occupancy": [0, 1], "source_file": list(OCCUPANCY_FILES)})
    return load.publish()


def load_nyc_attendance(spark: SparkSession, raw_dir: str, out_dir: str) -> list[dict]:
    """Daily school counts with thousands separators and compact dates."""
    load = _Load(spark, out_dir, "attendance")
    counts = ["enrolled", "present", "absent", "released"]
    names = [c for c in schemas.columns("nyc_daily_attendance") if c != "id"]
    text = schemas.T.StructType([schemas.T.StructField(n, schemas.T.StringType()) for n in names])
    raw = read_csv(spark, f"{raw_dir}/NYC_attendance.csv", text, rename=_attendance_name)
    load.require(q.check_nulls(raw, table="nyc_daily_attendance"))
    rows = parse_date(clean_counts(raw, counts), "attendance_date")
    stored = load.write("nyc_daily_attendance", with_surrogate_key(rows, names, "id"), source=raw, numbered=True)
    load.warn(q.check_identity(stored, "enrolled", counts[1:], table="nyc_daily_attendance"))
    load.warn(q.check_unique(stored, ["school_id", "attendance_date"], table="nyc_daily_attendance"))
    return load.publish()


def _attendance_name(header: str) -> str:
    return "attendance_date" if header.strip().lower() == "date" else schemas.stored_name(header)


LOADERS: Mapping[str, Callable[[SparkSession, str, str], list[dict]]] = {
    "oulad": load_oulad, "assistments": load_assistments, "xapi": load_xapi, "dropout": load_dropout,
    "environmental_sensors": load_environmental_sensors, "occupancy": load_occupancy,
    "nyc_attendance": load_nyc_attendance,
}
