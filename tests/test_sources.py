from __future__ import annotations

import pytest

from edupulse import schemas
from edupulse.operators.quality import QualityError
from edupulse.sources import files, loaders
from edupulse.sources.tables import delete_keys, upsert_latest, write_table


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_read_csv_prunes_and_types(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id_assessment,code_module,code_presentation,assessment_type,date,weight,other\n'
               '1,AAA,"20,13",TMA,19.0,10.5,x\n2,AAA,2013J,Exam,,100,y\n')
    df = files.read_csv(spark, path, schemas.TABLES["assessments"])
    assert [f.dataType for f in df.schema] == [f.dataType for f in schemas.TABLES["assessments"]]
    rows = df.orderBy("id_assessment").collect()
    assert (rows[0].date, rows[0].weight, rows[0].code_presentation) == (19, 10.5, "20,13") and rows[1].date is None
    assert files.read_csv(spark, path, schemas.TABLES["assessments"], ["weight"]).columns == ["weight"]


def test_doubled_quotes_and_line_ends_in_fields(spark, tmp_path):
    schema = schemas.TABLES["courses"]
    path = put(tmp_path, "e.csv", 'code_module,code_presentation,module_presentation_length\n"say ""hi"", ok",B,2\n')
    assert files.read_csv(spark, path, schema).first().code_module == 'say "hi", ok'
    path = put(tmp_path, "f.csv", 'code_module,code_presentation,module_presentation_length\n"two\nlines",B,2\n')
    assert files.read_csv(spark, path, schema, multi_line=True).first().code_module == "two\nlines"


def test_nothing_is_published_if_one_target_exists(spark, tmp_path):
    load = loaders._Load(spark, str(tmp_path / "out"), "x")
    load.keep("first", spark.range(3))
    load.keep("second", spark.range(2))
    spark.range(1).write.parquet(str(tmp_path / "out" / "second"))
    with pytest.raises(FileExistsError):
        load.publish()
    assert not (tmp_path / "out" / "first").exists() and spark.read.parquet(str(tmp_path / "out" / "second")).count() == 1


def test_read_csv_errors(spark, tmp_path):
    path = put(tmp_path, "c.csv", "code_module,code_presentation\nA,B\n")
    with pytest.raises(files.ReadError, match="module_presentation_length"):
        files.read_csv(spark, path, schemas.TABLES["courses"])
    path = put(tmp_path, "d.csv", "code_module,code_presentation,module_presentation_length\nA,B,many\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv(spark, path, schemas.TABLES["courses"]).collect()


def test_quoted_framing(spark, tmp_path):
    path = put(tmp_path, "q.csv", '"sensor_id,""published_at"",temp,hum,co2,bat"\n"CO2_01,""2021-01-01T00:00:00Z"",20.5,40,500,0"\n')
    row = files.read_quoted_csv(spark, path, schemas.TABLES["co2_sensor_readings"]).first()
    assert (row.sensor_id, row.temperature_c, row.co2_ppm, row.battery_pct) == ("CO2_01", 20.5, 500, 0.0)
    assert str(row.recorded_at) == "2021-01-01 00:00:00"


def test_counts_and_dates(spark):
    df = spark.createDataFrame([("1,670", "20121001")], "n string, d string")
    row = files.parse_date(files.clean_counts(df, ["n"]), "d").first()
    assert (row.n, str(row.d)) == (1670, "2012-10-01")


def test_stored_names():
    names = {"Daytime/evening attendance\t": "daytime_evening_attendance", "Nacionality": "nationality",
             "Mother's qualification": "mothers_qualification", "GDP": "gdp", "NationalITy": "nationality",
             "Curricular units 1st sem (without evaluations)": "curricular_units_1st_sem_without_evaluations",
             "Previous qualification (grade)": "previous_qualification_grade", "VisITedResources": "visited_resources",
             "ParentschoolSatisfaction": "parent_school_satisfaction", "HumidityRatio": "humidity_ratio"}
    assert {k: schemas.stored_name(k) for k in names} == names
    assert len(schemas.TABLES) == 21 and set(schemas.KEYS) == set(schemas.TABLES)
    assert len(schemas.columns("dropout_records")) == 38


COURSES = "code_module,code_presentation,module_presentation_length\nAAA,2013J,268\n"
INFO = ("code_module,code_presentation,id_student,gender,region,highest_education,imd_band,age_band,num_of_prev_attempts,"
        "studied_credits,disability,final_result\nAAA,2013J,1,F,Wales,A Level,10-20,0-35,0,60,N,Pass\n"
        "AAA,2013J,2,M,Wales,A Level,,0-35,0,60,N,Withdrawn\n")
REGISTRATION = ("code_module,code_presentation,id_student,date_registration,date_unregistration\n"
                "AAA,2013J,1,-10,\nAAA,2013J,2,,12.0\n")


def oulad(folder, **changed):
    texts = {
        "courses.csv": COURSES,
        "vle.csv": "id_site,code_module,code_presentation,activity_type,week_from,week_to\n5,AAA,2013J,quiz,,\n",
        "assessments.csv": "code_module,code_presentation,id_assessment,assessment_type,date,weight\nAAA,2013J,9,TMA,19,10\nAAA,2013J,8,Exam,,100\n",
        "studentInfo.csv": INFO, "studentRegistration.csv": REGISTRATION,
        "studentAssessment.csv": "id_assessment,id_student,date_submitted,is_banked,score\n9,1,18,0,78\n9,2,18,1,\n",
        "studentVle.csv": "code_module,code_presentation,id_student,id_site,date,sum_click\nAAA,2013J,1,5,-3,2\nAAA,2013J,1,5,-3,2\nAAA,2013J,1,5,4,1\n",
    } | changed
    for name, text in texts.items():
        put(folder, name, text)
    return str(folder)


def test_load_oulad(spark, tmp_path):
    raw, out = oulad(tmp_path / "raw"), str(tmp_path / "out")
    assert loaders.load_oulad(spark, raw, out) == []
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    people = {r.id_student: r for r in read("enrollments").collect()}
    assert (people[1].imd_band, people[1].date_unregistration) == ("10-20%", None)
    assert (people[2].imd_band, people[2].date_registration, people[2].date_unregistration) == (None, None, 12)
    assert {(r.date, r.sum_click) for r in read("vle_interactions").collect()} == {(-3, 4), (4, 1)}
    assert {(r.id_student, r.score, r.is_banked) for r in read("assessment_submissions").collect()} == {(1, 78.0, False), (2, None, True)}
    assert "region" not in read("enrollments").columns


@pytest.mark.parametrize(("name", "text", "message"), [
    ("courses.csv", COURSES + "AAA,2013J,1\n", "courses: unique"),
    ("vle.csv", "id_site,code_module,code_presentation,activity_type\n5,ZZZ,2013J,quiz\n", "vle_sites: foreign_key"),
    ("studentRegistration.csv", REGISTRATION + "AAA,2013J,3,1,\n", "enrollments: one_to_one"),
    ("studentAssessment.csv", "id_assessment,id_student,date_submitted,is_banked,score\n9,77,18,0,78\n", "two_hop"),
    ("studentVle.csv", "code_module,code_presentation,id_student,id_site,date,sum_click\n", "vle_interactions: no rows"),
    ("studentVle.csv", "code_module,code_presentation,id_student,id_site,date,sum_click\nAAA,2013J,1,6,0,2\n", "vle_interactions: foreign_key")])
def test_broken_loads_publish_nothing(spark, tmp_path, name, text, message):
    raw, out = oulad(tmp_path / "raw", **{name: text}), tmp_path / "out"
    with pytest.raises(QualityError, match=message):
        loaders.load_oulad(spark, raw, str(out))
    assert not (out / "courses").exists()


def test_load_assistments(spark, tmp_path):
    raw = tmp_path / "raw"
    t = "2019-10-01 10:00:00+00:00"
    put(raw, "ddets.csv", "district_id,location,opportunity_zone,locale_description\n1,MA,No,\n")
    put(raw, "cdets.csv", f"class_id,teacher_id,class_creation_date,student_count,problem_sets_assigned,skill_builders_assigned,x\n3,1,{t},20,1,1,z\n")
    put(raw, "pdets.csv", "problem_id,content_source,skills,problem_type,tutoring_types,student_answer_count,mean_correct,mean_time_on_task\n"
        "7.0,k,\"['a', 'b']\",mc,,30,0.5,10\n,k,,mc,,1,,\n")
    put(raw, "sdets.csv", "student_id,class_id,account_creation_date,started_problem_sets_count,completed_problem_sets_count,"
        f"started_skill_builders_count,mastered_skill_builders_count,answered_problems_count,mean_problem_correctness,mean_problem_time_on_task\n4,3,{t},1,1,0,0,5,,\n")
    put(raw, "adets.csv", "assignment_id,class_id,release_date,due_date,assignment_type,started_student_count,completed_or_mastered_student_count,"
        f"problem_count,mean_correct,mean_time_on_task\n6,3,{t},{t},hw,1,1,2,,\n")
    put(raw, "alogs.csv", f"log_id,student_id,assignment_id,start_time,mean_correct,time_on_task,assignment_completed\n2,4,6,{t},,,True\n")
    put(raw, "plogs.csv", "log_id,problem_id,start_time,time_on_task,answer_before_tutoring,fraction_of_hints_used,attempt_count,answer_given,problem_completed,correct,extra\n"
        f"2,7,{t},1.5,True,0,1,True,True,True,q\n2,99,2019-10-01T10:01:00.5Z,,,,1,False,True,,q\n")
    out = str(tmp_path / "out")
    warnings = loaders.load_assistments(spark, str(raw), out)
    assert {(w["check"], w["table"]): w["n_bad"] for w in warnings} == {
        ("nulls", "assist_problems"): 1, ("foreign_key_rows", "assist_problem_logs"): 1}
    logs = spark.read.parquet(f"{out}/assist_problem_logs").orderBy("id").collect()
    assert [(r.id, r.problem_id, r.correct) for r in logs] == [(1, 7, True), (2, 99, None)]
    from edupulse.operators.attempts import attempts

    rows = attempts(*[spark.read.parquet(f"{out}/{t}") for t in ("assist_problem_logs", "assist_assignment_logs", "assist_problems")]).collect()
    assert [(r.student_id, r.topic_id, r.correct) for r in rows] == [(4, "a", True)]


XAPI = ("gender,NationalITy,PlaceofBirth,StageID,GradeID,SectionID,Topic,Semester,Relation,raisedhands,VisITedResources,AnnouncementsView,"
        "Discussion,ParentAnsweringSurvey,ParentschoolSatisfaction,StudentAbsenceDays,Class\n")


def test_load_xapi(spark, tmp_path):
    line = "M,KW,KuwaIT,low,G-04,A,IT,F,Father,15,16,2,20,Yes,Good,Under-7,M\n"
    put(tmp_path / "raw", "xAPI-Edu-Data.csv", XAPI + line + line + line.replace("15,16", "101,16"))
    warnings = loaders.load_xapi(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert {w["check"]: w["n_bad"] for w in warnings} == {"duplicates": 2, "range": 1}
    rows = spark.read.parquet(str(tmp_path / "out" / "xapi_student_records"))
    assert sorted(r.record_id for r in rows.collect()) == [1, 2, 3]
    assert spark.read.parquet(str(tmp_path / "out" / "xapi_class_sections")).count() == 1


DROPOUT_HEADER = [
    "Marital status", "Application mode", "Application order", "Course", "Daytime/evening attendance\t", "Previous qualification",
    "Previous qualification (grade)", "Nacionality", "Mother's qualification", "Father's qualification", "Mother's occupation",
    "Father's occupation", "Admission grade", "Displaced", "Educational special needs", "Debtor", "Tuition fees up to date", "Gender",
    "Scholarship holder", "Age at enrollment", "International",
    *[f"Curricular units {s} sem ({u})" for s in ("1st", "2nd") for u in ("credited", "enrolled", "evaluations", "approved", "grade", "without evaluations")],
    "Unemployment rate", "Inflation rate", "GDP", "Target"]


def test_load_dropout(spark, tmp_path):
    values = {h: "1" for h in DROPOUT_HEADER} | {"Target": "Graduate", "Age at enrollment": "99", "GDP": "-1.7"}
    line = ";".join(values[h] for h in DROPOUT_HEADER)
    put(tmp_path / "raw", "data.csv", ";".join(DROPOUT_HEADER) + "\n" + line + "\n")
    warnings = loaders.load_dropout(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert [(w["check"], w["column"]) for w in warnings] == [("range", "age_at_enrollment")]
    row = spark.read.parquet(str(tmp_path / "out" / "dropout_records")).first()
    assert (row.id, row.gdp, row.target, row.daytime_evening_attendance) == (1, -1.7, "Graduate", 1)
    put(tmp_path / "bad", "data.csv", ";".join(DROPOUT_HEADER) + "\n" + line.replace("Graduate", "Gone") + "\n")
    with pytest.raises(QualityError, match="dropout_records: allowed failed for 1 of 1"):
        loaders.load_dropout(spark, str(tmp_path / "bad"), str(tmp_path / "out2"))
    put(tmp_path / "more", "data.csv", ";".join([*DROPOUT_HEADER, "Shoe size"]) + "\n" + line + ";44\n")
    with pytest.raises(QualityError, match="unexpected .'shoe_size'"):
        loaders.load_dropout(spark, str(tmp_path / "more"), str(tmp_path / "out3"))
    assert not (tmp_path / "out3").exists()


def test_load_sensors(spark, tmp_path):
    row = '"2021-01-01T00:00:00Z,""x"",CO2_77 ,20,40,500,0"\n'
    put(tmp_path / "raw", "environmental_sensors.csv",
        '"published_at,""date_time"",sensor_id,temp,hum,co2,bat"\n' + row + row + row.replace("T00", "T01").replace("500", "200"))
    warnings = loaders.load_environmental_sensors(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert {w["check"] for w in warnings} == {"range", "unseen"} and spark.read.parquet(str(tmp_path / "out" / "co2_sensor_readings")).count() == 2
    assert [w["n_bad"] for w in warnings if w["check"] == "unseen"] == [1]
    assert [r.sensor_id for r in spark.read.parquet(str(tmp_path / "out" / "co2_unseen_sensors")).collect()] == ["CO2_77"]


def test_load_occupancy(spark, tmp_path):
    header = '"date","Temperature","Humidity","Light","CO2","HumidityRatio","Occupancy"\n'
    for i, name in enumerate(loaders.OCCUPANCY_FILES.values()):
        put(tmp_path / "raw", name, header + f'"1","2015-02-0{i + 1} 17:51:00",23.18,27.272,426,721.25,0.00479,1\n"2","2015-02-0{i + 1} 17:52:00",23.1,27.2,429,714,0.0047,0\n')
    assert loaders.load_occupancy(spark, str(tmp_path / "raw"), str(tmp_path / "out")) == []
    df = spark.read.parquet(str(tmp_path / "out" / "occupancy_readings"))
    assert df.count() == 6 and df.schema["recorded_at"].dataType.simpleString() == "timestamp_ntz"
    row = df.where("source_file = 'test2' and source_row_id = 1").first()
    assert (row.light_lux, row.occupancy, str(row.recorded_at)) == (426.0, 1, "2015-02-03 17:51:00")


def test_load_attendance(spark, tmp_path):
    put(tmp_path / "raw", "NYC_attendance.csv", 'School,Date,SchoolYear,Enrolled,Absent,Present,Released\n01M015,20120906,20122013,"1,670",70,1600,0\n01M015,20120906,20122013,165,9,155,0\n')
    warnings = loaders.load_nyc_attendance(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert {w["check"]: w["n_bad"] for w in warnings} == {"identity": 1, "unique": 2}
    rows = spark.read.parquet(str(tmp_path / "out" / "nyc_daily_attendance"))
    assert {(r.enrolled, str(r.attendance_date)) for r in rows.collect()} == {(1670, "2012-09-06"), (165, "2012-09-06")}


def test_write_table_checks_its_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(QualityError):
        write_table(df, str(tmp_path / "t"), key=["k"])
    assert not (tmp_path / "t").exists()
    write_table(df, str(tmp_path / "t"), partition_by=["v"], key=["k", "v"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a", 0.1, 1), (1, "b", 0.2, 1)], "s long, t string, m double, version long")
    new = spark.createDataFrame([(1, "a", 0.9, 2), (2, "a", None, 2)], base.schema)
    once = upsert_latest(base, new, keys=["s", "t"], order_by=["version"])
    twice = upsert_latest(once, new, keys=["s", "t"], order_by=["version"])
    want = {(1, "a", 0.9, 2), (1, "b", 0.2, 1), (2, "a", None, 2)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    left = delete_keys(once, spark.createDataFrame([(1, "a"), (9, "z")], "s long, t string"), keys=["s", "t"])
    assert {(r.s, r.t) for r in left.collect()} == {(1, "b"), (2, "a")}


def test_mapping_replace_clears_the_other_half(spark):
    ddl = "source_dataset string, class_id long, sensor_id string, record_id long, version long"
    first = spark.createDataFrame([("assistments", 1, "CO2_01", None, 1)], ddl)
    second = spark.createDataFrame([("assistments", 1, None, 5, 2)], ddl)
    row = upsert_latest(first, second, keys=["source_dataset", "class_id"], order_by=["version"]).first()
    assert (row.sensor_id, row.record_id) == (None, 5)
