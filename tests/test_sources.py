"""CSV scans, mappings, writers, catalog helpers, manifests."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortspark.plans import integration as I
from cohortspark.plans import profile_a as PA
from cohortspark.plans import profile_b as PB
from cohortspark.sources import readers as S
from cohortspark.sources import writers as K

D = date.fromisoformat


def test_csv_with_bare_cr_and_bad_rows(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes(b"id,v\r1,a\rx,b\r3,c\r")
    good, bad = S.split_corrupt(S.read_csv(spark, str(p), "id int, v string").cache())
    assert sorted((r.id, r.v) for r in good.collect()) == [(1, "a"), (3, "c")]
    assert bad.count() == 1
    frames = S.read_named(spark, {"m": (str(p), "id int, v string")})
    assert set(frames) == {"m"}


def test_mapping_last_duplicate_wins_and_empty_is_null(spark, tmp_path):
    p = tmp_path / "map.csv"
    p.write_bytes(b"raw,standard\rba,bachelor arts\rart,first\rart,second\rhist,\r")
    mapping = S.read_mapping(spark, str(p), "raw", "standard")
    assert {r.raw_value: r.standard_value for r in mapping.collect()} == {"BA": "BACHELOR ARTS", "ART": "SECOND", "HIST": None}
    texts = spark.createDataFrame([("  ba ",), ("b\t a",), (None,), ("hist",), ("Art",)], "t string")
    assert [r.o for r in S.translate_text(texts, "t", mapping, "o").select("t", "o").collect()].count("OTHER") == 1
    got = {r.t: r.o for r in S.translate_text(texts, "t", mapping, "o").collect()}
    assert got == {"  ba ": "BACHELOR ARTS", "b\t a": "OTHER", None: None, "hist": None, "Art": "SECOND"}


def test_lookup_is_distinct_sorted_without_blank(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("",), (None,)], "s string")
    assert [r.name for r in S.lookup_table(df, "s").collect()] == ["a", "b"]


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    K.write_table(df, path)
    with pytest.raises(Exception):
        K.write_table(df, path)
    K.write_table(df, path, "append")
    assert S.read_table(spark, path).count() == 6
    K.write_table(df, path, "replace")
    assert S.read_table(spark, path).count() == 3


@pytest.fixture(scope="module")
def namespaces(spark):
    names = ("t_lookup", "t_a", "t_b", "t_common")
    yield names
    for n in names:
        spark.sql(f"DROP SCHEMA IF EXISTS {n} CASCADE")


def test_catalog(spark, namespaces):
    K.create_namespaces(spark, namespaces)
    K.drop_table(spark, "t_lookup.x")
    assert not K.table_exists(spark, "t_lookup.x")
    K.create_from_query(spark, "t_lookup.x", "SELECT id AS a, id * 2 AS b FROM {src}", src=spark.range(4))
    assert K.table_exists(spark, "t_lookup.x") and K.column_names(spark, "t_lookup.x") == ["a", "b"]
    with pytest.raises(Exception):
        K.create_from_query(spark, "t_lookup.x", "SELECT 1 AS a")
    assert S.read_query(spark, "SELECT sum(a) AS s FROM t_lookup.x").first().s == 6
    clean = K.clean_and_write({"raw": spark.range(2)}, lambda raw: raw.withColumn("z", F.lit(1)), "t_lookup.y", ["id"], overwrite=True)
    assert clean.columns == ["id"] and S.read_table(spark, "t_lookup.y").count() == 2


def test_update_and_right_join(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    updates = spark.createDataFrame([(1, "x", 9), (2, None, 8)], "id int, v string, w int")
    assert sorted(tuple(r) for r in K.add_columns(target, updates, "id", ["v", "w"]).collect()) == [(1, "x", 9), (2, None, 8), (3, "c", None)]
    assert sorted((r.id, r.w) for r in K.join_to_ids(updates.select("id", "w"), target.select("id"), "id").collect()) == [(1, 9), (2, 8), (3, None)]


def test_results_and_model_are_stored(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler

    path = str(tmp_path / "results")
    K.append_results(spark, [{"classifier": "DTC", "auc": 0.7, "parameters": {"a": "1"}}], path)
    K.append_results(spark, [{"classifier": "GNB", "auc": 0.6}], path)
    got = {r.classifier: r.auc for r in spark.read.parquet(path).collect()}
    assert got == {"DTC": 0.7, "GNB": 0.6}
    assert "classifier: DTC" in K.text_report({"classifier": "DTC"})
    K.save_model(VectorAssembler(inputCols=["a"], outputCol="b"), str(tmp_path / "m"))
    assert VectorAssembler.load(str(tmp_path / "m")).getOutputCol() == "b"


SF = "0" * 15


def _raw_a(spark):
    return {
        "students": spark.createDataFrame(
            [("A01" + SF, "10000001", "2/29/1992", "Female", "B", "true", None, "false", 12.0, "North", 2010), ("A02" + SF, None, "1/1/1970", "x", "Asian", None, None, None, None, None, 2011)],
            "Id string, Network_Student_ID__c string, Birthdate string, Gender__c string, Ethnicity__c string, Special_Education__c string, Low_Income__c string, "
            "First_Generation_College_Student__c string, EFC_from_FAFSA__c double, High_School__c string, HS_Class__c int",
        ),
        "college_database": spark.createDataFrame(
            [("C01" + SF, 123456.0, "Private not-for-profit 4-year", "60614-1", "Alpha, U", 50.0, None, None, None, "true"), ("C02" + SF, None, None, "x", "Beta", None, None, None, None, None)],
            "`College ID` string, NCESid__c double, College_Type__c string, ShippingPostalCode string, Name string, 6_yr_completion_rate__c double, "
            "6_yr_minority_completion_rate__c double, 6_yr_transfer_rate__c double, 6_yr_minority_transfer_rate__c double, HBCU__c string",
        ),
        "enrolments": spark.createDataFrame(
            [("A01" + SF, "C01" + SF, "2010-09-01", "2012-06-01", None, "Withdrew", "s", "Bachelor's", " ba", "Biology", "Financial;Health"), ("A01" + SF, "C01" + SF, "2010-09-01", "2012-06-01", None, "Withdrew", "s", "Bachelor's", " ba", "Biology", "Financial;Health")],
            "Student__c string, College__c string, Start_Date__c string, End_Date__c string, Date_Last_Verified__c string, Status__c string, Data_Source__c string, "
            "Degree_Type__c string, Degree_Text__c string, Major_Text__c string, Withdrawal_code__c string",
        ),
        "courses": spark.createDataFrame(
            [(10000001, 1234, 2010, "S1", "Alg, 1", 1, 95.0, "A", 1, 0, None, 1.0, 9.0), (10000001, 1234, 2010, "S2", "Art", 2, 130.0, "??", 0, 0, "No", 1.0, 9.0), (10000001, 1234, 2010, "S2", "Gym", 3, 90.0, "P", 0, 0, "Yes", 1.0, None)],
            "STUDENT_NUMBER int, schoolid int, sy int, storecode string, course_name string, course_number int, percent double, grade string, honors int, ap int, excludefromgpa string, potentialcrhrs double, `Grade Level` double",
        ),
    }


def _raw_b(spark):
    return {
        "students": spark.createDataFrame(
            [("B01" + SF, 7, "n", None, "1993-03-04", "H", True, None, None, "1,000", 3.0, True, 7102.0, None), ("B02" + SF, 7, "n", None, "1993-03-04", "H", True, None, None, "1,000", 3.0, True, 7102.0, None)],
            "contact_id string, powerschool_id int, name string, cps_id string, date_of_birth string, ethnicity string, is_female boolean, ever_special_ed boolean, ever_free_lunch boolean, "
            "family_income_bracket string, number_in_household double, is_first_gen boolean, zip double, fafsa_efc double",
        ),
        "enrolments": spark.createDataFrame(
            [("B01" + SF, "T01" + SF, "123456", "Withdrawn", "2011-09-01", None, None, "Bachelor's (4-year)", "Mathematics", "Biology", "Academic", "s", None), ("B01" + SF, "T01" + SF, "1234567", "Graduated", "2007-09-01", "2011-06-01", None, "High School Diploma", None, None, None, "s", None)],
            "student_salesforce_id string, college_salesforce_id string, college_ncesid string, status string, start_date string, end_date string, date_last_verified string, degree_type string, "
            "degree_subject string, major string, transfer_reason__c string, data_source string, living_on_campus boolean",
        ),
    }


def _settings(spark):
    mapping = lambda rows: spark.createDataFrame(rows, "raw_value string, standard_value string")
    return {"degrees": mapping([("BA", "BACHELOR ARTS")]), "majors": mapping([("BIOLOGY", "SCIENCE")])}


def test_warehouse_end_to_end(spark, namespaces):
    raw_a, raw_b = _raw_a(spark), _raw_b(spark)
    skip = {"skip_a": I.missing_tables(I.MANIFEST_A, raw_a), "skip_b": I.missing_tables(I.MANIFEST_B, raw_b)}
    out = I.build_warehouse(spark, raw_a, raw_b, _settings(spark), D("2015-01-01"), namespaces=namespaces, **skip)
    assert out["studentid"].count() == 3 and sorted(r.studentid for r in out["studentid"].collect()) == [1, 2, 3]
    enrol = {r.status: r for r in out["enrollments"].collect()}
    # exact duplicate facts collapse, both partners reach the same college
    assert out["enrollments"].count() == 2 and enrol["Withdrew"].studentid is not None
    assert {r.collegeid for r in out["enrollments"].collect()} == {out["collegeid"].filter("ipedsid = 123456").first().collegeid}
    assert {r.degree_subject for r in out["enrollments"].collect()} == {"BACHELOR ARTS", "BACHELOR SCIENCE"}
    labels = {r.persist_1_halfyear for r in out["enrollment_dummies"].collect()}
    assert labels == {True, None}
    hs = out["hs_enrollment"].collect()
    assert {r.high_school_class for r in hs} == {2010}
    gpa = out["gpa_by_year"].first()
    # the ungraded course keeps its hour in the denominator, pass/fail is excluded
    assert (float(gpa.unweighted_gpa), float(gpa.weighted_gpa)) == (2.0, 2.25)


def test_clean_values(spark):
    raw = _raw_a(spark)
    s = {r.a_sf_id[:3]: r for r in PA.students(raw["students"]).collect()}
    assert s["A01"].date_of_birth == D("1992-02-29") and s["A01"].is_female and s["A01"].ethnicity == "African American"
    assert s["A02"].date_of_birth is None and s["A02"].is_female is None
    c = PA.courses(raw["courses"]).orderBy("course_number").collect()
    assert [(r.letter_grade, r.percent_grade, r.semester_taken, r.course_name) for r in c][:2] == [("A", 95.0, 1, "Alg 1"), (None, None, 2, "Art")]
    assert c[0].grade_available == D("2009-12-31")
    b = PB.students(_raw_b(spark)["students"]).collect()
    assert [(r.b_sf_id[:3], r.zip, r.family_income_bracket) for r in b] == [("B01", "07102", "1000")]


def test_profile_b_school_rules(spark):
    rows = [("T1", "A, B", "Partner B Charter", "Elementary School", "x", True, "07102-1", 1990, 1, 1.0, 1, 1, 1.0), ("T2", "C", None, "High School", "x", None, "00500", None, None, None, None, None, None)]
    df = spark.createDataFrame(
        rows,
        "school_salesforce_id string, name string, kind string, level string, parent_organization string, no_excuses boolean, zip string, year_of_first_graduating_class int, "
        "number_of_students int, avg_class_size double, number_of_staff int, number_of_counselors int, annual_budget double",
    )
    got = {r.b_sf_school_id: (r.name, r.kind, r.level, r.parent_organization, r.zip) for r in PB.schools(df, "Partner B").collect()}
    assert got == {"T1": ("A B", "charter", "elementary", "Partner B", "07102"), "T2": ("C", None, "high school", "x", None)}
