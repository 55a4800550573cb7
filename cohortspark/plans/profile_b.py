"""Cleaning jobs of partner profile B (C16-C27) and of the foundation feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import cleaning as X
from cohortspark.operators import aggregates as A
from cohortspark.operators import rows as R
from cohortspark.plans.profile_a import ETHNICITY, MEDIUM
from cohortspark.sources.readers import translate_text

# --- fixed values: partner codes and their standard values ---
STATUS = {
    "Matriculated": "Matriculating", "Withdrawn": "Withdrew", "Did Not Enroll": "Did not matriculate", "Deferred": "Did not matriculate",
}
DEGREE = {"Bachelor's (4-year)": "Bachelors", "Associate's (2 year)": "Associates", "Master's": "Masters"}
SUBJECT = {
    "Education": "EDUCATION", "Engineering": "ENGINEERING", "Life Sciences": "SCIENCE", "Social Sciences": "ARTS",
    "Computer Sciences": "SCIENCE", "Mathematics": "SCIENCE", "Fine Arts": "FINE ARTS",
}
STATUS_DROP = ("Other", "Did Not Enroll", "Deferred")
SCHOOL_DEGREES = ("High School Diploma", "GED")
HIGH_SCHOOL = "High School Diploma"
SCHOOL_KIND = [("Magnet", "magnet"), ("Private", "private"), ("Public", "public"), ("Boarding", "boarding")]
ATTENDANCE_TEXT = [
    ("Tardy", "tardy"), ("Suspension", "suspended"), (("Documented", "Excused"), "excused"),
    (("Undocumented", "Absent"), "unexcused"), ("Early", "early_dismissal"),
]
MAX_PERCENT_GRADE = 100.0
ACT_PARTS = ("composite", "english", "math", "reading", "science", "writing")
#: withdrawal reason columns that a transfer reason can set, and its code
TRANSFER_REASONS = {"academic": "Academic", "financial": "Financial", "social": "Social"}
NEVER_RECORDED = ("motivational", "family", "health", "racial")
# --------------------------------------------------------------


def students(students: DataFrame, network: str = "B") -> DataFrame:
    """C16.  A repeated student record keeps its first row by record id."""
    rows = R.distinct_by(students.drop("name"), ["powerschool_id"], ["contact_id"])
    return rows.select(
        F.col("contact_id").alias("b_sf_id"),
        "cps_id",
        F.col("powerschool_id").cast("string").alias("b_powerschool_id"),
        F.lit(network).alias("network"),
        X.parse_date("date_of_birth").alias("date_of_birth"),
        X.recode("ethnicity", ETHNICITY).alias("ethnicity"),
        "is_female", "ever_special_ed", "ever_free_lunch",
        X.strip_text("family_income_bracket", ",").alias("family_income_bracket"),
        X.whole_number("number_in_household").cast("int").alias("number_in_household"),
        "is_first_gen",
        X.pad_zip(X.whole_number("zip"), "one").alias("zip"),
        "fafsa_efc",
    )


def studentid(students: DataFrame) -> DataFrame:
    """C17."""
    ids = students.select(F.col("contact_id").alias("b_sf_id"), F.col("powerschool_id").cast("string").alias("b_powerschool_id"))
    return R.distinct_by(ids, ["b_powerschool_id"], ["b_sf_id"])


def schoolid(schools: DataFrame) -> DataFrame:
    """C18."""
    return schools.select(F.col("school_salesforce_id").alias("b_sf_school_id"))


def enrollments(enrollments: DataFrame, majors: DataFrame, transfer_reasons: dict | None = None) -> DataFrame:
    """College enrolments; ``transfer_reasons`` maps flag column to reason code."""
    codes = TRANSFER_REASONS if transfer_reasons is None else transfer_reasons
    kept = enrollments.filter(X.not_in_or_null("status", STATUS_DROP) & X.not_in_or_null("degree_type", SCHOOL_DEGREES))
    degree = X.recode("degree_type", DEGREE)
    rows = kept.select(
        F.col("student_salesforce_id").alias("b_sf_id"),
        X.whole_number(X.number_or_null("college_ncesid", "double", X.MAX_IPEDS)).cast("int").alias("ipedsid"),
        X.recode("status", STATUS).alias("status"),
        *[X.parse_date(c).alias(c) for c in ("start_date", "end_date", "date_last_verified")],
        degree.alias("degree_type"),
        X.degree_subject(degree, "degree_subject", SUBJECT).alias("degree_subject"),
        F.col("major").alias("__major"),
        "data_source", "living_on_campus",
        *[X.code_flag("transfer_reason__c", code).alias(f"withdrawal_reason_{r}") for r, code in codes.items()],
        *[F.lit(None).cast("boolean").alias(f"withdrawal_reason_{r}") for r in NEVER_RECORDED],
    )
    return translate_text(rows, "__major", majors, "major").drop("__major")


def contacts(contacts: DataFrame) -> DataFrame:
    """C20: unix seconds to dates; an unrecorded success is false."""
    return contacts.select(
        F.col("student_salesforce_id").alias("b_sf_id"),
        X.epoch_date("contact_date").alias("contact_date"),
        "counselor_id",
        X.recode("contact_medium", MEDIUM).alias("contact_medium"),
        "initiated_by_student",
        F.lit(False).alias("was_outreach"),
        X.null_to("was_successful", False).alias("was_successful"),
    )


def acttests(tests: DataFrame) -> DataFrame:
    """Scores are cut to whole numbers."""
    day = X.parse_date("date")
    return tests.select(
        F.col("student_salesforce_id").alias("b_sf_id"),
        day.alias("date"),
        "test_level",
        X.term_of_month(day).alias("test_semester"),
        *[F.col(f"score_{s}").try_cast("double").cast("int").alias(f"score_{s}") for s in ACT_PARTS],
        F.lit(False).alias("onlyhighestavailable"),
    )


def schools(schools: DataFrame, own_organization: str = "PARTNER B") -> DataFrame:
    """Schools whose kind names the own organisation belong to it and are charters."""
    own = F.col("kind").contains(own_organization)
    kind = X.classify("kind", [(("Charter", own_organization), "charter"), *SCHOOL_KIND])
    parent = F.when(own, own_organization).when(F.col("kind").isNull(), F.col("parent_organization"))
    return schools.select(
        X.strip_text("name", ",").alias("name"),
        F.col("school_salesforce_id").alias("b_sf_school_id"),
        F.when(F.col("level") == "Elementary School", "elementary").otherwise(F.lower("level")).alias("level"),
        kind.alias("kind"),
        parent.alias("parent_organization"),
        "no_excuses",
        X.valid_zip("zip").alias("zip"),
        "year_of_first_graduating_class",
        F.lit(None).cast("double").alias("dropout_rate"),
        "number_of_students", "avg_class_size", "number_of_staff", "number_of_counselors", "annual_budget",
    )


def courses(courses: DataFrame) -> DataFrame:
    """C23."""
    return courses.select(
        "course_name",
        F.lit(None).cast("string").alias("course_number"),
        F.col("student_salesforce_id").alias("b_sf_id"),
        F.col("school_salesforce_id").alias("b_sf_school_id"),
        "teacher_id", "year_taken", "semester_taken",
        F.lit(None).cast("date").alias("grade_available"),
        "course_length", "course_level", "credit_hours", "was_honors", "was_ap",
        X.clamp_max("percent_grade", MAX_PERCENT_GRADE).alias("percent_grade"),
        X.strip_text("letter_grade", " ").alias("letter_grade"),
    )


def attendance(attendance: DataFrame) -> DataFrame:
    """C24."""
    return attendance.select(
        F.col("student_salesforce_id").alias("b_sf_id"),
        X.parse_date("attendance_date").alias("attendance_date"),
        "school_year",
        X.classify("attendance_type", ATTENDANCE_TEXT).alias("attendance_type"),
    )


def gpa_by_year(gpa: DataFrame) -> DataFrame:
    """C25."""
    return gpa.withColumnsRenamed({"student_salesforce_id": "b_sf_id", "school_salesforce_id": "b_sf_school_id"})


def gpa_cumulative(gpa: DataFrame) -> DataFrame:
    """Mean over all years, school of the earliest year."""
    means = A.group_mean_first(
        gpa, "student_salesforce_id", ["weighted_gpa", "unweighted_gpa"], "school_salesforce_id", ["school_year", "school_salesforce_id"]
    )
    return means.withColumnsRenamed(
        {
            "student_salesforce_id": "b_sf_id", "school_salesforce_id": "b_sf_school_id",
            "weighted_gpa": "cumulative_weighted_gpa", "unweighted_gpa": "cumulative_unweighted_gpa",
        }
    )


def hs_enrollment(enrollments: DataFrame) -> DataFrame:
    """High-school enrolments with the class of graduates."""
    kept = enrollments.filter((F.col("degree_type") == HIGH_SCHOOL) & X.not_in_or_null("status", STATUS_DROP))
    exit_type, end = X.recode("status", STATUS), X.parse_date("end_date")
    return kept.select(
        F.col("student_salesforce_id").alias("b_sf_id"),
        F.col("college_salesforce_id").alias("b_sf_school_id"),
        X.parse_date("start_date").alias("start_date"),
        end.alias("end_date"),
        exit_type.alias("exit_type"),
        X.class_year(exit_type, end).alias("high_school_class"),
    )


def foundation_acttests(tests: DataFrame) -> DataFrame:
    """One test type, empty columns dropped, zero scores are missing."""
    act = R.drop_empty_columns(tests.filter(F.col("Test_Type__c") == "ACT"))
    have = set(act.columns)
    score = lambda s: X.whole_number(X.zero_to_null(f"ACT_{s}__c")) if f"ACT_{s}__c" in have else F.lit(None).cast("bigint")
    return act.select(
        F.col("Id").alias("foundation_id"),
        (X.parse_date("Date__c") if "Date__c" in have else F.lit(None).cast("date")).alias("date"),
        *[score(s).alias(f"score_{s.lower()}") for s in ("Composite", "English", "Math", "Reading", "Science", "Writing")],
        F.lit(False).alias("onlyhighestavailable"),
    )
