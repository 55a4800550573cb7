"""Cleaning jobs of partner profile A (C01-C15): raw frames in, one clean frame out.

Every job is a composition of column expressions and operators; nothing is
collected.  Values that depend on the partner (blocked ids, placeholder ids,
schools with several counsellors, the reference date) are arguments.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import cleaning as X
from cohortspark.operators import aggregates as A
from cohortspark.operators import joins as J
from cohortspark.operators import rows as R
from cohortspark.sources.readers import translate_text

# --- fixed values: partner codes and their standard values ---
ETHNICITY = {
    "Multi-Cultural": "Multicultural", "Native American": "American Indian", "B": "African American", "T": "African American",
    "H": "Hispanic", "W": "Caucasian", "I": "American Indian", "P": "Pacific Islander",
}
MEDIUM = {
    "Phone": "Call", "Mail (letter/postcard)": "Mail", "College staff contact": "College Contact",
    "Parent contact (any medium)": "Parent Contact",
}
SELECTIVITY = {"Not Available": None, "2 year (Noncompetitive)": None, "2 year (Competitive)": None}
SIZE_RANGE = {"Not applicable": None, "Not reported": None}
OUTREACH = ("Outreach only", "Outeach only")
ATTENDANCE_CODES = {
    "X": "excused", "M": "excused", "T": "tardy", "T0": "tardy", "T5": "tardy", "L0": "tardy", "L5": "tardy",
    "A": "unexcused", "R": "unexcused", "E": "early_dismissal", "E0": "early_dismissal", "E5": "early_dismissal", "S": "suspended",
}
ATTENDANCE_DROP = ("F", "G", "H5", "H1")
WITHDRAWAL_CODES = {
    "financial": "Financial", "academic": "Academic", "motivational": "Motivational", "family": "Family",
    "health": "Health", "social": "Social", "racial": "Racial Conflict",
}
GRADE_REPAIR_GPA = {"p": "P", " P": "P", "c+": "C+", "c-": "C-", "d": "D"}
GRADE_REPAIR = {"p": "P", " P": "P"}
COURSE_NAME_REPAIR = {"Comuter Programming": "Computer Programming"}
AP_BONUS, HONORS_BONUS = 1.0, 0.5
COLLEGE_SECTOR = [("Private", True), ("Public", False)]
COLLEGE_PROFIT = [("not-for-profit", False), ("for-profit", True)]
COLLEGE_LENGTH = [("less than 2-year", None), ("4-year", True), ("2-year", False)]
EXTRA_COLLEGE = {
    "STABBR": "state", "Longitude": "longitude", "Latitude": "latitude", "DistFromChicago": "dist_from_chicago",
    "PercentInState": "percentinstate", "PercentOutOfState": "percentoutofstate", "PercentPellGrant": "percentpellgrant",
    "AvgNetPrice": "avgnetprice", "NetPrice0-30": "netprice0_30", "NetPrice30-48": "netprice30_48",
    "NetPrice48-75": "netprice48_75", "Locale": "locale",
}
EXTRA_PERCENT = {
    "%Apply_Accepted": "perc_accepted", "%Accepted_Enroll": "perc_accepted_enroll", "% male": "perc_male",
    "% female": "perc_female", "% AA": "perc_african_american", "% Hispanic": "perc_hispanic",
}
# --------------------------------------------------------------


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def studentid(contacts: DataFrame) -> DataFrame:
    """C01."""
    return contacts.select(F.col("Id").alias("a_sf_id"), F.col("Network_Student_ID__c").alias("cps_id"))


def collegeid(colleges: DataFrame, blocked: Sequence[str] = ()) -> DataFrame:
    """External college ids without the blocked duplicates."""
    ids = colleges.select(_q("College ID").alias("a_sf_college_id"), X.whole_number("NCESid__c").alias("ipedsid"))
    return R.exclude_ids(ids, "a_sf_college_id", list(blocked))


def _named_accounts(accounts: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Distinct accounts whose name occurs in a column of another frame."""
    return J.members(accounts, "Name", names, column).distinct()


def schoolid(accounts: DataFrame, alumni: DataFrame, powerschool_ids: DataFrame) -> DataFrame:
    """School ids of the campuses alumni went to; the code column is the one besides ``Campus``."""
    code = [c for c in powerschool_ids.columns if c != "Campus"][0]
    used = _named_accounts(accounts, alumni, "High_School__c").select("Name", "Id").distinct()
    joined = used.join(powerschool_ids, used["Name"] == powerschool_ids["Campus"], "inner")
    return joined.select(F.col("Id").alias("a_sf_school_id"), _q(code).cast("string").alias("a_powerschool_id"))


def colleges(colleges: DataFrame, extra_college_features: DataFrame, blocked: Sequence[str] = ()) -> DataFrame:
    """College attributes joined with the extra features by federal id."""
    kind = X.null_to("College_Type__c", "")
    base = colleges.select(
        _q("College ID").alias("a_sf_college_id"),
        X.whole_number("NCESid__c").alias("ipedid"),
        X.classify(kind, COLLEGE_SECTOR).alias("isprivate"),
        X.classify(kind, COLLEGE_PROFIT).alias("isforprofit"),
        X.classify(kind, COLLEGE_LENGTH).alias("is4year"),
        X.extract_or_null("ShippingPostalCode", X.LEADING_ZIP).alias("zip"),
        X.strip_text("Name", ",").alias("name"),
        *[F.lit(None).cast("boolean").alias(c) for c in ("isrural", "allmale", "allfemale")],
        X.whole_number("6_yr_completion_rate__c").alias("graduationrate_6yr"),
        X.whole_number("6_yr_minority_completion_rate__c").alias("graduationrate_minority_6yr"),
        X.whole_number("6_yr_transfer_rate__c").alias("transferrate_6yr"),
        X.whole_number("6_yr_minority_transfer_rate__c").alias("transferrate_minority_6yr"),
        X.as_flag("HBCU__c").alias("historicallyblack"),
    )
    extra = extra_college_features.select(
        X.whole_number("UNITID").alias("ipedid"),
        *[_q(raw).alias(name) for raw, name in EXTRA_COLLEGE.items()],
        X.recode("SimpleBarrons", SELECTIVITY).alias("barrons_rating"),
        *[X.strip_text(_q(raw), "%").try_cast("double").alias(name) for raw, name in EXTRA_PERCENT.items()],
        X.recode(X.strip_text(_q("Size Range"), ","), SIZE_RANGE).alias("size_range"),
    )
    joined = R.exclude_ids(base.join(extra, "ipedid", "left"), "a_sf_college_id", list(blocked))
    return joined.withColumn("ipedid", F.col("ipedid").cast("string"))


def acttests(tests: DataFrame) -> DataFrame:
    """C05."""
    return tests.select(
        F.col("student_number").cast("string").alias("cps_id"),
        X.parse_date("test_date").alias("date"),
        F.upper("testname_clean").alias("test_level"),
        X.term_of_phase("timeperiod").alias("test_semester"),
        *[F.col(s).alias(f"score_{s}") for s in ("composite", "english", "math", "reading", "science")],
        F.lit(None).cast("int").alias("score_writing"),
        F.lit(False).alias("onlyhighestavailable"),
    )


def attendance(attendance: DataFrame) -> DataFrame:
    """Code, then description overrides, then the drop list; unknown codes and null stay."""
    kind = (
        F.when(F.col("DESCRIPTION") == "Late", "tardy")
        .when(F.col("DESCRIPTION") == "Late Arrival Excused", "excused")
        .otherwise(X.recode("ATT_CODE", ATTENDANCE_CODES))
    )
    rows = attendance.select(
        F.col("STUDENT_NUMBER").cast("string").alias("student_cps_id"),
        F.col("SCHOOLID").cast("string").alias("school_a_powerschoolid"),
        X.parse_date("ATT_DATE").alias("attendance_date"),
        F.col("SY").alias("school_year"),
        kind.alias("attendance_type"),
    )
    return rows.filter(X.not_in_or_null("attendance_type", ATTENDANCE_DROP))


def enrollments(enrollment: DataFrame, degrees: DataFrame, majors: DataFrame, as_of: date) -> DataFrame:
    """Dates, status, standardised degree and major, withdrawal reasons."""
    when = lambda c: X.null_after(X.parse_date(c), as_of)
    rows = enrollment.select(
        F.col("Student__c").alias("a_student_sf_id"),
        F.col("College__c").alias("a_college_sf_id"),
        when("Start_Date__c").alias("start_date"),
        when("End_Date__c").alias("end_date"),
        when("Date_Last_Verified__c").alias("date_last_verified"),
        F.col("Status__c").alias("status"),
        F.col("Data_Source__c").alias("data_source"),
        F.lit(None).cast("boolean").alias("living_on_campus"),
        X.strip_text("Degree_Type__c", "'").alias("degree_type"),
        F.col("Degree_Text__c").alias("__degree"),
        F.col("Major_Text__c").alias("__major"),
        *[X.has_code("Withdrawal_code__c", code).alias(f"withdrawal_reason_{r}") for r, code in WITHDRAWAL_CODES.items()],
    )
    rows = translate_text(rows, "__degree", degrees, "degree_subject")
    return translate_text(rows, "__major", majors, "major").drop("__degree", "__major")


def students(students: DataFrame, network: str = "A") -> DataFrame:
    """C08."""
    rows = students.select(
        F.col("Id").alias("a_sf_id"),
        F.col("Network_Student_ID__c").alias("cps_id"),
        F.lit(network).alias("network"),
        X.null_before(X.parse_date("Birthdate", "M/d/yyyy")).alias("date_of_birth"),
        X.gender_flag("Gender__c").alias("is_female"),
        X.recode("Ethnicity__c", ETHNICITY).alias("ethnicity"),
        X.as_flag("Special_Education__c").alias("ever_special_ed"),
        X.as_flag("Low_Income__c").alias("ever_free_lunch"),
        X.as_flag("First_Generation_College_Student__c").alias("is_first_gen"),
        F.col("EFC_from_FAFSA__c").alias("fafsa_efc"),
    )
    return R.add_empty_columns(rows, {"family_income_bracket": "string", "number_in_household": "int", "zip": "string"})


def contacts(contacts: DataFrame, alumni: DataFrame, as_of: date, placeholders: Sequence[str] = (), shared_schools: Sequence[str] = ()) -> DataFrame:
    """Contact notes with repaired counsellor ids.

    ``placeholders`` are the accounts that upload notes for others;
    ``shared_schools`` are the schools served by more than one counsellor.
    """
    schools = alumni.select(F.col("Id").alias("Contact__c"), _q("High School").alias("__school"))
    rows = contacts.join(schools, "Contact__c", "left")
    fixed = A.repair_by_mode(rows, "Contact__c", "__school", "CreatedById", placeholders, shared_schools, "counselor_id")
    return fixed.select(
        F.col("Contact__c").alias("a_sf_id"),
        X.null_after(X.parse_date("Date_of_Contact__c"), as_of).alias("contact_date"),
        "counselor_id",
        X.recode("Mode_of_Communication__c", MEDIUM).alias("contact_medium"),
        X.as_flag("Initiated_by_alum__c").alias("initiated_by_student"),
        F.lit(False).alias("was_outreach"),
        X.status_flag("Comm_Status__c", OUTREACH).alias("was_successful"),
    )


def aptests(tests: DataFrame, subjects: DataFrame) -> DataFrame:
    """C10."""
    rows = tests.select(
        F.col("student_number").cast("string").alias("a_powerschool_id"),
        X.parse_date("test_date").alias("date"),
        F.col("numscore").alias("score"),
        X.strip_text("testname", "AP ").alias("__name"),
    )
    return translate_text(rows, "__name", subjects, "subject").drop("__name")


def schools(accounts: DataFrame, alumni: DataFrame, founding_years: DataFrame, organization: str = "A") -> DataFrame:
    """C11: one row per school alumni went to, with its account and first class."""
    names = alumni.select(_q("High School").alias("name")).distinct()
    account = _named_accounts(accounts, names, "name").select(
        F.col("Name").alias("name"), F.col("Id").alias("a_sf_school_id"), X.whole_number("BillingPostalCode").cast("int").alias("zip")
    ).distinct()
    founded = founding_years.select("name", F.make_date(F.col("year_of_first_graduating_class").cast("int"), F.lit(1), F.lit(1)).alias("year_of_first_graduating_class"))
    rows = names.join(account, "name", "left").join(founded, "name", "left")
    rows = rows.withColumns(
        {"level": F.lit("high school"), "kind": F.lit("charter"), "parent_organization": F.lit(organization), "no_excuses": F.lit(True)}
    )
    return R.add_empty_columns(
        rows,
        {"dropout_rate": "double", "number_of_students": "int", "avg_class_size": "double", "number_of_staff": "int", "number_of_counselors": "int", "annual_budget": "double"},
    )


def _course_rows(courses: DataFrame, repairs: dict) -> DataFrame:
    """Shared first part of C12 and C14."""
    rows = R.lower_names(courses)
    grade = X.recode("grade", repairs)
    return rows.withColumns(
        {
            "honors": X.as_flag(F.col("honors").cast("string")),
            "ap": X.as_flag(F.col("ap").cast("string")),
            "storecode": X.term_number("storecode"),
            "course_name": X.strip_text(X.recode("course_name", COURSE_NAME_REPAIR), ","),
            "percent": X.number_or_null("percent", "double", X.MAX_PERCENT),
            "student_number": F.col("student_number").cast("string"),
            "schoolid": F.col("schoolid").cast("string"),
            "excludefromgpa": X.code_flag("excludefromgpa", "Yes"),
            "grade": X.matching_or_null(grade),
        }
    ).withColumn("grade_available", X.term_end("storecode", "sy"))


def gpa_by_year(courses: DataFrame, exclude_ungraded: bool = False) -> DataFrame:
    """Yearly grade averages, plain and weighted, and the usual school.

    Hours of rows without a grade stay in the denominator unless ``exclude_ungraded``.
    """
    rows = _course_rows(courses, GRADE_REPAIR_GPA).filter(~F.col("excludefromgpa"))
    points, hours = X.letter_points("grade"), F.col("potentialcrhrs").cast("double")
    bonus = F.when(F.col("ap"), AP_BONUS).otherwise(0.0) + F.when(F.col("honors"), HONORS_BONUS).otherwise(0.0)
    group = ["student_number", "sy"]
    gpa = rows.groupBy(*group).agg(
        A.weighted_ratio(points, hours, exclude_ungraded).alias("unweighted_gpa"),
        A.weighted_ratio(points + bonus, hours, exclude_ungraded).alias("weighted_gpa"),
    )
    usual = A.mode_by(rows, group, "schoolid", "a_powerschool_school_id")
    return gpa.join(usual, group, "left").select(
        F.col("student_number").alias("cps_id"), F.col("sy").alias("school_year"), "a_powerschool_school_id", "unweighted_gpa", "weighted_gpa"
    )


def gpa_cumulative(alumni: DataFrame, accounts: DataFrame) -> DataFrame:
    """C13."""
    names = alumni.select(_q("High School").alias("school"))
    used = _named_accounts(accounts, names, "school").select(F.col("Name").alias("__name"), F.col("Id").alias("a_sf_school_id")).distinct()
    rows = alumni.select(F.col("Id").alias("a_student_sf_id"), _q("High School").alias("__name"), _q("HS GPA").alias("cumulative_unweighted_gpa"))
    return rows.join(used, "__name", "left").drop("__name")


def courses(courses: DataFrame) -> DataFrame:
    """C14: cleaned course rows under their contract names."""
    return _course_rows(courses, GRADE_REPAIR).select(
        F.col("student_number").alias("cps_id"),
        F.col("schoolid").alias("a_powerschool_school_id"),
        "course_name",
        F.col("course_number").cast("string").alias("course_number"),
        F.col("sy").alias("year_taken"),
        F.col("storecode").alias("semester_taken"),
        "grade_available",
        X.whole_number(_q("grade level")).cast("int").alias("course_level"),
        F.col("potentialcrhrs").alias("credit_hours"),
        F.col("honors").alias("was_honors"),
        F.col("ap").alias("was_ap"),
        F.col("percent").alias("percent_grade"),
        F.col("grade").alias("letter_grade"),
    )


def hs_enrollment(contact: DataFrame, accounts: DataFrame) -> DataFrame:
    """C15."""
    used = _named_accounts(accounts, contact, "High_School__c").select(F.col("Name").alias("High_School__c"), F.col("Id").alias("a_sf_school_id")).distinct()
    return contact.join(used, "High_School__c", "left").select(
        F.col("Id").alias("a_sf_id"), "a_sf_school_id", F.col("HS_Class__c").alias("high_school_class")
    )
