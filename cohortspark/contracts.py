"""Table contracts: declared columns and data rules of the integrated schema.

A contract has three column groups: surrogate ids of the integrated table,
external ids of a partner table, and data shared by both.  Partner tables are
``partner_ids + data``, integrated tables ``ids + data``.  Column groups are DDL
text; rules are :class:`~cohortspark.operators.quality.Check` objects.

External id columns carry the partner profile's letter (``a_``/``b_``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.cleaning import LETTER_GRADE, MAX_IPEDS, MAX_PERCENT, ZIP_MAX, ZIP_MIN
from cohortspark.operators import quality as Q
from cohortspark.operators.labels import HALF_YEARS, STATUSES, label_name

# --- fixed values: enumerations and limits of the schema ---
EPOCH_FLOOR = date(1900, 1, 1)
BIRTH_FLOOR = date(1970, 1, 1)
TEST_LEVELS = ("PLAN", "EXPLORE", "ACT")
ATTENDANCE_TYPES = ("excused", "unexcused", "suspended", "tardy", "early_dismissal")
ETHNICITIES = (
    "Hispanic", "African American", "Caucasian", "Multicultural", "Asian",
    "American Indian", "Pacific Islander", "Unknown", "Other",
)
DEGREE_TYPES = (
    "Associates", "Associates or Certificate (TBD)", "Masters", "Bachelors",
    "Certificate", "Trade/Vocational", "Employment",
)
CONTACT_MEDIA = (
    "Call", "Email", "In Person", "Text", "Social Networking", "School Visit",
    "Mail", "IM", "Parent Contact", "College Contact",
)
SCHOOL_LEVELS = ("high school", "middle school", "6 through 12", "elementary")
SCHOOL_KINDS = ("charter", "magnet", "private", "public", "contract", "military", "selective", "special", "boarding")
COURSE_LENGTHS = ("year", "quarter", "semester", "summer")
EXIT_TYPES = ("Graduated", "Attending", "Transferred out", "Withdrew", "Matriculating", "Deferred", "Other")
MAP_SEASONS = ("FALL", "WINTER", "SPRING")
MAP_SUBJECTS = ("Reading", "Mathematics", "Language", "Science General", "Science Concepts and Processes")
APPLICATION_STATES = (
    "Accepted", "Denied", "Submitted", "Matriculated", "Withdrew Application",
    "In progress", "Waitlist", "Unknown", "Deferred",
)
WITHDRAWAL_REASONS = ("financial", "academic", "motivational", "family", "health", "social", "racial")
RECORD_ID, DISTRICT_ID = 18, 8
# -----------------------------------------------------------


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl) if ddl.strip() else T.StructType([])


def _names(ddl: str) -> list[str]:
    """Column names of a DDL text; needs no session, unlike the types."""
    return re.findall(r"(\w+) [A-Z]+(?:\([\d,]+\))?", ddl)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    parent_column: str


def _fitted(df: DataFrame, wanted: T.StructField) -> Column:
    """A column in the wanted type, null where a value does not fit; a number for a date is read as text, a year say."""
    numeric = isinstance(df.schema[wanted.name].dataType, T.NumericType) and isinstance(wanted.dataType, (T.DateType, T.TimestampType))
    c = F.col(wanted.name)
    return (c.cast("string") if numeric else c).try_cast(wanted.dataType)


@dataclass(frozen=True)
class TableContract:
    """Declared columns, row rules, unique keys and references of one table."""

    name: str
    ids: str = ""
    partner_ids: str = ""
    data: str = ""
    checks: Sequence[Q.Check] = ()
    primary: Sequence[Sequence[str]] = ()
    unique: Sequence[Sequence[str]] = ()
    references: Sequence[ForeignKey] = field(default_factory=tuple)

    def common_schema(self) -> T.StructType:
        return T.StructType(_struct(self.ids).fields + _struct(self.data).fields)

    def partner_schema(self) -> T.StructType:
        return T.StructType(_struct(self.partner_ids).fields + _struct(self.data).fields)

    def data_columns(self) -> list[str]:
        return _names(self.data)

    def id_columns(self) -> list[str]:
        return _names(self.ids)

    def conform(self, df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        """Cast to the contract's types in its column order; absent columns become null.

        Values that do not fit a type become null and never abort the job;
        :meth:`lost_values` reports each of them.
        """
        schema = schema or self.partner_schema()
        have = set(df.columns)
        return df.select(*[(_fitted(df, f) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

    def lost_values(self, df: DataFrame, key: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
        """``(table, rule, key, value)`` for every known value that :meth:`conform` turns into null."""
        have = set(df.columns)
        cells = [
            F.when(
                F.col(f.name).isNotNull() & _fitted(df, f).isNull(),
                F.struct(F.lit(f"{f.name}: fits {f.dataType.simpleString()}").alias("rule"), F.col(f.name).cast("string").alias("value")),
            )
            for f in (schema or self.partner_schema()).fields
            if f.name in have
        ]
        if not cells:
            return df.sparkSession.createDataFrame([], "table string, rule string, key string, value string")
        name = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
        found = df.select(name.alias("key"), F.explode(F.array_compact(F.array(*cells))).alias("c"))
        return found.select(F.lit(self.name).alias("table"), "c.rule", "key", "c.value")

    def violations(self, df: DataFrame, key: Sequence[str], as_of: date, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """All broken rules of a frame: ``(table, rule, key, value)``."""
        have = set(df.columns)
        parts = []
        checks = [c for c in self.checks if c.column in have]
        if checks:
            parts.append(Q.row_violations(df, self.name, key, checks, as_of))
        for group, primary in [(u, False) for u in self.unique] + [(p, True) for p in self.primary]:
            if set(group) <= have:
                parts.append(Q.unique_violations(df, self.name, group, primary))
        for fk in self.references:
            if parents and fk.table in parents and fk.column in have:
                parts.append(Q.fk_violations(df, self.name, key, fk.column, parents[fk.table], fk.parent_column))
        if not parts:
            return df.sparkSession.createDataFrame([], "table string, rule string, key string, value string")
        return Q.all_violations(parts)


def warehouse_violations(
    tables: Mapping[str, DataFrame], as_of: date, keys: Mapping[str, Sequence[str]], parents: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Q01-Q10 over many tables: ``(table, rule, key, value)`` of everything that breaks its contract.

    A table's row rules share one scan, and all references to one parent, from
    whatever table, one anti join.  ``keys`` names the columns that show a row;
    ``parents`` adds tables that are referred to but not checked.
    """
    known = {**(parents or {}), **tables}
    parts, refs = [], {}
    for name, df in tables.items():
        contract, key = CONTRACTS[name], keys[name]
        parts.append(replace(contract, references=()).violations(df, key, as_of))
        wanted: dict[tuple[str, str], list[str]] = {}
        for fk in contract.references:
            if fk.table in known and fk.column in df.columns:
                wanted.setdefault((fk.table, fk.parent_column), []).append(fk.column)
        for parent, columns in wanted.items():
            refs.setdefault(parent, []).append(Q.references(df, name, key, columns))
    parts += [Q.probe(found, known[table], column) for (table, column), found in refs.items()]
    return Q.all_violations(parts)


def _record_ids(*columns: str) -> list[Q.Check]:
    return [Q.has_length(c, RECORD_ID) for c in columns]


def _district_ids(*columns: str) -> list[Q.Check]:
    return [Q.has_length(c, DISTRICT_ID) for c in columns]


STUDENT_REF = ForeignKey("studentid", "studentid", "studentid")
SCHOOL_REF = ForeignKey("schoolid", "schoolid", "schoolid")
COLLEGE_REF = ForeignKey("collegeid", "collegeid", "collegeid")
_COMPOSITE = "score_composite = round((score_english + score_math + score_reading + score_science + 0.0001) / 4)"
_TOTAL = "score_total = score_reading + score_math + score_writing"

CONTRACTS: dict[str, TableContract] = {
    c.name: c
    for c in (
        TableContract(
            "studentid",
            ids="studentid BIGINT",
            data="a_sf_id STRING, b_sf_id STRING, b_powerschool_id STRING, cps_id STRING",
            checks=[*_record_ids("a_sf_id", "b_sf_id"), *_district_ids("cps_id")],
            primary=[["studentid"]],
            unique=[["a_sf_id"], ["b_sf_id"], ["b_powerschool_id"], ["cps_id"]],
        ),
        TableContract(
            "schoolid",
            ids="schoolid BIGINT",
            data="b_sf_school_id STRING, a_sf_school_id STRING, a_powerschool_id STRING",
            checks=[*_record_ids("b_sf_school_id", "a_sf_school_id"), Q.max_length("a_powerschool_id", 8)],
            primary=[["schoolid"]],
            unique=[["b_sf_school_id"], ["a_sf_school_id"], ["a_powerschool_id"]],
        ),
        TableContract(
            "collegeid",
            ids="collegeid BIGINT",
            data="a_sf_college_id STRING, ipedsid INT",
            checks=[*_record_ids("a_sf_college_id"), Q.not_null("a_sf_college_id"), Q.in_range("ipedsid", 0, MAX_IPEDS)],
            primary=[["collegeid"]],
            unique=[["a_sf_college_id"], ["ipedsid"]],
        ),
        TableContract(
            "acttests",
            ids="studentid BIGINT",
            partner_ids="b_sf_id STRING, cps_id STRING",
            data="date DATE, test_level STRING, test_semester STRING, score_composite INT, score_english INT, score_math INT, "
            "score_reading INT, score_science INT, score_writing INT, onlyhighestavailable BOOLEAN",
            checks=[
                *_record_ids("b_sf_id"), *_district_ids("cps_id"), Q.not_null("studentid"),
                Q.not_after_today("date"), Q.one_of("test_level", TEST_LEVELS), Q.one_of("test_semester", ("Fall", "Spring")),
                *[Q.in_range(f"score_{s}", 1, 36) for s in ("composite", "english", "math", "reading", "science", "writing")],
                Q.satisfies("score_composite", "rounded mean of four", _COMPOSITE),
                Q.not_null("onlyhighestavailable"),
            ],
            references=[STUDENT_REF],
        ),
        TableContract(
            "aptests",
            ids="studentid BIGINT",
            partner_ids="a_powerschool_id STRING",
            data="date DATE, score INT, subject STRING",
            checks=[*_district_ids("a_powerschool_id"), Q.not_null("studentid"), Q.not_after_today("date"), Q.in_range("score", 1, 5), Q.max_length("subject", 37)],
            references=[STUDENT_REF, ForeignKey("subject", "lookup_apsubjects", "name")],
        ),
        TableContract(
            "attendance",
            ids="studentid BIGINT, schoolid BIGINT",
            partner_ids="student_cps_id STRING, school_a_powerschoolid STRING, b_sf_id STRING, b_sf_school_id STRING",
            data="attendance_date DATE, school_year INT, attendance_type STRING",
            checks=[
                *_district_ids("student_cps_id"), *_record_ids("b_sf_id", "b_sf_school_id"),
                Q.after("attendance_date", EPOCH_FLOOR), Q.not_after_today("attendance_date"),
                Q.in_range("school_year", 1950, None, open_lower=True), Q.year_before("school_year", 1),
                Q.one_of("attendance_type", ATTENDANCE_TYPES),
            ],
            references=[STUDENT_REF, SCHOOL_REF],
        ),
        TableContract(
            "students",
            ids="studentid BIGINT",
            partner_ids="b_sf_id STRING, a_sf_id STRING, cps_id STRING, b_powerschool_id STRING",
            data="network STRING, date_of_birth DATE, ethnicity STRING, is_female BOOLEAN, ever_special_ed BOOLEAN, ever_free_lunch BOOLEAN, "
            "family_income_bracket STRING, number_in_household INT, is_first_gen BOOLEAN, street STRING, zip STRING, fafsa_efc DOUBLE",
            checks=[
                *_record_ids("b_sf_id", "a_sf_id"), *_district_ids("cps_id"), Q.max_length("b_powerschool_id", 20), Q.not_null("studentid"),
                Q.after("date_of_birth", BIRTH_FLOOR), Q.one_of("ethnicity", ETHNICITIES), Q.max_length("family_income_bracket", 15), Q.has_length("zip", 5),
            ],
            unique=[["studentid"]],
            references=[STUDENT_REF],
        ),
        TableContract(
            "enrollments",
            ids="enrollid BIGINT, studentid BIGINT, collegeid BIGINT",
            partner_ids="a_student_sf_id STRING, b_sf_id STRING, ipedsid INT, a_college_sf_id STRING",
            data="start_date DATE, end_date DATE, date_last_verified DATE, status STRING, data_source STRING, living_on_campus BOOLEAN, "
            "degree_type STRING, degree_subject STRING, major STRING, "
            + ", ".join(f"withdrawal_reason_{r} BOOLEAN" for r in WITHDRAWAL_REASONS),
            checks=[
                *_record_ids("a_student_sf_id", "b_sf_id", "a_college_sf_id"), Q.in_range("ipedsid", 0, MAX_IPEDS),
                Q.one_of("status", STATUSES), Q.one_of("degree_type", DEGREE_TYPES),
            ],
            primary=[["enrollid"]],
            references=[
                STUDENT_REF, COLLEGE_REF,
                ForeignKey("degree_subject", "lookup_collegedegrees", "name"), ForeignKey("major", "lookup_majors", "name"),
            ],
        ),
        TableContract(
            "enrollment_dummies",
            data="enrollid BIGINT, studentid BIGINT, collegeid BIGINT, " + ", ".join(f"{label_name(n)} BOOLEAN" for n in HALF_YEARS),
            unique=[["enrollid"]],
            references=[ForeignKey("enrollid", "enrollments", "enrollid"), STUDENT_REF, COLLEGE_REF],
        ),
        TableContract(
            "contacts",
            ids="studentid BIGINT",
            partner_ids="b_sf_id STRING, a_sf_id STRING",
            data="contact_date DATE, counselor_id STRING, contact_medium STRING, initiated_by_student BOOLEAN, was_outreach BOOLEAN, was_successful BOOLEAN",
            checks=[
                *_record_ids("b_sf_id", "a_sf_id"), Q.not_null("studentid"), Q.after("contact_date", EPOCH_FLOOR),
                Q.not_after_today("contact_date"), Q.one_of("contact_medium", CONTACT_MEDIA),
            ],
            references=[STUDENT_REF],
        ),
        TableContract(
            "schools",
            ids="schoolid BIGINT",
            partner_ids="a_sf_school_id STRING, b_sf_school_id STRING",
            data="name STRING, level STRING, kind STRING, parent_organization STRING, no_excuses BOOLEAN, zip INT, "
            "year_of_first_graduating_class DATE, dropout_rate DECIMAL(5,2), number_of_students INT, avg_class_size DECIMAL(6,2), "
            "number_of_staff INT, number_of_counselors INT, annual_budget DECIMAL(11,2)",
            checks=[
                *_record_ids("a_sf_school_id", "b_sf_school_id"), Q.not_null("schoolid"), Q.not_null("name"), Q.not_null("level"),
                Q.max_length("name", 120), Q.one_of("level", SCHOOL_LEVELS), Q.one_of("kind", SCHOOL_KINDS), Q.max_length("parent_organization", 20),
                Q.in_range("zip", ZIP_MIN, ZIP_MAX), Q.after("year_of_first_graduating_class", date(1000, 1, 1)),
                Q.in_range("dropout_rate", 0, 100),
                *[Q.in_range(c, 0) for c in ("number_of_students", "avg_class_size", "number_of_staff", "number_of_counselors")],
            ],
            unique=[["schoolid"]],
            references=[SCHOOL_REF],
        ),
        TableContract(
            "courses",
            ids="studentid BIGINT, schoolid BIGINT",
            partner_ids="cps_id STRING, a_powerschool_school_id STRING, b_sf_id STRING, b_sf_school_id STRING",
            data="course_name STRING, course_number STRING, teacher_id STRING, year_taken INT, semester_taken INT, grade_available DATE, "
            "course_length STRING, course_level INT, credit_hours DECIMAL(18,6), was_honors BOOLEAN, was_ap BOOLEAN, percent_grade DECIMAL(18,6), letter_grade STRING",
            checks=[
                *_record_ids("b_sf_id", "b_sf_school_id"), Q.in_range("year_taken", 1000, None, open_lower=True), Q.year_before("year_taken"),
                Q.in_range("semester_taken", 1, 3), Q.after("grade_available", EPOCH_FLOOR), Q.before_months_ahead("grade_available", 6),
                Q.one_of("course_length", COURSE_LENGTHS), Q.in_range("percent_grade", 0, MAX_PERCENT), Q.matches("letter_grade", LETTER_GRADE),
            ],
            references=[STUDENT_REF, SCHOOL_REF],
        ),
        TableContract(
            "gpa_by_year",
            ids="studentid BIGINT, schoolid BIGINT",
            partner_ids="cps_id STRING, a_powerschool_school_id STRING, b_sf_id STRING, b_sf_school_id STRING",
            data="school_year INT, weighted_gpa DECIMAL(18,6), unweighted_gpa DECIMAL(18,6)",
            checks=[
                *_district_ids("cps_id"), Q.has_length("a_powerschool_school_id", 4), *_record_ids("b_sf_id", "b_sf_school_id"),
                Q.in_range("weighted_gpa", 0), Q.in_range("unweighted_gpa", 0),
            ],
            references=[STUDENT_REF, SCHOOL_REF],
        ),
        TableContract(
            "gpa_cumulative",
            ids="studentid BIGINT, schoolid BIGINT",
            partner_ids="a_student_sf_id STRING, a_sf_school_id STRING, b_sf_id STRING, b_sf_school_id STRING",
            data="cumulative_weighted_gpa DECIMAL(18,6), cumulative_unweighted_gpa DECIMAL(18,6)",
            checks=[
                *_record_ids("a_student_sf_id", "a_sf_school_id", "b_sf_id", "b_sf_school_id"),
                Q.in_range("cumulative_weighted_gpa", 0), Q.in_range("cumulative_unweighted_gpa", 0),
            ],
            unique=[["studentid"]],
            references=[STUDENT_REF, SCHOOL_REF],
        ),
        TableContract(
            "colleges",
            ids="collegeid BIGINT",
            partner_ids="a_sf_college_id STRING, ipedid STRING",
            data="isprivate BOOLEAN, isforprofit BOOLEAN, is4year BOOLEAN, zip INT, name STRING, isrural BOOLEAN, allmale BOOLEAN, allfemale BOOLEAN, "
            "graduationrate_6yr DOUBLE, graduationrate_minority_6yr DOUBLE, transferrate_6yr DOUBLE, transferrate_minority_6yr DOUBLE, "
            "historicallyblack BOOLEAN, state STRING, longitude DECIMAL(18,6), latitude DECIMAL(18,6), dist_from_chicago DECIMAL(18,6), "
            "barrons_rating STRING, perc_accepted DOUBLE, perc_accepted_enroll DOUBLE, perc_male DOUBLE, perc_female DOUBLE, "
            "perc_african_american DOUBLE, perc_hispanic DOUBLE, percentinstate DOUBLE, percentoutofstate DOUBLE, percentpellgrant DOUBLE, "
            "avgnetprice DOUBLE, netprice0_30 DOUBLE, netprice30_48 DOUBLE, netprice48_75 DOUBLE, locale STRING, size_range STRING",
            checks=[
                *_record_ids("a_sf_college_id"), Q.has_length("ipedid", 6), Q.not_null("collegeid"), Q.in_range("zip", ZIP_MIN, ZIP_MAX), Q.max_length("name", 70),
                *[Q.in_range(c, 0, 100) for c in ("graduationrate_6yr", "graduationrate_minority_6yr", "transferrate_6yr", "transferrate_minority_6yr")],
                Q.max_length("state", 2), Q.max_length("barrons_rating", 30),
            ],
            unique=[["collegeid"]],
            references=[COLLEGE_REF],
        ),
        TableContract(
            "hs_enrollment",
            ids="studentid BIGINT, schoolid BIGINT",
            partner_ids="a_sf_id STRING, a_sf_school_id STRING, b_sf_id STRING, b_sf_school_id STRING",
            data="start_date DATE, end_date DATE, exit_type STRING, high_school_class INT",
            checks=[
                *_record_ids("a_sf_id", "a_sf_school_id", "b_sf_id", "b_sf_school_id"),
                Q.after("start_date", EPOCH_FLOOR), Q.not_after_today("start_date", -1), Q.one_of("exit_type", EXIT_TYPES),
                Q.in_range("high_school_class", 1950, None, open_lower=True), Q.year_before("high_school_class", 10),
            ],
            references=[STUDENT_REF, SCHOOL_REF],
        ),
        TableContract(
            "discipline",
            ids="studentid BIGINT, schoolid BIGINT",
            data="date DATE, type STRING, severity INT, consequence_severity INT",
            checks=[
                Q.not_null("studentid"), Q.not_null("schoolid"), Q.in_range("date", date(1980, 1, 1)), Q.not_after_today("date"),
                Q.in_range("severity", 0, 5), Q.in_range("consequence_severity", 0, 5),
            ],
            references=[STUDENT_REF, SCHOOL_REF, ForeignKey("type", "lookup_disciplinetypes", "name")],
        ),
        TableContract(
            "maptests",
            data="academicyear INT, season STRING, subject STRING, score INT, nationalpercentileranking INT",
            checks=[
                Q.year_before("academicyear", 0, inclusive=True), Q.one_of("season", MAP_SEASONS), Q.one_of("subject", MAP_SUBJECTS),
                Q.in_range("nationalpercentileranking", 0, 100, open_lower=True),
            ],
        ),
        TableContract(
            "sattests",
            data="date DATE, score_reading INT, score_math INT, score_writing INT, score_total INT, onlyhighestavailable BOOLEAN",
            checks=[
                Q.not_after_today("date"),
                *[c for s in ("reading", "math", "writing") for c in (Q.in_range(f"score_{s}", 200, 800), Q.multiple_of(f"score_{s}", 10))],
                Q.satisfies("score_total", "sum of three", _TOTAL), Q.not_null("onlyhighestavailable"),
            ],
        ),
        TableContract(
            "applications",
            ids="studentid BIGINT, collegeid BIGINT",
            data="date_of_initial_interest DATE, was_early_decision BOOLEAN, was_accepted BOOLEAN, application_status STRING",
            checks=[
                Q.not_null("studentid"), Q.not_null("collegeid"), Q.after("date_of_initial_interest", EPOCH_FLOOR),
                Q.not_after_today("date_of_initial_interest"), Q.one_of("application_status", APPLICATION_STATES),
            ],
            references=[STUDENT_REF, COLLEGE_REF],
        ),
    )
}

#: One-column lookup tables.
LOOKUPS = ("lookup_collegedegrees", "lookup_majors", "lookup_apsubjects", "lookup_disciplinetypes")
LOOKUP_CONTRACT = TableContract("lookup", data="name STRING", primary=[["name"]])
