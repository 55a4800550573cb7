"""Cleaning and integration jobs run on raw partner feeds derived from the given tables.

Each raw feed is one SQL text both engines understand, shaped like a partner
export (codes, nulls, bad values, text dates).  Columns whose raw names contain
blanks or symbols are renamed on the Spark side before the cleaner sees them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cohortspark.contracts import CONTRACTS
from cohortspark.contracts import warehouse_violations as warehouse_contracts
from cohortspark.plans import integration as I
from cohortspark.plans import profile_a as PA
from cohortspark.plans import profile_b as PB
from cohortspark.session import stored
from cohortspark.sources.readers import mapping_frame
from queries.base import AS_OF, ORACLES, VIEWS, oracle, query, raw, view

_TEXT_DATE = "CAST(month({d}) AS STRING) || '/' || CAST(day({d}) AS STRING) || '/' || CAST(year({d}) AS STRING)"
_BORN = "DATE '1965-01-01' + CAST(c_custkey % 4000 AS INT)"


def _id(letter: str, key: str) -> str:
    return f"'{letter}' || lpad(CAST({key} AS STRING), 17, '0')"


VIEWS |= {
    "raw_a_students": f"""
SELECT c_custkey AS k, {_id('A', 'c_custkey')} AS Id, lpad(CAST(c_custkey AS STRING), 8, '0') AS Network_Student_ID__c,
  {_TEXT_DATE.format(d=_BORN)} AS Birthdate, {_BORN} AS born,
  CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'Female' WHEN 2 THEN 'M' WHEN 3 THEN 'Male' END AS Gender__c,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'Multi-Cultural' WHEN 'HOUSEHOLD' THEN NULL ELSE 'Asian' END AS Ethnicity__c,
  CASE WHEN c_custkey % 3 = 0 THEN 'true' WHEN c_custkey % 3 = 1 THEN 'false' END AS Special_Education__c,
  CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END AS Low_Income__c,
  CASE WHEN c_custkey % 7 = 0 THEN 'true' END AS First_Generation_College_Student__c,
  c_acctbal AS EFC_from_FAFSA__c,
  CASE WHEN c_custkey % 9 <> 0 THEN 'School ' || CAST(c_nationkey AS STRING) END AS High_School__c,
  1998 + c_custkey % 4 AS HS_Class__c,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal / 2500 END AS gpa
FROM {{customer}}""",
    "raw_accounts": f"""
SELECT {_id('S', 'n_nationkey')} AS Id, CASE WHEN n_nationkey % 10 = 3 THEN 'Closed ' ELSE 'School ' END || CAST(n_nationkey AS STRING) AS Name,
  60600 + n_nationkey AS BillingPostalCode FROM {{nation}}""",
    "raw_school_codes": """
SELECT 'School ' || CAST(n_nationkey AS STRING) AS Campus, lpad(CAST(n_nationkey * 37 AS STRING), 4, '0') AS code,
  1990 + n_nationkey % 20 AS first_class FROM {nation}""",
    "raw_a_colleges": f"""
SELECT {_id('C', 's_suppkey')} AS college_id, CASE WHEN s_suppkey % 8 <> 0 THEN CAST(100000 + s_suppkey AS DOUBLE) END AS NCESid__c,
  CASE s_suppkey % 6 WHEN 0 THEN 'Private not-for-profit 4-year' WHEN 1 THEN 'Private for-profit 2-year' WHEN 2 THEN 'Public 4-year or above'
    WHEN 3 THEN 'Public less than 2-year' WHEN 4 THEN 'Other' END AS College_Type__c,
  CASE WHEN s_suppkey % 4 = 0 THEN CAST(60000 + s_suppkey AS STRING) || '-1234' WHEN s_suppkey % 4 = 1 THEN CAST(60000 + s_suppkey AS STRING)
    WHEN s_suppkey % 4 = 2 THEN 'K1A ' || CAST(s_suppkey AS STRING) END AS ShippingPostalCode,
  s_name || ', Inc' AS Name, CAST(s_suppkey % 101 AS DOUBLE) AS rate, s_suppkey % 17 = 0 AS hbcu, s_suppkey AS k
FROM {{supplier}}""",
    "raw_a_extra": """
SELECT 100000 + s_suppkey AS UNITID, 'IL' AS STABBR, CAST(s_nationkey AS DOUBLE) AS coord,
  CASE s_suppkey % 3 WHEN 0 THEN 'Not Available' WHEN 1 THEN 'Competitive' ELSE '2 year (Competitive)' END AS SimpleBarrons,
  CAST(s_suppkey % 100 AS STRING) || '%' AS pct, CASE WHEN s_suppkey % 2 = 0 THEN 'Not reported' ELSE '1,000 - 4,999' END AS size_text
FROM {supplier}""",
    "raw_a_tests": f"""
SELECT lpad(CAST(o.o_custkey AS STRING), 8, '0') AS student_number, CAST(l.l_shipdate AS DATE) AS d,
  CASE l.l_linenumber % 3 WHEN 0 THEN 'act' WHEN 1 THEN 'Plan' ELSE 'EXPLORE' END AS testname_clean,
  CASE l.l_returnflag WHEN 'A' THEN 'Pre' WHEN 'R' THEN 'Post' ELSE 'Mid' END AS timeperiod,
  1 + CAST(l.l_quantity AS INT) % 36 AS score, l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey""",
    "raw_a_attendance": """
SELECT lpad(CAST(o.o_custkey AS STRING), 8, '0') AS STUDENT_NUMBER, l.l_suppkey AS SCHOOLID, CAST(l.l_shipdate AS DATE) AS d, year(l.l_shipdate) AS SY,
  CASE l.l_partkey % 16 WHEN 0 THEN 'X' WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'T' WHEN 4 THEN 'T0' WHEN 5 THEN 'L5' WHEN 6 THEN 'A' WHEN 7 THEN 'R'
    WHEN 8 THEN 'E' WHEN 9 THEN 'E0' WHEN 10 THEN 'F' WHEN 11 THEN 'G' WHEN 12 THEN 'H5' WHEN 13 THEN 'H1' WHEN 14 THEN 'ZZ' END AS ATT_CODE,
  CASE l.l_linenumber WHEN 1 THEN 'Late' WHEN 2 THEN 'Late Arrival Excused' WHEN 3 THEN 'Present' END AS DESCRIPTION,
  l.l_orderkey AS ok, l.l_linenumber AS ln
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "raw_a_enrolments": f"""
SELECT o.o_orderkey AS ok, {_id('A', 'o.o_custkey')} AS Student__c, {_id('C', 'l.sk')} AS College__c, CAST(o.o_orderdate AS DATE) AS s,
  CAST(o.o_orderdate AS DATE) + CAST(l.q AS INT) * 60 AS e,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Graduated' WHEN 1 THEN 'Withdrew' WHEN 2 THEN 'Transferred out' WHEN 3 THEN 'Attending' WHEN 4 THEN 'Matriculating' ELSE 'Did not matriculate' END AS Status__c,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'Bachelors' WHEN o.o_orderkey % 4 = 1 THEN 'Associate''s' ELSE 'Master''s' END AS Degree_Type__c,
  CASE o.o_orderkey % 5 WHEN 0 THEN '  ba ' WHEN 1 THEN 'B.  S.' WHEN 2 THEN 'nursing' WHEN 3 THEN 'unheard of' END AS Degree_Text__c,
  o.o_orderpriority AS Major_Text__c,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Financial;Health' WHEN 1 THEN 'Racial Conflict' WHEN 2 THEN 'Financially' END AS Withdrawal_code__c
FROM {{orders}} o LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS q, min(l_suppkey) AS sk FROM {{lineitem}} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    "raw_a_notes": f"""
SELECT event_id, user_id, {_id('A', 'user_id')} AS Contact__c, CASE WHEN event_type = 'signup' THEN 'true' ELSE 'false' END AS Initiated_by_alum__c,
  CAST(ts AS DATE) AS d, CASE event_type WHEN 'click' THEN 'Phone' WHEN 'view' THEN 'Mail (letter/postcard)' WHEN 'error' THEN NULL ELSE 'Email' END AS Mode_of_Communication__c,
  CASE WHEN value < 5 THEN 'Outreach only' WHEN value < 10 THEN NULL ELSE 'Reached' END AS Comm_Status__c,
  CASE WHEN event_id % 3 = 0 THEN 'BATCH' ELSE regexp_extract(props, '[0-9]+', 0) END AS CreatedById
FROM {{events}}""",
    "raw_a_courses": """
SELECT lpad(CAST(o.o_custkey AS STRING), 8, '0') AS student_number, lpad(CAST((l.l_suppkey % 25) * 37 AS STRING), 4, '0') AS schoolid, year(l.l_shipdate) AS sy,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'S1' WHEN 1 THEN 'Q3' WHEN 2 THEN 's3' ELSE '2' END AS storecode,
  CASE WHEN l.l_partkey % 50 = 0 THEN 'Comuter Programming' ELSE 'Course, ' || CAST(l.l_partkey AS STRING) END AS course_name,
  l.l_partkey AS course_number, l.l_quantity * 3 AS percent,
  CASE l.l_partkey % 12 WHEN 0 THEN 'A+' WHEN 1 THEN 'A' WHEN 2 THEN 'B-' WHEN 3 THEN 'p' WHEN 4 THEN ' P' WHEN 5 THEN 'c+' WHEN 6 THEN 'd' WHEN 7 THEN 'F'
    WHEN 8 THEN '??' WHEN 9 THEN 'I' WHEN 10 THEN 'C' END AS grade,
  CAST(l.l_returnflag = 'R' AS INT) AS honors, CAST(l.l_returnflag = 'A' AS INT) AS ap,
  CASE WHEN l.l_linenumber = 6 THEN 'Yes' WHEN l.l_linenumber = 5 THEN 'No' END AS excludefromgpa,
  1 + CAST(l.l_linenumber % 3 AS DOUBLE) / 2 AS potentialcrhrs, CAST(9 + l.l_linenumber % 4 AS DOUBLE) AS grade_level, l.l_orderkey AS ok, l.l_linenumber AS ln
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "raw_b_students": f"""
SELECT {_id('B', 'c_custkey')} AS contact_id, c_custkey - c_custkey % 10 + CASE WHEN c_custkey % 10 = 9 THEN 8 ELSE c_custkey % 10 END AS powerschool_id, c_name AS name,
  CAST(NULL AS STRING) AS cps_id, CAST({_BORN} AS STRING) AS date_of_birth, {_BORN} AS born,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'H' ELSE c_mktsegment END AS ethnicity, c_custkey % 2 = 0 AS is_female, c_custkey % 3 = 0 AS ever_special_ed,
  c_acctbal < 0 AS ever_free_lunch, '$1,000 - $' || CAST(c_nationkey AS STRING) AS family_income_bracket,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(1 + c_custkey % 7 AS DOUBLE) END AS number_in_household, c_custkey % 5 = 0 AS is_first_gen,
  CASE WHEN c_custkey % 6 <> 0 THEN CAST(7000 + c_custkey * 3 AS DOUBLE) END AS zip, c_acctbal AS fafsa_efc
FROM {{customer}}""",
    "raw_b_enrolments": f"""
SELECT o_orderkey AS ok, {_id('B', 'o_custkey')} AS student_salesforce_id, {_id('T', 'o_custkey % 25')} AS college_salesforce_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 1 THEN '1234567' ELSE CAST(100000 + o_custkey AS STRING) END AS college_ncesid,
  CASE o_orderkey % 8 WHEN 0 THEN 'Other' WHEN 1 THEN 'Deferred' WHEN 2 THEN 'Withdrawn' WHEN 3 THEN 'Matriculated' WHEN 4 THEN 'Graduated' WHEN 5 THEN NULL ELSE 'Attending' END AS status,
  CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 400 AS e,
  CASE o_orderkey % 5 WHEN 0 THEN 'Bachelor''s (4-year)' WHEN 1 THEN 'High School Diploma' WHEN 2 THEN 'Certificate' WHEN 3 THEN NULL ELSE 'Master''s' END AS degree_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'Life Sciences' WHEN 1 THEN 'Fine Arts' ELSE 'Undecided' END AS degree_subject,
  o_orderpriority AS major, CASE o_orderkey % 9 WHEN 0 THEN 'Academic' WHEN 1 THEN 'Financial' WHEN 2 THEN 'Career' WHEN 3 THEN 'Social' END AS transfer_reason__c,
  'feed' AS data_source, o_orderkey % 2 = 0 AS living_on_campus
FROM {{orders}}""",
    "raw_b_contacts": f"""
SELECT event_id, {_id('B', 'user_id')} AS student_salesforce_id, CAST(ts AS DATE) AS d, event_id % 400000 AS seconds, regexp_extract(props, '[0-9]+', 0) AS counselor_id,
  CASE event_type WHEN 'click' THEN 'Phone' WHEN 'view' THEN 'College staff contact' ELSE 'Text' END AS contact_medium,
  event_type = 'signup' AS initiated_by_student, CASE WHEN value > 20 THEN TRUE END AS was_successful
FROM {{events}}""",
    "raw_b_tests": f"""
SELECT {_id('B', 'o.o_custkey')} AS student_salesforce_id, CAST(l.l_shipdate AS DATE) AS d, 'ACT' AS test_level, 1 + l.l_quantity / 2 AS score,
  CASE WHEN l.l_linenumber <> 2 THEN l.l_quantity END AS writing, l.l_orderkey AS ok, l.l_linenumber AS ln
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey""",
    "raw_b_schools": f"""
SELECT {_id('T', 's_suppkey')} AS school_salesforce_id, s_name || ', ' AS name,
  CASE s_suppkey % 6 WHEN 0 THEN 'Partner B Public' WHEN 1 THEN 'Charter' WHEN 2 THEN 'Private Magnet' WHEN 3 THEN 'Public' WHEN 4 THEN 'Unknown' END AS kind,
  CASE s_suppkey % 3 WHEN 0 THEN 'Elementary School' WHEN 1 THEN 'High School' END AS level, 'was here' AS parent_organization,
  s_suppkey % 2 = 0 AS no_excuses, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(70000 + s_suppkey * 999 AS STRING) END AS zip, s_nationkey AS size
FROM {{supplier}}""",
    "raw_b_courses": f"""
SELECT {_id('B', 'o.o_custkey')} AS student_salesforce_id, {_id('T', 'l.l_suppkey')} AS school_salesforce_id, 'c' || CAST(l.l_partkey AS STRING) AS course_name,
  year(l.l_shipdate) AS year_taken, CASE WHEN l.l_linenumber <> 3 THEN l.l_quantity * 3 END AS percent_grade,
  CASE WHEN l.l_linenumber = 1 THEN ' B +' ELSE 'A ' END AS letter_grade, l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey AS pk
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey""",
    "raw_b_attendance": f"""
SELECT {_id('B', 'o.o_custkey')} AS student_salesforce_id, l.l_suppkey AS powerschool_id, CAST(l.l_shipdate AS DATE) AS d, year(l.l_shipdate) AS school_year,
  CASE l.l_partkey % 8 WHEN 0 THEN 'Tardy Excused' WHEN 1 THEN 'Suspension' WHEN 2 THEN 'Undocumented' WHEN 3 THEN 'Documented' WHEN 4 THEN 'Early Absent'
    WHEN 5 THEN 'Early leave' WHEN 6 THEN 'here' END AS attendance_type, l.l_orderkey AS ok, l.l_linenumber AS ln
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey""",
    "raw_b_gpa": f"""
SELECT {_id('B', 'o_custkey')} AS student_salesforce_id, {_id('T', 'o_custkey % 25')} AS school_salesforce_id, year(o_orderdate) AS school_year,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 97003 END AS weighted_gpa, o_totalprice / 123457 AS unweighted_gpa
FROM {{orders}}""",
    "raw_foundation": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS Id, CAST(l_shipdate AS DATE) AS d,
  CASE WHEN l_returnflag = 'A' THEN 'ACT' ELSE 'SAT' END AS Test_Type__c, CAST(CAST(l_quantity AS INT) % 37 AS DOUBLE) AS score, CAST(CAST(l_tax * 100 AS INT) AS DOUBLE) AS english
FROM {lineitem}""",
}


def _maps(spark, sf):
    """Translation tables derived from the data: priorities as majors, a few degree texts."""
    o = raw(spark, sf, "orders").select("o_orderpriority").distinct()
    majors = mapping_frame(
        o.select(F.col("o_orderpriority").alias("r"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("s"), F.lit(1).alias("line"))
        .filter("r <> '5-LOW'"), "r", "s",
    )
    names = F.when(F.col("o_orderpriority") == "1-URGENT", F.struct(F.lit("BA").alias("r"), F.lit("BACHELOR ARTS").alias("s"))).when(
        F.col("o_orderpriority") == "2-HIGH", F.struct(F.lit("B. S.").alias("r"), F.lit("BACHELOR SCIENCE").alias("s"))
    ).when(F.col("o_orderpriority") == "5-LOW", F.struct(F.lit("Nursing").alias("r"), F.lit("").alias("s")))
    degrees = mapping_frame(o.select(names.alias("x"), F.lit(1).alias("line")).filter("x IS NOT NULL").select("x.r", "x.s", "line"), "r", "s")
    return majors, degrees


_MAJOR = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} = '5-LOW' THEN 'OTHER' ELSE split_part({c}, '-', 2) END"


def _alumni(spark, sf):
    return view(spark, sf, "raw_a_students").select("Id", F.col("High_School__c").alias("High School"), F.col("gpa").alias("HS GPA"))


# --- profile A ----------------------------------------------------------------------

@query("job_a_studentid", oracle("raw_a_students", "SELECT Id AS a_sf_id, Network_Student_ID__c AS cps_id FROM raw_a_students"))
def job_a_studentid(spark, sf):
    """C01."""
    return PA.studentid(view(spark, sf, "raw_a_students"))


_BLOCKED = ("C00000000000000003", "C00000000000000005")
_BLOCKED_SQL = ", ".join(f"'{b}'" for b in _BLOCKED)


def _college_database(spark, sf):
    c = view(spark, sf, "raw_a_colleges").withColumnRenamed("college_id", "College ID").withColumn("HBCU__c", F.col("hbcu").cast("string"))
    return c.withColumns({f"6_yr_{x}__c": F.col("rate") for x in ("completion_rate", "minority_completion_rate", "transfer_rate", "minority_transfer_rate")})


@query(
    "job_a_collegeid",
    oracle("raw_a_colleges", f"SELECT college_id AS a_sf_college_id, CAST(NCESid__c AS BIGINT) AS ipedsid FROM raw_a_colleges WHERE college_id NOT IN ({_BLOCKED_SQL})"),
)
def job_a_collegeid(spark, sf):
    """C02."""
    return PA.collegeid(_college_database(spark, sf), _BLOCKED)


@query(
    "job_a_schoolid",
    oracle(
        "raw_a_students raw_accounts raw_school_codes",
        "SELECT a.Id AS a_sf_school_id, s.code AS a_powerschool_id FROM raw_accounts a JOIN raw_school_codes s ON a.Name = s.Campus WHERE a.Name IN (SELECT High_School__c FROM raw_a_students)",
    ),
)
def job_a_schoolid(spark, sf):
    """C03."""
    codes = view(spark, sf, "raw_school_codes").select("Campus", "code")
    return PA.schoolid(view(spark, sf, "raw_accounts"), view(spark, sf, "raw_a_students"), codes)


_EXTRA_NUM = ("longitude", "latitude", "dist_from_chicago", "percentinstate", "percentoutofstate", "percentpellgrant", "avgnetprice", "netprice0_30", "netprice30_48", "netprice48_75")


@query(
    "job_a_colleges",
    oracle(
        "raw_a_colleges raw_a_extra",
        """SELECT c.college_id AS a_sf_college_id, CAST(CAST(c.NCESid__c AS BIGINT) AS VARCHAR) AS ipedid,
  CASE WHEN contains(t, 'Private') THEN TRUE WHEN contains(t, 'Public') THEN FALSE END AS isprivate,
  CASE WHEN contains(t, 'not-for-profit') THEN FALSE WHEN contains(t, 'for-profit') THEN TRUE END AS isforprofit,
  CASE WHEN contains(t, 'less than 2-year') THEN NULL WHEN contains(t, '4-year') THEN TRUE WHEN contains(t, '2-year') THEN FALSE END AS is4year,
  CASE WHEN k % 4 IN (0, 1) THEN CAST(60000 + k AS VARCHAR) END AS zip, replace(Name, ',', '') AS name,
  CAST(NULL AS BOOLEAN) AS isrural, CAST(NULL AS BOOLEAN) AS allmale, CAST(NULL AS BOOLEAN) AS allfemale,
  CAST(rate AS BIGINT) AS graduationrate_6yr, CAST(rate AS BIGINT) AS graduationrate_minority_6yr, CAST(rate AS BIGINT) AS transferrate_6yr, CAST(rate AS BIGINT) AS transferrate_minority_6yr,
  hbcu AS historicallyblack, e.STABBR AS state, """
        + ", ".join(f"e.coord AS {c}" for c in _EXTRA_NUM)
        + """, CAST(e.coord AS VARCHAR) AS locale, nullif(nullif(e.SimpleBarrons, 'Not Available'), '2 year (Competitive)') AS barrons_rating,
  """
        + ", ".join(f"CAST(replace(e.pct, '%', '') AS DOUBLE) AS {c}" for c in PA.EXTRA_PERCENT.values())
        + f""", replace(nullif(e.size_text, 'Not reported'), ',', '') AS size_range
FROM (SELECT *, coalesce(College_Type__c, '') AS t FROM raw_a_colleges) c LEFT JOIN raw_a_extra e ON e.UNITID = c.NCESid__c WHERE c.college_id NOT IN ({_BLOCKED_SQL})""",
    ),
)
def job_a_colleges(spark, sf):
    """C04."""
    return PA.colleges(_college_database(spark, sf), _extra_colleges(spark, sf), _BLOCKED)


def _extra_colleges(spark, sf):
    e = view(spark, sf, "raw_a_extra")
    names = {raw_name: "coord" for raw_name in PA.EXTRA_COLLEGE if raw_name not in ("STABBR", "Locale")}
    return e.select(
        "UNITID", "STABBR", "SimpleBarrons", F.col("coord").cast("string").alias("Locale"), F.col("size_text").alias("Size Range"),
        *[F.col(c).alias(n) for n, c in names.items()], *[F.col("pct").alias(n) for n in PA.EXTRA_PERCENT],
    )


@query(
    "job_a_acttests",
    oracle(
        "raw_a_tests",
        """SELECT student_number AS cps_id, d AS date, upper(testname_clean) AS test_level, CASE timeperiod WHEN 'Pre' THEN 'Fall' WHEN 'Post' THEN 'Spring' ELSE '' END AS test_semester,
  score AS score_composite, score AS score_english, score AS score_math, score AS score_reading, score AS score_science, CAST(NULL AS INT) AS score_writing, FALSE AS onlyhighestavailable FROM raw_a_tests""",
    ),
)
def job_a_acttests(spark, sf):
    """C05."""
    return PA.acttests(_a_tests(spark, sf))


def _a_tests(spark, sf):
    t = view(spark, sf, "raw_a_tests").withColumn("test_date", F.date_format("d", "M/d/yyyy"))
    return t.withColumns({s: F.col("score") for s in ("composite", "english", "math", "reading", "science")})


@query(
    "job_a_attendance",
    oracle(
        "raw_a_attendance",
        """SELECT * FROM (SELECT STUDENT_NUMBER AS student_cps_id, CAST(SCHOOLID AS VARCHAR) AS school_a_powerschoolid, d AS attendance_date, SY AS school_year,
  CASE DESCRIPTION WHEN 'Late Arrival Excused' THEN 'excused' WHEN 'Late' THEN 'tardy' ELSE CASE WHEN ATT_CODE IN ('X', 'M') THEN 'excused' WHEN ATT_CODE IN ('T', 'T0', 'T5', 'L0', 'L5') THEN 'tardy'
    WHEN ATT_CODE IN ('A', 'R') THEN 'unexcused' WHEN ATT_CODE LIKE 'E%' THEN 'early_dismissal' WHEN ATT_CODE = 'S' THEN 'suspended' ELSE ATT_CODE END END AS attendance_type FROM raw_a_attendance)
WHERE attendance_type IS NULL OR attendance_type NOT IN ('F', 'G', 'H5', 'H1')""",
    ),
)
def job_a_attendance(spark, sf):
    """C06."""
    return PA.attendance(view(spark, sf, "raw_a_attendance").withColumn("ATT_DATE", F.col("d").cast("string")))


_REASONS = ", ".join(
    f"CASE WHEN Withdrawal_code__c IS NOT NULL THEN list_contains(string_split(Withdrawal_code__c, ';'), '{code}') END AS withdrawal_reason_{r}" for r, code in PA.WITHDRAWAL_CODES.items()
)
_A_ENROL = f"""SELECT Student__c AS a_student_sf_id, College__c AS a_college_sf_id, CASE WHEN s <= DATE '{AS_OF}' THEN s END AS start_date,
  CASE WHEN e <= DATE '{AS_OF}' THEN e END AS end_date, CASE WHEN e <= DATE '{AS_OF}' THEN e END AS date_last_verified, Status__c AS status, 'sf' AS data_source,
  CAST(NULL AS BOOLEAN) AS living_on_campus, replace(Degree_Type__c, '''', '') AS degree_type,
  CASE Degree_Text__c WHEN '  ba ' THEN 'BACHELOR ARTS' WHEN 'B.  S.' THEN 'BACHELOR SCIENCE' WHEN 'unheard of' THEN 'OTHER' END AS degree_subject,
  {_MAJOR.format(c='Major_Text__c')} AS major, {_REASONS} FROM raw_a_enrolments"""


def _a_enrolments(spark, sf):
    e = view(spark, sf, "raw_a_enrolments").withColumn("Data_Source__c", F.lit("sf"))
    return e.withColumns({"Start_Date__c": F.col("s").cast("string"), "End_Date__c": F.date_format("e", "M/d/yyyy"), "Date_Last_Verified__c": F.col("e").cast("string")})


@query("job_a_enrollments", oracle("raw_a_enrolments", _A_ENROL))
def job_a_enrollments(spark, sf):
    """C07."""
    majors, degrees = _maps(spark, sf)
    return PA.enrollments(_a_enrolments(spark, sf), degrees, majors, AS_OF)


@query(
    "job_a_students",
    oracle(
        "raw_a_students",
        """SELECT Id AS a_sf_id, Network_Student_ID__c AS cps_id, 'A' AS network, CASE WHEN born > DATE '1970-01-01' THEN born END AS date_of_birth,
  CASE WHEN Gender__c LIKE 'F%' THEN TRUE WHEN Gender__c LIKE 'M%' THEN FALSE END AS is_female,
  CASE Ethnicity__c WHEN 'B' THEN 'African American' WHEN 'Multi-Cultural' THEN 'Multicultural' ELSE Ethnicity__c END AS ethnicity,
  CAST(Special_Education__c AS BOOLEAN) AS ever_special_ed, CAST(Low_Income__c AS BOOLEAN) AS ever_free_lunch, CAST(First_Generation_College_Student__c AS BOOLEAN) AS is_first_gen,
  EFC_from_FAFSA__c AS fafsa_efc, CAST(NULL AS VARCHAR) AS family_income_bracket, CAST(NULL AS INT) AS number_in_household, CAST(NULL AS VARCHAR) AS zip FROM raw_a_students""",
    ),
)
def job_a_students(spark, sf):
    """C08."""
    return PA.students(view(spark, sf, "raw_a_students"))


@query(
    "job_a_contacts",
    oracle(
        "raw_a_notes raw_a_students",
        """WITH c AS (SELECT n.*, s.High_School__c AS grp FROM raw_a_notes n LEFT JOIN raw_a_students s ON s.Id = n.Contact__c),
real AS (SELECT * FROM c WHERE CreatedById <> 'BATCH'),
gm AS (SELECT grp, CreatedById AS m FROM real WHERE grp IS NOT NULL GROUP BY grp, CreatedById QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, CreatedById) = 1),
om AS (SELECT Contact__c, CreatedById AS m FROM real GROUP BY Contact__c, CreatedById QUALIFY row_number() OVER (PARTITION BY Contact__c ORDER BY count(*) DESC, CreatedById) = 1)
SELECT c.Contact__c AS a_sf_id, CASE WHEN d <= DATE '2024-01-20' THEN d END AS contact_date,
  CASE WHEN c.grp IS NULL THEN NULL WHEN c.grp NOT IN ('School 2', 'School 7') THEN gm.m WHEN c.CreatedById = 'BATCH' THEN coalesce(om.m, gm.m) ELSE c.CreatedById END AS counselor_id,
  CASE Mode_of_Communication__c WHEN 'Phone' THEN 'Call' WHEN 'Mail (letter/postcard)' THEN 'Mail' ELSE Mode_of_Communication__c END AS contact_medium,
  CAST(Initiated_by_alum__c AS BOOLEAN) AS initiated_by_student, FALSE AS was_outreach, CASE WHEN Comm_Status__c IS NOT NULL THEN Comm_Status__c <> 'Outreach only' END AS was_successful
FROM c LEFT JOIN gm ON gm.grp = c.grp LEFT JOIN om ON om.Contact__c = c.Contact__c""",
    ),
)
def job_a_contacts(spark, sf):
    """C09."""
    notes = view(spark, sf, "raw_a_notes").withColumn("Date_of_Contact__c", F.col("d").cast("string"))
    return PA.contacts(notes, _alumni(spark, sf), date(2024, 1, 20), ["BATCH"], ["School 2", "School 7"])


@query(
    "job_a_aptests",
    oracle(
        "raw_a_tests",
        "SELECT student_number AS a_powerschool_id, d AS date, score % 6 AS score, CASE WHEN l_linenumber % 5 = 0 THEN 'OTHER' WHEN l_linenumber % 5 < 4 THEN ['URGENT', 'HIGH', 'MEDIUM'][l_linenumber % 5] END AS subject FROM raw_a_tests",
    ),
)
def job_a_aptests(spark, sf):
    """C10."""
    return PA.aptests(_a_ap_tests(spark, sf), _maps(spark, sf)[0])


def _a_ap_tests(spark, sf):
    names = F.array(F.lit("5-low"), F.lit("1-urgent"), F.lit("2-high"), F.lit("3-medium"), F.lit(None))
    return view(spark, sf, "raw_a_tests").withColumns(
        {"test_date": F.col("d").cast("string"), "numscore": F.col("score") % 6, "testname": F.concat(F.lit("AP "), F.get(names, F.col("l_linenumber") % 5))}
    )


@query(
    "job_a_schools",
    oracle(
        "raw_a_students raw_accounts raw_school_codes",
        """SELECT n.name, a.Id AS a_sf_school_id, CAST(a.BillingPostalCode AS INT) AS zip, make_date(CAST(s.first_class AS INT), 1, 1) AS year_of_first_graduating_class,
  'high school' AS level, 'charter' AS kind, 'A' AS parent_organization, TRUE AS no_excuses, CAST(NULL AS DOUBLE) AS dropout_rate, CAST(NULL AS INT) AS number_of_students,
  CAST(NULL AS DOUBLE) AS avg_class_size, CAST(NULL AS INT) AS number_of_staff, CAST(NULL AS INT) AS number_of_counselors, CAST(NULL AS DOUBLE) AS annual_budget
FROM (SELECT DISTINCT High_School__c AS name FROM raw_a_students) n LEFT JOIN raw_accounts a ON a.Name = n.name LEFT JOIN raw_school_codes s ON s.Campus = n.name""",
    ),
)
def job_a_schools(spark, sf):
    """C11."""
    return PA.schools(view(spark, sf, "raw_accounts"), _alumni(spark, sf), _founding_years(spark, sf))


def _founding_years(spark, sf):
    return view(spark, sf, "raw_school_codes").select(F.col("Campus").alias("name"), F.col("first_class").alias("year_of_first_graduating_class"))


def _a_courses(spark, sf):
    return view(spark, sf, "raw_a_courses").withColumnRenamed("grade_level", "Grade Level").withColumnRenamed("sy", "SY")


_GRADE_SQL = "CASE grade WHEN 'p' THEN 'P' WHEN ' P' THEN 'P' {more} WHEN '??' THEN NULL ELSE grade END"
_POINTS_SQL = "CASE g WHEN 'A+' THEN 4.3 WHEN 'A' THEN 4.0 WHEN 'B-' THEN 2.7 WHEN 'C+' THEN 2.3 WHEN 'C' THEN 2.0 WHEN 'D' THEN 1.0 WHEN 'F' THEN 0.0 END::DOUBLE"


@query(
    "job_a_gpa_by_year",
    oracle(
        "raw_a_courses",
        f"""WITH g AS (SELECT *, {_GRADE_SQL.format(more="WHEN 'c+' THEN 'C+' WHEN 'd' THEN 'D'")} AS g, potentialcrhrs AS h FROM raw_a_courses WHERE coalesce(excludefromgpa <> 'Yes', TRUE)),
p AS (SELECT *, {_POINTS_SQL} AS pt FROM g),
m AS (SELECT student_number, sy, schoolid FROM g GROUP BY student_number, sy, schoolid QUALIFY row_number() OVER (PARTITION BY student_number, sy ORDER BY count(*) DESC, schoolid) = 1)
SELECT p.student_number AS cps_id, p.sy AS school_year, any_value(m.schoolid) AS a_powerschool_school_id, round(coalesce(sum(pt * h), 0) / sum(h), 9) AS unweighted_gpa,
  round(coalesce(sum((pt + ap + 0.5 * honors) * h), 0) / sum(h), 9) AS weighted_gpa FROM p JOIN m USING (student_number, sy) GROUP BY 1, 2""",
    ),
)
def job_a_gpa_by_year(spark, sf):
    """C12."""
    out = PA.gpa_by_year(_a_courses(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("unweighted_gpa", "weighted_gpa")})


@query(
    "job_a_gpa_cumulative",
    oracle(
        "raw_a_students raw_accounts",
        "SELECT s.Id AS a_student_sf_id, gpa AS cumulative_unweighted_gpa, a.Id AS a_sf_school_id FROM raw_a_students s LEFT JOIN raw_accounts a ON a.Name = s.High_School__c",
    ),
)
def job_a_gpa_cumulative(spark, sf):
    """C13."""
    return PA.gpa_cumulative(_alumni(spark, sf), view(spark, sf, "raw_accounts"))


@query(
    "job_a_courses",
    oracle(
        "raw_a_courses",
        f"""SELECT student_number AS cps_id, schoolid AS a_powerschool_school_id, CASE WHEN course_name LIKE 'Com%' THEN 'Computer Programming' ELSE replace(course_name, ',', '') END AS course_name,
  CAST(course_number AS VARCHAR) AS course_number, sy AS year_taken, CASE storecode WHEN 'S1' THEN 1 WHEN 's3' THEN 3 ELSE 2 END AS semester_taken,
  CASE storecode WHEN 'S1' THEN make_date(CAST(sy - 1 AS INT), 12, 31) WHEN 's3' THEN make_date(CAST(sy AS INT), 8, 19) ELSE make_date(CAST(sy AS INT), 6, 15) END AS grade_available,
  CAST(grade_level AS INT) AS course_level, potentialcrhrs AS credit_hours, honors = 1 AS was_honors, ap = 1 AS was_ap, CASE WHEN percent <= 120 THEN percent END AS percent_grade,
  {_GRADE_SQL.format(more="WHEN 'c+' THEN 'c+'")} AS letter_grade FROM raw_a_courses""",
    ),
)
def job_a_courses(spark, sf):
    """C14."""
    return PA.courses(_a_courses(spark, sf))


@query(
    "job_a_hs_enrollment",
    oracle(
        "raw_a_students raw_accounts",
        "SELECT s.Id AS a_sf_id, a.Id AS a_sf_school_id, HS_Class__c AS high_school_class FROM raw_a_students s LEFT JOIN raw_accounts a ON a.Name = s.High_School__c",
    ),
)
def job_a_hs_enrollment(spark, sf):
    """C15."""
    return PA.hs_enrollment(view(spark, sf, "raw_a_students"), view(spark, sf, "raw_accounts"))


# --- profile B and foundation ----------------------------------------------------------

@query(
    "job_b_students",
    oracle(
        "raw_b_students",
        """SELECT contact_id AS b_sf_id, cps_id, CAST(powerschool_id AS VARCHAR) AS b_powerschool_id, 'B' AS network, born AS date_of_birth,
  CASE ethnicity WHEN 'H' THEN 'Hispanic' ELSE ethnicity END AS ethnicity, is_female, ever_special_ed, ever_free_lunch, replace(family_income_bracket, ',', '') AS family_income_bracket,
  CAST(number_in_household AS INT) AS number_in_household, is_first_gen,
  CASE WHEN zip < 10000 THEN '0' ELSE '' END || CAST(CAST(zip AS BIGINT) AS VARCHAR) AS zip, fafsa_efc
FROM raw_b_students QUALIFY row_number() OVER (PARTITION BY powerschool_id ORDER BY contact_id) = 1""",
    ),
)
def job_b_students(spark, sf):
    """C16."""
    return PB.students(view(spark, sf, "raw_b_students"))


@query(
    "job_b_studentid",
    oracle("raw_b_students", "SELECT min(contact_id) AS b_sf_id, CAST(powerschool_id AS VARCHAR) AS b_powerschool_id FROM raw_b_students GROUP BY powerschool_id"),
)
def job_b_studentid(spark, sf):
    """C17."""
    return PB.studentid(view(spark, sf, "raw_b_students"))


@query("job_b_schoolid", oracle("raw_b_schools", "SELECT school_salesforce_id AS b_sf_school_id FROM raw_b_schools"))
def job_b_schoolid(spark, sf):
    """C18."""
    return PB.schoolid(view(spark, sf, "raw_b_schools"))


_B_ENROL = f"""SELECT student_salesforce_id AS b_sf_id, CASE WHEN ok % 7 > 1 THEN CAST(college_ncesid AS INT) END AS ipedsid,
  CASE status WHEN 'Withdrawn' THEN 'Withdrew' WHEN 'Matriculated' THEN 'Matriculating' ELSE status END AS status, s AS start_date, e AS end_date, e AS date_last_verified,
  CASE ok % 5 WHEN 0 THEN 'Bachelors' WHEN 2 THEN 'Certificate' WHEN 4 THEN 'Masters' END AS degree_type,
  CASE WHEN ok % 5 = 2 THEN 'CERTIFICATE' WHEN ok % 5 IN (0, 4) AND ok % 3 < 2 THEN CASE WHEN ok % 5 = 0 THEN 'BACHELOR ' ELSE 'MASTER ' END || CASE ok % 3 WHEN 0 THEN 'SCIENCE' ELSE 'FINE ARTS' END END AS degree_subject,
  data_source, living_on_campus, coalesce(transfer_reason__c = 'Academic', FALSE) AS withdrawal_reason_academic, coalesce(transfer_reason__c = 'Financial', FALSE) AS withdrawal_reason_financial,
  coalesce(transfer_reason__c = 'Social', FALSE) AS withdrawal_reason_social, CAST(NULL AS BOOLEAN) AS withdrawal_reason_motivational, CAST(NULL AS BOOLEAN) AS withdrawal_reason_family,
  CAST(NULL AS BOOLEAN) AS withdrawal_reason_health, CAST(NULL AS BOOLEAN) AS withdrawal_reason_racial, {_MAJOR.format(c='major')} AS major
FROM raw_b_enrolments WHERE (status IS NULL OR status NOT IN ('Other', 'Deferred')) AND ok % 5 <> 1"""


def _b_enrolments(spark, sf):
    e = view(spark, sf, "raw_b_enrolments")
    return e.withColumns({"start_date": F.col("s").cast("string"), "end_date": F.col("e").cast("string"), "date_last_verified": F.date_format("e", "M/d/yyyy")})


@query("job_b_enrollments", oracle("raw_b_enrolments", _B_ENROL))
def job_b_enrollments(spark, sf):
    """C19."""
    return PB.enrollments(_b_enrolments(spark, sf), _maps(spark, sf)[0])


@query(
    "job_b_contacts",
    oracle(
        "raw_b_contacts",
        """SELECT student_salesforce_id AS b_sf_id, d + CAST(seconds // 86400 AS INT) AS contact_date, counselor_id,
  CASE contact_medium WHEN 'Phone' THEN 'Call' WHEN 'College staff contact' THEN 'College Contact' ELSE contact_medium END AS contact_medium, initiated_by_student,
  FALSE AS was_outreach, coalesce(was_successful, FALSE) AS was_successful FROM raw_b_contacts""",
    ),
)
def job_b_contacts(spark, sf):
    """C20."""
    c = view(spark, sf, "raw_b_contacts")
    return PB.contacts(c.withColumn("contact_date", F.unix_date("d").cast("bigint") * 86400 + F.col("seconds")))


@query(
    "job_b_acttests",
    oracle(
        "raw_b_tests",
        """SELECT student_salesforce_id AS b_sf_id, d AS date, test_level, CASE WHEN month(d) BETWEEN 2 AND 6 THEN 'Spring' WHEN month(d) >= 9 THEN 'Fall' END AS test_semester,
  CAST(floor(score) AS INT) AS score_composite, CAST(floor(score) AS INT) AS score_english, CAST(floor(score) AS INT) AS score_math, CAST(floor(score) AS INT) AS score_reading,
  CAST(floor(score) AS INT) AS score_science, CAST(writing AS INT) AS score_writing, FALSE AS onlyhighestavailable FROM raw_b_tests""",
    ),
)
def job_b_acttests(spark, sf):
    """C21."""
    return PB.acttests(_b_tests(spark, sf))


def _b_tests(spark, sf):
    t = view(spark, sf, "raw_b_tests").withColumns({"date": F.col("d").cast("string"), "score_writing": F.col("writing")})
    return t.withColumns({f"score_{s}": F.col("score") for s in PB.ACT_PARTS if s != "writing"})


@query(
    "job_b_schools",
    oracle(
        "raw_b_schools",
        """SELECT replace(name, ',', '') AS name, school_salesforce_id AS b_sf_school_id, CASE level WHEN 'Elementary School' THEN 'elementary' ELSE lower(level) END AS level,
  CASE kind WHEN 'Partner B Public' THEN 'charter' WHEN 'Charter' THEN 'charter' WHEN 'Private Magnet' THEN 'magnet' WHEN 'Public' THEN 'public' END AS kind,
  CASE WHEN kind = 'Partner B Public' THEN 'Partner B' WHEN kind IS NULL THEN parent_organization END AS parent_organization, no_excuses,
  CASE WHEN CAST(substring(zip, 1, 5) AS INT) BETWEEN 501 AND 99950 THEN substring(zip, 1, 5) END AS zip, 1990 + size AS year_of_first_graduating_class, CAST(NULL AS DOUBLE) AS dropout_rate,
  size AS number_of_students, size AS avg_class_size, size AS number_of_staff, size AS number_of_counselors, size AS annual_budget FROM raw_b_schools""",
    ),
)
def job_b_schools(spark, sf):
    """C22."""
    return PB.schools(_b_schools(spark, sf), "Partner B")


def _b_schools(spark, sf):
    s = view(spark, sf, "raw_b_schools").withColumn("year_of_first_graduating_class", 1990 + F.col("size"))
    return s.withColumns({c: F.col("size") for c in ("number_of_students", "avg_class_size", "number_of_staff", "number_of_counselors", "annual_budget")})


@query(
    "job_b_courses",
    oracle(
        "raw_b_courses",
        """SELECT course_name, CAST(NULL AS VARCHAR) AS course_number, student_salesforce_id AS b_sf_id, school_salesforce_id AS b_sf_school_id, CAST(NULL AS VARCHAR) AS teacher_id, year_taken,
  1 AS semester_taken, CAST(NULL AS DATE) AS grade_available, 'year' AS course_length, 1 AS course_level, 1.5::DOUBLE AS credit_hours, FALSE AS was_honors, TRUE AS was_ap,
  CASE WHEN percent_grade > 100 THEN 100.0 ELSE percent_grade END AS percent_grade, replace(letter_grade, ' ', '') AS letter_grade FROM raw_b_courses""",
    ),
)
def job_b_courses(spark, sf):
    """C23."""
    return PB.courses(_b_courses(spark, sf))


def _b_courses(spark, sf):
    return view(spark, sf, "raw_b_courses").withColumns(
        {
            "teacher_id": F.lit(None).cast("string"), "semester_taken": F.lit(1), "course_length": F.lit("year"), "course_level": F.lit(1),
            "credit_hours": F.lit(1.5), "was_honors": F.lit(False), "was_ap": F.lit(True),
        }
    )


@query(
    "job_b_attendance",
    oracle(
        "raw_b_attendance",
        """SELECT student_salesforce_id AS b_sf_id, d AS attendance_date, school_year, CASE attendance_type WHEN 'Tardy Excused' THEN 'tardy' WHEN 'Suspension' THEN 'suspended'
  WHEN 'Documented' THEN 'excused' WHEN 'Undocumented' THEN 'unexcused' WHEN 'Early Absent' THEN 'unexcused' WHEN 'Early leave' THEN 'early_dismissal' END AS attendance_type FROM raw_b_attendance""",
    ),
)
def job_b_attendance(spark, sf):
    """C24."""
    return PB.attendance(view(spark, sf, "raw_b_attendance").withColumn("attendance_date", F.col("d").cast("string")))


@query(
    "job_b_gpa_by_year",
    oracle("raw_b_gpa", "SELECT student_salesforce_id AS b_sf_id, school_salesforce_id AS b_sf_school_id, school_year, weighted_gpa, unweighted_gpa FROM raw_b_gpa"),
)
def job_b_gpa_by_year(spark, sf):
    """C25."""
    return PB.gpa_by_year(view(spark, sf, "raw_b_gpa"))


@query(
    "job_b_gpa_cumulative",
    oracle(
        "raw_b_gpa",
        """SELECT student_salesforce_id AS b_sf_id, arg_min(school_salesforce_id, (school_year, school_salesforce_id)) AS b_sf_school_id, round(avg(weighted_gpa), 9) AS cumulative_weighted_gpa,
  round(avg(unweighted_gpa), 9) AS cumulative_unweighted_gpa FROM raw_b_gpa GROUP BY 1""",
    ),
)
def job_b_gpa_cumulative(spark, sf):
    """C26."""
    out = PB.gpa_cumulative(view(spark, sf, "raw_b_gpa"))
    return out.withColumns({c: F.round(c, 9) for c in ("cumulative_weighted_gpa", "cumulative_unweighted_gpa")})


@query(
    "job_b_hs_enrollment",
    oracle(
        "raw_b_enrolments",
        """SELECT student_salesforce_id AS b_sf_id, college_salesforce_id AS b_sf_school_id, s AS start_date, e AS end_date,
  CASE status WHEN 'Withdrawn' THEN 'Withdrew' WHEN 'Matriculated' THEN 'Matriculating' ELSE status END AS exit_type, CASE WHEN status = 'Graduated' THEN CAST(year(e) - 1 AS INT) END AS high_school_class
FROM raw_b_enrolments WHERE ok % 5 = 1 AND (status IS NULL OR status NOT IN ('Other', 'Deferred'))""",
    ),
)
def job_b_hs_enrollment(spark, sf):
    """C27."""
    return PB.hs_enrollment(_b_enrolments(spark, sf))


@query(
    "job_foundation_acttests",
    oracle(
        "raw_foundation",
        """SELECT Id AS foundation_id, d AS date, CAST(nullif(score, 0) AS BIGINT) AS score_composite, CAST(nullif(english, 0) AS BIGINT) AS score_english, CAST(NULL AS BIGINT) AS score_math,
  CAST(NULL AS BIGINT) AS score_reading, CAST(NULL AS BIGINT) AS score_science, CAST(NULL AS BIGINT) AS score_writing, FALSE AS onlyhighestavailable FROM raw_foundation WHERE Test_Type__c = 'ACT'""",
    ),
)
def job_foundation_acttests(spark, sf):
    """C28."""
    t = view(spark, sf, "raw_foundation").withColumns(
        {"Date__c": F.col("d").cast("string"), "ACT_Composite__c": F.col("score"), "ACT_English__c": F.col("english"), "ACT_Math__c": F.lit(None).cast("double")}
    )
    return PB.foundation_acttests(t)


# --- integration -------------------------------------------------------------------------

def _partners(spark, sf, as_of=AS_OF):
    """Both partners' clean tables, through the load manifests."""
    majors, degrees = _maps(spark, sf)
    students = view(spark, sf, "raw_a_students")
    a = I.run_manifest(
        I.MANIFEST_A,
        {
            "students": students, "college_database": _college_database(spark, sf), "enrolments": _a_enrolments(spark, sf),
            "accounts": view(spark, sf, "raw_accounts"), "alumni": _alumni(spark, sf),
            "school_codes": view(spark, sf, "raw_school_codes").select("Campus", "code"),
            "courses": _a_courses(spark, sf),
            "attendance": view(spark, sf, "raw_a_attendance").withColumn("ATT_DATE", F.col("d").cast("string")),
            "contact_notes": view(spark, sf, "raw_a_notes").withColumn("Date_of_Contact__c", F.col("d").cast("string")),
            "tests": _a_tests(spark, sf), "ap_tests": _a_ap_tests(spark, sf), "extra_college_features": _extra_colleges(spark, sf),
            "founding_years": _founding_years(spark, sf),
        },
        {"as_of": as_of, "majors": majors, "degrees": degrees, "subjects": majors, "blocked": _BLOCKED, "placeholders": ["BATCH"], "shared_schools": ["School 2", "School 7"]},
    )
    contacts = view(spark, sf, "raw_b_contacts")
    b = I.run_manifest(
        I.MANIFEST_B,
        {
            "students": view(spark, sf, "raw_b_students"), "enrolments": _b_enrolments(spark, sf), "yearly_gpa": view(spark, sf, "raw_b_gpa"),
            "contacts": contacts.withColumn("contact_date", F.unix_date("d").cast("bigint") * 86400 + F.col("seconds")),
            "attendance": view(spark, sf, "raw_b_attendance").withColumn("attendance_date", F.col("d").cast("string")),
            "schools": _b_schools(spark, sf), "tests": _b_tests(spark, sf), "courses": _b_courses(spark, sf),
        },
        {"majors": majors, "own_organization": "Partner B"},
    )
    return a, b


#: How a table names its ids by what the partners know: id table -> natural key, and the jobs that deliver it.
_NATURAL = {"studentid": "coalesce(a_sf_id, b_sf_id)", "schoolid": "coalesce(a_sf_school_id, b_sf_school_id)", "collegeid": "a_sf_college_id"}


def _ids_sql() -> str:
    parts = []
    for table in _NATURAL:
        types = ", ".join(f"NULL::{'INT' if c == 'ipedsid' else 'VARCHAR'} AS {c}" for c in CONTRACTS[table].data_columns())
        rows = [f"SELECT * FROM ({ORACLES[f'job_{p}_{table}']})" for p in "ab" if f"job_{p}_{table}" in ORACLES]
        parts.append(f"i_{table} AS (SELECT *, {_NATURAL[table]} AS nat FROM (SELECT {types} WHERE FALSE UNION ALL BY NAME {' UNION ALL BY NAME '.join(rows)}))")
    return ", ".join(parts)


#: A year stands for a date in this feed.
_RETYPED = {("b", "schools"): "* REPLACE (make_date(CAST(year_of_first_graduating_class AS INT), 1, 1) AS year_of_first_graduating_class)"}


def _columns(ddl: str) -> dict[str, str]:
    """Column -> DuckDB type of a contract's column list."""
    return {c: t.replace("STRING", "VARCHAR") for c, t in (part.split(" ", 1) for part in ddl.split(", "))}


def _integrated_sql(table: str) -> str:
    """An integrated table through its natural keys: both partners' clean tables, resolved, cast and united."""
    contract = CONTRACTS[table]
    wanted, partner = _columns(contract.data), _columns(contract.partner_ids)
    ids = [c for c in contract.id_columns() if c != "enrollid"]
    parts = [f"SELECT {', '.join([*[f'NULL::VARCHAR AS {c}' for c in ids], *[f'NULL::{t} AS {c}' for c, t in wanted.items()]])} WHERE FALSE"]
    for p in "ab":
        side = I.RESOLUTION[table].get(p)
        if side is not None and f"job_{p}_{table}" in ORACLES:
            joins = [
                f"{'LEFT ' * (how == 'left')}JOIN i_{ids_of} x{i} ON CAST(x{i}.{id_col} AS VARCHAR) = CAST(j.{on} AS VARCHAR)"
                for i, (ids_of, on, id_col, how) in enumerate(side.lookups)
            ]
            found = ", ".join(f"x{i}.nat AS {ids_of}" for i, (ids_of, *_) in enumerate(side.lookups))
            rest = ", ".join(f"'{c}'" for c in partner)
            rows = f"SELECT {_RETYPED.get((p, table), '*')} FROM ({ORACLES[f'job_{p}_{table}']})"
            parts.append(f"SELECT COLUMNS(lambda c: c NOT IN ({rest})) FROM (SELECT j.*, {found} FROM ({rows}) j {' '.join(joins)})")
    out = ", ".join([*ids, *[f"try_cast({c} AS {t}) AS {c}" for c, t in wanted.items()]])
    return f"WITH {_ids_sql()} SELECT DISTINCT {out} FROM ({' UNION ALL BY NAME '.join(parts)})"


def _named(ids):
    """Id tables with the partners' own key of each id, and the columns that hold these."""
    return {t: df.withColumn(f"__{t}", F.expr(_NATURAL[t])) for t, df in ids.items()}, {t: f"__{t}" for t in ids}


def _integrated(spark, sf, table: str, as_of=AS_OF):
    """An integrated table with the partners' own keys beside its ids; the id tables it is resolved against are written once."""
    a, b = _partners(spark, sf, as_of)
    ids, names = _named({t: stored(df, t) for t, df in I.integrate_ids(a, b).items()})
    return I.integrate_table(table, a, b, ids, names)


def _natural_ids(df):
    """The surrogate ids of a table replaced by the partners' own, which came where the ids were found."""
    for table in _NATURAL:
        if table in df.columns:
            name = f"__{table}"
            # an id no partner looks up is unknown
            df = df.withColumn(table, F.col(name) if name in df.columns else F.lit(None).cast("string")).drop(name)
    return df.drop("enrollid")


#: Averages are compared to four digits; the day up to which contacts count is that of the partner's own job query.
_AVERAGES = {"gpa_cumulative": ("cumulative_weighted_gpa", "cumulative_unweighted_gpa")}
_UP_TO = {"contacts": date(2024, 1, 20)}


def _register_integrated(table: str, label: str):
    rounded = _AVERAGES.get(table, ())
    replaced = ", ".join(f"CAST(round({c}, 4) AS DOUBLE) AS {c}" for c in rounded)
    sql = f"SELECT * REPLACE ({replaced}) FROM ({_integrated_sql(table)})" if rounded else _integrated_sql(table)

    def run(spark, sf):
        df = _natural_ids(_integrated(spark, sf, table, _UP_TO.get(table, AS_OF)))
        return df.withColumns({c: F.round(c, 4).cast("double") for c in rounded})

    run.__doc__ = f"{label}, S02, S03: the integrated table {table}, every row and column, through natural keys."
    return query(f"integrated_{table}", sql)(run)


for _table, _label in (
    ("students", "I04"), ("enrollments", "I05"), ("acttests", "I06"), ("aptests", "I07"), ("gpa_cumulative", "I08"), ("gpa_by_year", "I09"), ("attendance", "I10"),
    ("hs_enrollment", "I11"), ("colleges", "I13"), ("schools", "I14"), ("contacts", "I15"), ("courses", "I16"),
):
    _register_integrated(_table, _label)


_E_COLS = CONTRACTS["enrollments"].data_columns()


@query(
    "integrate_enrollments",
    oracle(
        "raw_a_enrolments raw_b_enrolments raw_a_students raw_b_students raw_a_colleges",
        f"""WITH a AS ({_A_ENROL}), b AS ({_B_ENROL}),
bs AS (SELECT min(contact_id) AS id FROM raw_b_students GROUP BY powerschool_id),
cs AS (SELECT college_id, CAST(NCESid__c AS INT) AS ipedsid FROM raw_a_colleges WHERE college_id NOT IN ({_BLOCKED_SQL})),
u AS (SELECT s.Id AS student, c.college_id AS college, {', '.join('a.' + c for c in _E_COLS)} FROM a LEFT JOIN raw_a_students s ON s.Id = a.a_student_sf_id LEFT JOIN cs c ON c.college_id = a.a_college_sf_id
  UNION SELECT s.id, c.college_id, {', '.join('b.' + c for c in _E_COLS)} FROM b LEFT JOIN bs s ON s.id = b.b_sf_id LEFT JOIN cs c ON c.ipedsid = b.ipedsid)
SELECT coalesce(student, '?') AS student, coalesce(college, '?') AS college, status, degree_type, count(*) AS n, count(DISTINCT start_date) AS starts, count(major) AS majors FROM u GROUP BY ALL""",
    ),
)
def integrate_enrollments(spark, sf):
    """Manifests -> ids -> integrated enrolments, compared through natural keys."""
    a, b = _partners(spark, sf)
    ids = I.integrate_ids(a, b)
    e = I.integrate_table("enrollments", a, b, ids)
    student = ids["studentid"].select("studentid", F.coalesce("a_sf_id", "b_sf_id").alias("student"))
    college = ids["collegeid"].select("collegeid", F.col("a_sf_college_id").alias("college"))
    rows = e.join(student, "studentid", "left").join(college, "collegeid", "left")
    unknown = lambda c: F.coalesce(c, F.lit("?")).alias(c)
    return rows.groupBy(unknown("student"), unknown("college"), "status", "degree_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("start_date").alias("starts"), F.count("major").alias("majors")
    )


@query(
    "integrate_summary",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, count({c}) AS with_id, count(DISTINCT {c}) AS ids FROM ({_integrated_sql(t)})"
        for t, c in ((t, next(c for c in CONTRACTS[t].id_columns() if c != "enrollid")) for t in I.RESOLUTION)
    ),
)
def integrate_summary(spark, sf):
    """Rows of every integrated table, and how many of its first ids are known and differ."""
    a, b = _partners(spark, sf)
    ids = {t: stored(df, t) for t, df in I.integrate_ids(a, b).items()}
    later = dict(zip(("a", "b"), _partners(spark, sf, _UP_TO["contacts"])))
    out = None
    for table in I.RESOLUTION:
        sides = (later["a"], later["b"]) if table in _UP_TO else (a, b)
        c = next(c for c in CONTRACTS[table].id_columns() if c != "enrollid")
        part = I.integrate_table(table, *sides, ids).agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("with_id"), F.count_distinct(c).alias("ids"))
        # one table at a time: what it shuffled goes before the next one begins
        part = stored(part.select(F.lit(table).alias("table"), "rows", "with_id", "ids"), f"summary-{table}")
        out = part if out is None else out.unionByName(part)
    return out


def _rule_sql(check) -> str:
    """A row rule of a contract as a DuckDB predicate that must not be false."""
    c, day = check.column, f"DATE '{AS_OF}'"
    lit = lambda v: f"DATE '{v}'" if isinstance(v, date) else f"'{v}'" if isinstance(v, str) else str(v)
    if check.kind == "range":
        lower, upper, open_lower, open_upper = check.args
        sides = [f"{c} {'>' if open_lower else '>='} {lit(lower)}"] * (lower is not None) + [f"{c} {'<' if open_upper else '<='} {lit(upper)}"] * (upper is not None)
        return " AND ".join(sides)
    return {
        "length": lambda n: f"length({c}) = {n}",
        "width": lambda n: f"length({c}) <= {n}",
        "values": lambda *v: f"{c} IN ({', '.join(map(lit, v))})",
        "multiple": lambda n: f"{c} % {n} = 0",
        "after": lambda d: f"{c} > {lit(d)}",
        "not_after": lambda n: f"{c} <= {day} + {n}",
        "before_months": lambda n: f"{c} < {day} + INTERVAL {n} MONTH",
        "sql": lambda text: text,
        "matches": lambda p: f"regexp_matches({c}, '(?i){p}')",
        "known": lambda: f"{c} IS NOT NULL",
        "year": lambda n, inclusive: f"{c} {'<=' if inclusive else '<'} {AS_OF.year + n}",
    }[check.kind](*check.args)


_PARENTS = {"studentid": "i_studentid", "schoolid": "i_schoolid", "collegeid": "i_collegeid", "lookup_majors": "lk", "lookup_apsubjects": "lk"}


def _violations_sql() -> str:
    """(table, rule, n) of every broken rule of the integrated tables, counted rule by rule."""
    ctes, parts = [_ids_sql(), "lk AS (SELECT DISTINCT split_part(o_orderpriority, '-', 2) AS nat FROM orders WHERE o_orderpriority <> '5-LOW')"], []
    for t in I.RESOLUTION:
        contract = CONTRACTS[t]
        have = [c for c in contract.id_columns() if c != "enrollid"] + contract.data_columns()
        ctes.append(f"w_{t} AS MATERIALIZED ({_integrated_sql(t)})")
        row = lambda rule, n: parts.append(f"SELECT '{t}' AS \"table\", '{rule}' AS rule, {n} AS n FROM w_{t}")
        for check in contract.checks:
            if check.column in have:
                row(f"{check.column}: {check.rule}".replace("'", "''"), f"count(*) FILTER (NOT ({_rule_sql(check)}))")
        for group in contract.unique:
            if set(group) <= set(have):
                by, known = ", ".join(group), " AND ".join(f"{c} IS NOT NULL" for c in group)
                parts.append(f"SELECT '{t}', '{by}: unique', count(*) FROM (SELECT {by} FROM w_{t} WHERE {known} GROUP BY {by} HAVING count(*) > 1)")
        for fk in contract.references:
            if fk.table in _PARENTS and fk.column in have:
                row(f"{fk.column}: references", f"count(*) FILTER ({fk.column} IS NOT NULL AND {fk.column} NOT IN (SELECT nat FROM {_PARENTS[fk.table]} WHERE nat IS NOT NULL))")
    return f"WITH {', '.join(ctes)} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query("warehouse_violations", _violations_sql())
def warehouse_violations(spark, sf):
    """Q01-Q10 over I02-I16: how often each rule of the contracts is broken in the integrated tables."""
    a, b = _partners(spark, sf)
    ids = {t: stored(df, t) for t, df in I.integrate_ids(a, b).items()}
    later = dict(zip(("a", "b"), _partners(spark, sf, _UP_TO["contacts"])))
    tables = {t: stored(I.integrate_table(t, *((later["a"], later["b"]) if t in _UP_TO else (a, b)), ids), t) for t in I.RESOLUTION}
    lookup = raw(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").select(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("name")).distinct()
    keys = {t: [c for c in CONTRACTS[t].id_columns()] for t in tables}
    found = warehouse_contracts(tables, AS_OF, keys, {**ids, "lookup_majors": lookup, "lookup_apsubjects": lookup})
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))


_ATT_COLS = "attendance_date, school_year, attendance_type"


@query(
    "integrate_attendance",
    oracle(
        "raw_a_attendance raw_b_attendance raw_a_students raw_b_students",
        """WITH a AS (SELECT * FROM (SELECT STUDENT_NUMBER AS cps, d, SY AS y,
  CASE DESCRIPTION WHEN 'Late Arrival Excused' THEN 'excused' WHEN 'Late' THEN 'tardy' ELSE CASE WHEN ATT_CODE IN ('X', 'M') THEN 'excused' WHEN ATT_CODE IN ('T', 'T0', 'T5', 'L0', 'L5') THEN 'tardy'
    WHEN ATT_CODE IN ('A', 'R') THEN 'unexcused' WHEN ATT_CODE LIKE 'E%' THEN 'early_dismissal' WHEN ATT_CODE = 'S' THEN 'suspended' ELSE ATT_CODE END END AS t FROM raw_a_attendance)
  WHERE t IS NULL OR t NOT IN ('F', 'G', 'H5', 'H1')),
b AS (SELECT student_salesforce_id AS id, d, school_year AS y, CASE attendance_type WHEN 'Tardy Excused' THEN 'tardy' WHEN 'Suspension' THEN 'suspended'
  WHEN 'Documented' THEN 'excused' WHEN 'Undocumented' THEN 'unexcused' WHEN 'Early Absent' THEN 'unexcused' WHEN 'Early leave' THEN 'early_dismissal' END AS t FROM raw_b_attendance),
bs AS (SELECT min(contact_id) AS id FROM raw_b_students GROUP BY powerschool_id),
u AS (SELECT s.Id AS student, d, y, t FROM a LEFT JOIN raw_a_students s ON s.Network_Student_ID__c = a.cps UNION SELECT bs.id, d, y, t FROM b LEFT JOIN bs USING (id))
SELECT student, y AS school_year, t AS attendance_type, count(*) AS n FROM u GROUP BY ALL""",
    ),
)
def integrate_attendance(spark, sf):
    """Integrated attendance; the second partner has no school id."""
    a, b = _partners(spark, sf)
    ids, names = _named({t: stored(df, t) for t, df in I.integrate_ids(a, b).items()})
    t = I.integrate_table("attendance", a, b, ids, names)
    return t.groupBy(F.col("__studentid").alias("student"), "school_year", "attendance_type").agg(F.count(F.lit(1)).alias("n"))
