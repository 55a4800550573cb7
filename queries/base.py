"""Query registry and analogue views.

The engine's domain tables (enrolments, courses, contacts, ...) do not exist in
the test data, so every view below derives one from the given tables.  A view is
one text that Spark SQL and DuckDB both understand; ``{table}`` marks an input.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from cohortspark.functions.cleaning import recode
from cohortspark.session import tune

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

AS_OF = date(2001, 8, 1)
MEDIA = {"click": "Call", "purchase": "In Person", "signup": "Email", "view": "Text"}
TRAIN_START, SPLIT, TEST_END = date(1998, 1, 1), date(2000, 6, 1), date(2001, 6, 1)

_COLLEGE_RATES = (
    "graduationrate_6yr", "graduationrate_minority_6yr", "transferrate_6yr", "transferrate_minority_6yr",
    "dist_from_chicago", "perc_accepted", "perc_accepted_enroll", "perc_female", "perc_african_american",
    "perc_hispanic", "percentinstate", "percentpellgrant", "avgnetprice", "netprice0_30", "netprice30_48",
    "netprice48_75",
)
_RATE_SQL = ",\n  ".join(
    f"CASE WHEN s_acctbal < {200 * i} THEN NULL ELSE CAST(s_suppkey % {37 + i} AS DOUBLE) END AS {c}"
    for i, c in enumerate(_COLLEGE_RATES)
)

VIEWS: dict[str, str] = {
    "enrolment": """
SELECT o.o_orderkey AS enrollid, o.o_custkey AS studentid, l.collegeid,
  CAST(o.o_orderdate AS DATE) AS start_date,
  CAST(o.o_orderdate AS DATE) + CAST(l.q AS INT) * 60 AS end_date,
  CAST(o.o_orderdate AS DATE) + CAST(l.q AS INT) * 60 AS date_last_verified,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Graduated' WHEN 1 THEN 'Withdrew' WHEN 2 THEN 'Transferred out'
    WHEN 3 THEN 'Attending' WHEN 4 THEN 'Matriculating' ELSE 'Did not matriculate' END AS status,
  o.o_orderpriority AS degree_type,
  nullif(o.o_orderstatus, 'P') AS degree_subject,
  CASE WHEN o.o_totalprice > 400000 THEN NULL WHEN o.o_totalprice > 200000 THEN 'LARGE' ELSE 'SMALL' END AS major
FROM {orders} o
LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS q, min(l_suppkey) AS collegeid FROM {lineitem} GROUP BY l_orderkey) l
  ON o.o_orderkey = l.l_orderkey""",
    "course": """
SELECT o.o_custkey AS studentid, l.l_partkey AS course_number, l.l_linenumber AS line,
  nullif(l.l_quantity, 50) * 2 AS percent_grade,
  year(l.l_shipdate) AS year_taken, 1 + l.l_linenumber % 3 AS semester_taken,
  CAST(l.l_shipdate AS DATE) AS grade_available,
  l.l_returnflag = 'A' AS was_ap, l.l_returnflag = 'R' AS was_honors,
  1 + l.l_tax * 100 AS credit_hours, 1998 + o.o_custkey % 4 AS high_school_class
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "contact": """
SELECT event_id, user_id AS studentid, CAST(ts AS DATE) AS contact_date,
  nullif(event_type, 'error') AS contact_medium,
  regexp_extract(props, '[0-9]+', 0) AS counselor_id,
  event_type = 'signup' AS initiated_by_student,
  CASE WHEN value < 1 THEN NULL ELSE value >= 20 END AS was_successful
FROM {events}""",
    "person": """
SELECT c.c_custkey AS studentid, c.c_mktsegment AS ethnicity, r.r_name AS network, n.n_name AS school,
  n.n_nationkey AS schoolid, DATE '1976-02-29' + CAST(c.c_custkey % 10000 AS INT) AS date_of_birth,
  c.c_custkey % 2 = 0 AS is_female,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_custkey % 3 = 0 END AS ever_special_ed,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE c.c_acctbal > 5000 END AS ever_free_lunch,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE c.c_acctbal < 0 END AS is_first_gen,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal / 2500 END AS cumulative_unweighted_gpa,
  1998 + c.c_custkey % 4 AS high_school_class
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "provider": f"""
SELECT s.s_suppkey AS collegeid, s.s_name AS name, n.n_name AS locale,
  CASE WHEN s.s_acctbal < 0 THEN NULL ELSE s.s_acctbal END AS price,
  s.s_suppkey % 2 = 0 AS isprivate, s.s_suppkey % 9 = 0 AS isforprofit,
  CASE WHEN s.s_suppkey % 4 = 0 THEN NULL ELSE s.s_suppkey % 3 = 0 END AS is4year,
  s.s_suppkey % 17 = 0 AS historicallyblack,
  CASE WHEN s.s_suppkey % 5 = 0 THEN NULL WHEN s.s_suppkey % 5 < 3 THEN 'Competitive' ELSE 'Most competitive' END AS barrons_rating,
  CASE WHEN s.s_suppkey % 6 = 0 THEN NULL WHEN s.s_suppkey % 6 < 3 THEN 'Under 1000' ELSE '1000-4999' END AS size_range,
  {_RATE_SQL}
FROM {{supplier}} s JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey""",
    "attendance": """
SELECT o.o_custkey AS studentid, CAST(l.l_shipdate AS DATE) AS attendance_date, year(l.l_shipdate) AS school_year,
  CASE l.l_partkey % 6 WHEN 0 THEN 'tardy' WHEN 1 THEN 'unexcused' WHEN 2 THEN 'suspended' WHEN 3 THEN 'excused'
    WHEN 4 THEN 'early_dismissal' END AS attendance_type
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "school_term": """
SELECT o.o_custkey AS studentid, year(l.l_shipdate) AS school_year, 1 + l.l_linenumber % 3 AS semester_taken,
  avg(nullif(l.l_quantity, 50) * 2) / 25 AS unweighted_gpa
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
GROUP BY 1, 2, 3""",
    "test_score": """
SELECT o.o_custkey AS studentid, CAST(l.l_shipdate AS DATE) AS date,
  CASE l.l_linenumber % 3 WHEN 0 THEN 'ACT' WHEN 1 THEN 'PLAN' ELSE 'EXPLORE' END AS test_level,
  CASE WHEN l.l_quantity = 50 THEN NULL ELSE 1 + CAST(l.l_quantity AS INT) % 36 END AS score_composite
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "scored": """
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic,
  CAST(d.n_chars % 97 AS DOUBLE) AS score, CAST(d.n_chars AS DOUBLE) AS size
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}


@lru_cache(maxsize=64)
def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the lazy frame is kept so that footers are read once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An analogue view as a lazy DataFrame."""
    text = VIEWS[name]
    inputs = {t: raw(spark, sf_dir, t) for t in RAW if "{" + t + "}" in text}
    return spark.sql(text, **inputs)


def oracle(views: str, body: str) -> str:
    """DuckDB text: a WITH prefix of analogue views plus the query."""
    parts = []
    for name in views.split():
        text = VIEWS[name]
        for t in RAW:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The integrated tables the feature catalogue reads, as analogues."""
    person = view(spark, sf_dir, "person")
    return {
        "students": person,
        "schools": raw(spark, sf_dir, "nation").selectExpr("n_nationkey as schoolid", "n_name as name"),
        "hs_enrollment": person.selectExpr(
            "studentid", "schoolid", "high_school_class", "make_date(high_school_class, 6, 15) as end_date"
        ),
        "gpa_cumulative": person.select("studentid", "cumulative_unweighted_gpa"),
        "enrollments": view(spark, sf_dir, "enrolment"),
        "colleges": view(spark, sf_dir, "provider"),
        "courses": view(spark, sf_dir, "course").drop("high_school_class", "line"),
        "gpa_by_year": view(spark, sf_dir, "school_term"),
        "acttests": view(spark, sf_dir, "test_score"),
        "contacts": view(spark, sf_dir, "contact").drop("event_id").withColumn("contact_medium", recode("contact_medium", MEDIA)),
        "attendance": view(spark, sf_dir, "attendance"),
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query with its DuckDB counterpart."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL fragments for the oracles: written independently of the Spark closed forms ---

CHECK_LIST = "[" + ", ".join(f"DATE '{y}-{md}'" for y in range(1960, 2060) for md in ("01-20", "10-15")) + "]"


def check_sql(column: str, n: int) -> str:
    """The n-th check date by stepping through the list of all check dates."""
    if n > 0:
        return f"list_filter({CHECK_LIST}, lambda d: d > {column})[{n}]"
    return f"list_filter({CHECK_LIST}, lambda d: d < {column})[{n}]"


def survived_sql(n: int, p: str = "") -> str:
    c = f"list_filter({CHECK_LIST}, lambda d: d > {p}start_date)[{n}]"
    return (
        f"CASE {p}status WHEN 'Did not matriculate' THEN FALSE "
        f"WHEN 'Withdrew' THEN {c} < {p}end_date WHEN 'Transferred out' THEN {c} < {p}end_date "
        f"WHEN 'Graduated' THEN CASE WHEN {c} < {p}end_date THEN TRUE END "
        f"WHEN 'Attending' THEN CASE WHEN {c} < {p}date_last_verified THEN TRUE END END"
    )


# --- replicate weights of the bootstraps, as SQL ---

_P = (1 << 31) - 1
#: Cumulative Poisson probabilities per mean below 64.
POISSON_SQL = """pois AS (SELECT c, list(cum ORDER BY k) AS cums FROM (SELECT c, k, sum(exp(k * ln(c) - c - lgamma(k + 1))) OVER (PARTITION BY c ORDER BY k) AS cum
  FROM (SELECT unnest(range(1, 64)) AS c) CROSS JOIN (SELECT unnest(range(0, 200)) AS k) WHERE k <= floor(c + 12 * sqrt(c) + 20)) GROUP BY c)"""


def weight_sql(name: str, source: str, key: str, counts: dict[str, tuple[str, int]], reps: int) -> str:
    """CTEs that end in ``name``: ``source`` x replicates, with a Poisson weight column per entry of ``counts``.

    ``key`` is the text whose md5 gives the two halves of the key; an entry is
    (expression of the mean, stream).  Follows the definition, not the Spark code:
    two rounds x -> x^5 modulo 2^31 - 1 around a linear step.
    """
    fifth = lambda x: f"((({x} * {x} % {_P}) * ({x} * {x} % {_P}) % {_P}) * {x} % {_P})"
    half = lambda at: f"CAST('0x' || substr(h, {at}, 8) AS BIGINT) % {_P}"
    first, second, third, weights = [], [], [], []
    for col, (mean, stream) in counts.items():
        for j in (0, 1):
            first.append(f"(k1 + (CAST(rep AS BIGINT) * 4 + {stream + j + 1}) * 1103515245) % {_P} AS {col}{j}")
            second.append(f"({fifth(f'{col}{j}')} * 69621 + k2) % {_P} AS {col}{j}")
            third.append(f"({fifth(f'{col}{j}')} + 0.5) / {_P} AS {col}{j}")
        weights.append(
            f"CASE WHEN {mean} = 0 THEN 0 WHEN {mean} < 64 THEN len(list_filter((SELECT map(list(c), list(cums)) FROM pois)[CAST({mean} AS BIGINT)], lambda t: t <= {col}0))"
            f" ELSE greatest(floor({mean} + sqrt({mean}) * sqrt(-2 * ln({col}0)) * cos(2 * pi() * {col}1) + 0.5), 0) END AS {col}"
        )
    drop = ", ".join(f"{c}{j}" for c in counts for j in (0, 1))
    return f"""{name}_k AS (SELECT *, {half(1)} AS k1, {half(9)} AS k2 FROM (SELECT *, md5({key}) AS h FROM {source})),
{name}_0 AS (SELECT * EXCLUDE (h), {', '.join(first)} FROM {name}_k CROSS JOIN (SELECT unnest(range({reps})) AS rep)),
{name}_1 AS (SELECT * EXCLUDE ({drop}), {', '.join(second)} FROM {name}_0),
{name}_2 AS (SELECT * EXCLUDE ({drop}), {', '.join(third)} FROM {name}_1),
{name} AS (SELECT * EXCLUDE ({drop}), {', '.join(weights)} FROM {name}_2)"""
