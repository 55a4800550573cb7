"""Labels and training matrices."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from cohortspark.functions.calendar import nth_check_date, rolling_windows, windows_frame
from cohortspark.operators import experiment as XP
from cohortspark.operators import features as FT
from cohortspark.operators.labels import LabelSpec, label_table, spine_by_window, transitions
from cohortspark.operators.matrix import MatrixSpec, Restriction, analysis_frame, assemble, feature_columns, postprocess
from cohortspark.operators.windowed import assemble_windows
from queries.base import MEDIA, SPLIT, TEST_END, TRAIN_START, check_sql, oracle, query, raw, survived_sql, tables, view

_CHECKS = (1, 2, 3, 8, -1, -2, -3, -8)


def _check_name(n: int) -> str:
    return f"after_{n}" if n > 0 else f"before_{-n}"


@query(
    "check_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, "
    + ", ".join(f"{check_sql('CAST(o_orderdate AS DATE)', n)} AS {_check_name(n)}" for n in _CHECKS)
    + " FROM orders",
)
def check_dates(spark, sf):
    """N-th check date after and before each order date."""
    d = raw(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return d.select("o_orderkey", "d", *[nth_check_date("d", n).alias(_check_name(n)) for n in _CHECKS])


@query(
    "label_table",
    oracle(
        "enrolment",
        "SELECT enrollid, studentid, collegeid, "
        + ", ".join(f"{survived_sql(n)} AS persist_{n}_halfyear" for n in range(1, 9))
        + " FROM enrolment WHERE start_date IS NOT NULL AND status IS NOT NULL",
    ),
)
def labels(spark, sf):
    """Survival labels for 1..8 half-years."""
    return label_table(view(spark, sf, "enrolment"))


WINDOWS = rolling_windows(date(1996, 1, 1), date(1999, 1, 1), 24, 12, 12)

_WINDOW_ROWS = ", ".join(f"({w.window_id}, DATE '{w.start}', DATE '{w.split}', DATE '{w.end}')" for w in WINDOWS)


@query(
    "windowed_target",
    oracle(
        "enrolment",
        f"""WITH win(window_id, lo, split, hi) AS (VALUES {_WINDOW_ROWS}),
parts AS (SELECT window_id, 'train' AS part, lo AS a, split AS b FROM win
  UNION ALL SELECT window_id, 'test', split, hi FROM win),
shifted AS (SELECT window_id, part, {check_sql('a', -3)} AS a, {check_sql('b', -3)} AS b FROM parts)
SELECT s.window_id, s.part, e.enrollid, e.studentid, e.collegeid, {survived_sql(3, 'e.')} AS persist_3_halfyear
FROM enrolment e JOIN shifted s ON e.start_date >= s.a AND e.start_date < s.b
WHERE {survived_sql(3, 'e.')} IS NOT NULL""",
    ),
)
def windowed_target(spark, sf):
    """Train and test spines of every rolling window from one scan each."""
    e = view(spark, sf, "enrolment")
    spec = LabelSpec(3)
    frames = [spine_by_window(e, spec, WINDOWS, p).withColumn("part", F.lit(p)) for p in ("train", "test")]
    return frames[0].unionByName(frames[1])


@query(
    "window_schedule",
    """SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INT) AS window_id, CAST(s AS DATE) AS train_start,
  CAST(s + INTERVAL 24 MONTH AS DATE) AS split_date, CAST(s + INTERVAL 36 MONTH AS DATE) AS test_end,
  (SELECT count(*) FROM orders WHERE o_orderdate >= s AND o_orderdate < s + INTERVAL 24 MONTH) AS train_orders
FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1999-01-01', INTERVAL 6 MONTH)) AS s)""",
)
def window_schedule(spark, sf):
    """Windows generated in Spark, with the orders that fall into each training period."""
    w = windows_frame(spark, date(1996, 1, 1), date(1999, 1, 1), 24, 12, 6)
    # half-year slots turn the range condition into an equality on month numbers
    month = lambda c: F.year(c) * 12 + F.month(c)
    per_month = raw(spark, sf, "orders").groupBy(month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    spread = w.withColumn("m", F.explode(F.sequence(month("train_start"), month("split_date") - 1)))
    counts = spread.join(per_month, "m", "left").groupBy(*w.columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_orders"))
    return counts


@query(
    "transition_rates",
    oracle(
        "enrolment",
        "WITH steps AS ("
        + " UNION ALL ".join(
            f"SELECT '{n - 1}->{n}' AS transition, {survived_sql(n)} AS persist FROM enrolment"
            f" WHERE start_date >= {check_sql(f'''DATE '{TRAIN_START}' ''', -n)} AND start_date < {check_sql(f'''DATE '{SPLIT}' ''', -n)}"
            + (f" AND ({survived_sql(n - 1)})" if n > 1 else "")
            for n in range(1, 9)
        )
        + """) SELECT transition, count(*) AS n, CAST(sum(CAST(persist AS INT)) AS BIGINT) AS n_persist,
  round(avg(CAST(persist AS INT)), 10) AS rate FROM steps WHERE persist IS NOT NULL GROUP BY transition""",
    ),
)
def transition_rates(spark, sf):
    """Conditional survival 0->1 ... 7->8 from one scan."""
    t = transitions(view(spark, sf, "enrolment"), TRAIN_START, SPLIT)
    hit = F.col("persist").cast("int")
    return t.groupBy("transition").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("n_persist"), F.round(F.avg(hit), 10).alias("rate")
    )


# --- flagship -------------------------------------------------------------------

MATRIX_FEATURES = (
    "IsFirstEnrollment", "SpringEnrollment", "StudentAgeAtEnrollment", "StudentGender", "everSpecialEd",
    "numberAPsYear12", "numberHonsYear11", "maxRankYear12", "avgRankYear11", "year12GPA",
    "AlumsEverAttendedSpecificCollege", "avgNetPrice", "is4year",
    "totalNumberofContacts", "numberUnsuccessfulContacts", "AvgHSTardy",
)


def flagship_spec(features=MATRIX_FEATURES, **kw) -> MatrixSpec:
    return MatrixSpec(
        target=LabelSpec(3),
        features=features,
        train_start=TRAIN_START,
        split=SPLIT,
        test_end=TEST_END,
        restrictions=(
            Restriction("DegreeType", F.col("degree_type") == "1-URGENT", "= '1-URGENT'"),
            Restriction("PersistTwoSemesters"),
        ),
        **kw,
    )


def _rounded(df, columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 10) for c in columns})


_FEATURE_SQL = f"""
firsts AS (SELECT studentid, min(start_date) AS f FROM enrolment WHERE status <> 'Did not matriculate' GROUP BY 1),
enr AS (SELECT e.enrollid, NOT coalesce(f.f < e.start_date, FALSE) AS is_first_enrollment,
    month(e.start_date) IN (12, 1, 2, 3, 4) AS is_spring,
    CAST(date_part('year', age(CAST(e.start_date AS TIMESTAMP), CAST(p.date_of_birth AS TIMESTAMP))) AS INT) AS age_at_enrollment
  FROM enrolment e LEFT JOIN firsts f USING (studentid) LEFT JOIN person p USING (studentid)),
graded AS (SELECT *, percent_rank() OVER (PARTITION BY course_number ORDER BY percent_grade ASC NULLS LAST) AS pr,
    high_school_class - year_taken AS gap FROM course),
adv AS (SELECT studentid, sum(CASE WHEN gap = 0 THEN CAST(was_ap AS INT) END) AS numberapsyear12,
    sum(CASE WHEN gap = 1 THEN CAST(was_honors AS INT) END) AS numberhonsyear11,
    max(CASE WHEN gap = 0 AND semester_taken <> 3 THEN pr END) AS maxrankyear12,
    avg(CASE WHEN gap = 1 AND semester_taken <> 3 THEN pr END) AS avgrankyear11
  FROM graded WHERE grade_available < DATE '{SPLIT}' GROUP BY 1),
gpa AS (SELECT t.studentid, CASE WHEN count(unweighted_gpa) = 1 THEN avg(unweighted_gpa) END AS year12_unweightedgpa
  FROM school_term t JOIN person p USING (studentid) WHERE p.high_school_class = t.school_year GROUP BY 1),
alum AS (SELECT collegeid, count(*) AS alum_count FROM enrolment
  WHERE status NOT IN ('Matriculating', 'Did not matriculate') AND start_date < DATE '{SPLIT}' GROUP BY 1),
con AS (SELECT studentid, count(*) AS num_contacts, nullif(sum(CAST(was_successful = FALSE AS INT)), 0) AS total_unsuccessful_contacts
  FROM contact WHERE contact_date < DATE '{SPLIT}' GROUP BY 1),
cells AS (SELECT a.studentid, p.high_school_class - a.school_year AS gap, count(*) AS n FROM attendance a JOIN person p USING (studentid)
  WHERE attendance_type = 'tardy' AND p.high_school_class - a.school_year BETWEEN 0 AND 3 GROUP BY 1, 2),
att AS (SELECT studentid, avg(n) AS avghstardy FROM cells GROUP BY 1)"""

_JOINS = """LEFT JOIN enr USING (enrollid) LEFT JOIN person p USING (studentid) LEFT JOIN adv USING (studentid)
LEFT JOIN gpa USING (studentid) LEFT JOIN con USING (studentid) LEFT JOIN att USING (studentid)
LEFT JOIN alum USING (collegeid) LEFT JOIN provider c USING (collegeid)"""

_SPINE = f"""
spine AS (SELECT enrollid, studentid, collegeid, {survived_sql(3)} AS persist_3_halfyear FROM enrolment
  WHERE start_date >= {check_sql(f"DATE '{TRAIN_START}'", -3)} AND start_date < {check_sql(f"DATE '{SPLIT}'", -3)}
    AND ({survived_sql(3)}) IS NOT NULL AND degree_type = '1-URGENT' AND ({survived_sql(2)}))"""

_VIEWS = "enrolment course contact person provider attendance school_term"
_FLOATS = ("maxrankyear12", "avgrankyear11", "year12_unweightedgpa", "avgnetprice", "AvgHSTardy")


@query(
    "training_matrix",
    oracle(
        _VIEWS,
        f"""WITH {_FEATURE_SQL}, {_SPINE}
SELECT s.enrollid, s.studentid, s.collegeid, s.persist_3_halfyear, enr.is_first_enrollment, enr.is_spring,
  enr.age_at_enrollment, p.is_female, p.ever_special_ed, CAST(adv.numberapsyear12 AS BIGINT) AS numberapsyear12,
  CAST(adv.numberhonsyear11 AS BIGINT) AS numberhonsyear11, round(adv.maxrankyear12, 10) AS maxrankyear12,
  round(adv.avgrankyear11, 10) AS avgrankyear11, round(gpa.year12_unweightedgpa, 10) AS year12_unweightedgpa,
  alum.alum_count, round(c.avgnetprice, 10) AS avgnetprice, c.is4year, con.num_contacts,
  CAST(con.total_unsuccessful_contacts AS BIGINT) AS total_unsuccessful_contacts, round(att.avghstardy, 10) AS "AvgHSTardy"
FROM spine s {_JOINS}""",
    ),
)
def training_matrix(spark, sf):
    """The flagship point-in-time matrix."""
    return _rounded(assemble(tables(spark, sf), flagship_spec(), "train"), _FLOATS)


@query(
    "analysis_frame",
    oracle(
        _VIEWS,
        f"""WITH {_FEATURE_SQL}, {_SPINE},
m AS (SELECT s.*, enr.is_spring, p.ever_special_ed, p.ethnicity, c.avgnetprice, alum.alum_count FROM spine s {_JOINS})
SELECT enrollid, studentid, collegeid, persist_3_halfyear AS persist, is_spring,
  CAST(ever_special_ed IS NULL AS INT) AS ever_special_ed_isnull, coalesce(ever_special_ed, FALSE) AS ever_special_ed,
  """
        + ",\n  ".join(
            f"CAST(coalesce(ethnicity = '{v}', FALSE) AS INT) AS \"ethnicity_{v}\""
            for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
        )
        + """,
  CAST(avgnetprice IS NULL AS INT) AS avgnetprice_isnull, round(coalesce(avgnetprice, 0), 10) AS avgnetprice,
  coalesce(alum_count, 0) AS alum_count FROM m""",
    ),
)
def analysis(spark, sf):
    """Postprocessed analysis frame with a constant target name."""
    spec = flagship_spec(("SpringEnrollment", "everSpecialEd", "StudentEthnicity", "avgNetPrice", "AlumsEverAttendedSpecificCollege"))
    frame, _ = analysis_frame(tables(spark, sf), spec)
    return _rounded(frame, ["avgnetprice"])


WINDOW_FEATURES = (
    *MATRIX_FEATURES, "highestCompositeACT", "mediumOfLastSuccessfulContact", "numberOfCounselors", "numberContactsInitiatedByStudent",
    "ContactMediumPercentages", "TotalAttendance", "YearlyAvgAttendance", "AvgHSAway", "AvgMSTardy", "minRankYear10", "degreeSubject", "Major",
)

#: Feature columns that are compared to ten digits.
ROUNDED = {c: c in {*_FLOATS, "minrankyear10", *FT.CONTACT_MEDIA, "YearlyAvgAttendance", "AvgHSAway", "AvgMSTardy"} for c in feature_columns(WINDOW_FEATURES)}
_ATT = "a.attendance_type IN ('tardy', 'unexcused', 'suspended', 'excused', 'early_dismissal')"
_UPPER = "gap BETWEEN 0 AND 3"
_SHARES = ", ".join(f"100.0::DOUBLE * count(*) FILTER (m = '{m}') / nullif(count(m), 0) AS \"{m}\"" for m in FT.CONTACT_MEDIA)
_TOTALS = ", ".join(
    f"CASE WHEN sum(n) FILTER ({_UPPER}) > 0 THEN CAST(coalesce(sum(n) FILTER ({_UPPER} AND attendance_type = '{t}'), 0) AS BIGINT) END AS \"HSTotal_{t}\""
    for t in FT.ATTENDANCE_TYPES
)
_WINDOW_COLUMNS = {
    "is_first_enrollment": "enr.is_first_enrollment", "is_spring": "enr.is_spring", "age_at_enrollment": "enr.age_at_enrollment",
    "is_female": "p.is_female", "ever_special_ed": "p.ever_special_ed", "numberapsyear12": "CAST(adv.aps AS BIGINT)",
    "numberhonsyear11": "CAST(adv.hons AS BIGINT)", "maxrankyear12": "adv.maxr", "avgrankyear11": "adv.avgr", "minrankyear10": "adv.minr",
    "year12_unweightedgpa": "gpa.year12_unweightedgpa", "alum_count": "alum.alum_count", "avgnetprice": "c.avgnetprice", "is4year": "c.is4year",
    "degree_subject": "CASE WHEN s.start_date < s.split THEN s.degree_subject END", "major": "CASE WHEN s.start_date < s.split THEN s.major END",
}


@query(
    "windowed_catalogue",
    oracle(
        _VIEWS + " test_score",
        f"""WITH win(window_id, lo, split, hi) AS (VALUES {_WINDOW_ROWS}), {_FEATURE_SQL.strip().split("graded AS")[0].rstrip().rstrip(",")},
parts AS (SELECT window_id, split, 'train' AS part, lo AS a, split AS b FROM win UNION ALL SELECT window_id, split, 'test', split, hi FROM win),
shifted AS (SELECT window_id, split, part, {check_sql('a', -3)} AS a, {check_sql('b', -3)} AS b FROM parts),
s AS (SELECT w.window_id, w.part, w.split, e.*, {survived_sql(3, 'e.')} AS persist_3_halfyear FROM enrolment e JOIN shifted w ON e.start_date >= w.a AND e.start_date < w.b
  WHERE ({survived_sql(3, 'e.')}) IS NOT NULL AND e.degree_type = '1-URGENT' AND ({survived_sql(2, 'e.')})),
graded AS (SELECT *, percent_rank() OVER (PARTITION BY course_number ORDER BY percent_grade ASC NULLS LAST) AS pr, high_school_class - year_taken AS gap FROM course),
adv AS (SELECT w.window_id, studentid, sum(CASE WHEN gap = 0 THEN CAST(was_ap AS INT) END) AS aps, sum(CASE WHEN gap = 1 THEN CAST(was_honors AS INT) END) AS hons,
    max(CASE WHEN gap = 0 AND semester_taken <> 3 THEN pr END) AS maxr, avg(CASE WHEN gap = 1 AND semester_taken <> 3 THEN pr END) AS avgr,
    min(CASE WHEN gap = 2 AND semester_taken <> 3 THEN pr END) AS minr
  FROM graded JOIN win w ON grade_available < w.split GROUP BY 1, 2),
gpa AS (SELECT t.studentid, CASE WHEN count(unweighted_gpa) = 1 THEN avg(unweighted_gpa) END AS year12_unweightedgpa
  FROM school_term t JOIN person p USING (studentid) WHERE p.high_school_class = t.school_year GROUP BY 1),
alum AS (SELECT w.window_id, collegeid, count(*) AS alum_count FROM enrolment JOIN win w ON start_date < w.split
  WHERE status NOT IN ('Matriculating', 'Did not matriculate') GROUP BY 1, 2),
ct AS (SELECT *, CASE contact_medium {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MEDIA.items())} ELSE contact_medium END AS m FROM contact),
con AS (SELECT w.window_id, studentid, count(*) AS num_contacts, nullif(count(*) FILTER (initiated_by_student), 0) AS student_initiated_contacts,
    nullif(count(*) FILTER (NOT was_successful), 0) AS total_unsuccessful_contacts, count(DISTINCT counselor_id) AS number_counselors,
    (list(m ORDER BY contact_date DESC, m DESC NULLS LAST) FILTER (was_successful))[1] AS last_contact_medium, {_SHARES}
  FROM ct JOIN win w ON contact_date < w.split GROUP BY 1, 2),
act AS (SELECT w.window_id, studentid, max(score_composite) AS max_composite_act_score FROM test_score JOIN win w ON date < w.split WHERE test_level = 'ACT' GROUP BY 1, 2),
allc AS (SELECT a.studentid, p.high_school_class - a.school_year AS gap, attendance_type, count(*) AS n FROM attendance a JOIN person p USING (studentid)
  WHERE {_ATT} AND p.high_school_class - a.school_year BETWEEN 0 AND 6 GROUP BY ALL),
alla AS (SELECT studentid, avg(n) FILTER ({_UPPER} AND attendance_type = 'tardy') AS "AvgHSTardy", avg(n) FILTER (gap > 3 AND attendance_type = 'tardy') AS "AvgMSTardy",
  avg(n) FILTER ({_UPPER} AND attendance_type IN ('tardy', 'unexcused', 'early_dismissal')) AS "AvgHSAway" FROM allc GROUP BY 1),
winc AS (SELECT w.window_id, a.studentid, p.high_school_class - a.school_year AS gap, attendance_type, count(*) AS n FROM attendance a JOIN person p USING (studentid)
  JOIN win w ON a.attendance_date < w.split WHERE {_ATT} AND p.high_school_class - a.school_year BETWEEN 0 AND 6 GROUP BY ALL),
wina AS (SELECT window_id, studentid, avg(n) FILTER ({_UPPER}) AS "YearlyAvgAttendance", {_TOTALS} FROM winc GROUP BY 1, 2)
SELECT s.window_id, s.part, s.enrollid, s.studentid, s.collegeid, s.persist_3_halfyear, {', '.join(
            (f'round({_WINDOW_COLUMNS.get(c) or chr(34) + c + chr(34)}, 10)' if ROUNDED[c] else (_WINDOW_COLUMNS.get(c) or chr(34) + c + chr(34))) + f' AS "{c}"' for c in feature_columns(WINDOW_FEATURES))}
FROM s LEFT JOIN enr USING (enrollid) LEFT JOIN person p USING (studentid) LEFT JOIN adv USING (window_id, studentid) LEFT JOIN gpa USING (studentid)
LEFT JOIN con USING (window_id, studentid) LEFT JOIN act USING (window_id, studentid) LEFT JOIN alla USING (studentid) LEFT JOIN wina USING (window_id, studentid)
LEFT JOIN alum USING (window_id, collegeid) LEFT JOIN provider c USING (collegeid)""",
    ),
)
def windowed_catalogue(spark, sf):
    """The point-in-time catalogue of every rolling window, train and test, from one job."""
    out = assemble_windows(tables(spark, sf), flagship_spec(WINDOW_FEATURES), WINDOWS)
    return _rounded(out, [c for c in feature_columns(WINDOW_FEATURES) if ROUNDED[c]])


@query("matrix_train_test")
def matrix_train_test(spark, sf):
    """Train and test matrices encoded alike, stacked with their part."""
    t, spec = tables(spark, sf), flagship_spec()
    train, test, _ = postprocess(assemble(t, spec, "train"), assemble(t, spec, "test"), spec.features)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("full_catalogue_matrix")
def full_catalogue(spark, sf):
    """Every catalogue feature on one spine (feature families joined once each)."""
    options = FT.Options(networks={"is_partner_a": "AFRICA", "is_partner_b": "ASIA"})
    names = [n for n in FT.CATALOGUE if n != "PersistThreeSemesters"]
    return assemble(tables(spark, sf), flagship_spec(names, options=options), "train")


@query("experiment_grid")
def experiment_grid(spark, sf):
    """Windows x models x feature lists on the flagship matrix, one row per experiment."""
    features = ("numberAPsYear12", "totalNumberofContacts", "SpringEnrollment", "avgNetPrice")
    specs = [flagship_spec(features), replace(flagship_spec(features), split=date(1999, 9, 1), test_end=SPLIT)]
    models = {"GNB": {}, "DTC": {"max_depth": [1, 3]}}
    rows = XP.run_grid(tables(spark, sf), specs, models, [features], null_policy="lax")
    return XP.results_frame(spark, rows).drop("seconds")
