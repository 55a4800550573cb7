"""Check dates, survival labels and windows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortspark.functions.calendar import add_months, checks_between, nth_check_date, rolling_windows, shift_check_dates, windows_frame
from cohortspark.operators.labels import LabelSpec, label_table, label_violations, spine_by_window, transitions

D = date.fromisoformat

EDGE = [
    ("2010-01-19", 1, "2010-01-20"), ("2010-01-20", 1, "2010-10-15"), ("2010-10-14", 1, "2010-10-15"), ("2010-10-15", 1, "2011-01-20"),
    ("2010-09-01", 3, "2011-10-15"), ("2010-01-20", -1, "2009-10-15"), ("2010-01-21", -1, "2010-01-20"), ("2010-10-15", -1, "2010-01-20"),
    ("2010-10-16", -1, "2010-10-15"), ("2013-06-01", -3, "2012-01-20"),
]


@pytest.mark.parametrize("day,n,expected", EDGE)
def test_check_date_edges(spark, day, n, expected):
    df = spark.createDataFrame([(D(day),)], "d date")
    assert df.select(nth_check_date("d", n)).first()[0] == D(expected)
    assert shift_check_dates(D(day), n) == D(expected)


def test_check_date_null_and_zero(spark):
    df = spark.createDataFrame([(None,)], "d date")
    assert df.select(nth_check_date("d", 2)).first()[0] is None
    assert shift_check_dates(None, 2) is None
    with pytest.raises(ValueError):
        nth_check_date("d", 0)
    with pytest.raises(ValueError):
        shift_check_dates(D("2010-01-01"), 0)


def _step(d, n):
    """Brute force: walk day by day over check dates."""
    left = abs(n)
    while left:
        d += timedelta(days=1 if n > 0 else -1)
        if (d.month, d.day) in ((1, 20), (10, 15)):
            left -= 1
    return d


def test_check_dates_equal_stepping(spark):
    days = [D("2011-11-01") + timedelta(days=i * 5) for i in range(160)]
    ns = (1, 2, 5, -1, -2, -5)
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select("d", *[nth_check_date("d", n).alias(str(n)) for n in ns]).collect()
    for r in rows:
        for n in ns:
            assert r[str(n)] == _step(r.d, n) == shift_check_dates(r.d, n)


def test_checks_between_equals_date_comparison(spark):
    days = [D("2012-01-15") + timedelta(days=i * 7) for i in range(40)] + [D("2012-01-20"), D("2012-10-15"), D("2013-01-20")]
    df = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date")
    for n in (1, 2):
        bad = df.filter((checks_between("a", "b") >= n) != (nth_check_date("a", n) < F.col("b")))
        assert bad.filter("b > a").count() == 0


SURVIVAL = [
    ("Withdrew", "2010-10-15", None, False), ("Withdrew", "2010-10-16", None, True), ("Withdrew", None, None, None),
    ("Transferred out", "2010-10-16", None, True), ("Graduated", "2010-10-01", None, None), ("Graduated", "2011-06-01", None, True),
    ("Attending", None, "2010-10-01", None), ("Attending", None, "2010-10-16", True), ("Attending", None, None, None),
    ("Matriculating", "2012-01-01", None, None), ("Did not matriculate", None, None, False),
]


def _enrolments(spark, rows):
    data = [(i, i, i, D("2010-09-01"), s, e and D(e), v and D(v)) for i, (s, e, v, *_) in enumerate(rows)]
    return spark.createDataFrame(data, "enrollid long, studentid long, collegeid long, start_date date, status string, end_date date, date_last_verified date")


def test_survival_truth_table(spark):
    got = {r.enrollid: r.persist_1_halfyear for r in label_table(_enrolments(spark, SURVIVAL)).collect()}
    assert [got[i] for i in range(len(SURVIVAL))] == [x[3] for x in SURVIVAL]


def test_label_rows_and_violations(spark):
    e = _enrolments(spark, [("Withdrew", None, None), ("Sabbatical", None, None), (None, None, None)])
    e = e.withColumn("start_date", F.when(F.col("enrollid") != 0, F.col("start_date")))
    assert label_table(e).count() == 1
    got = {(r.key, r.rule) for r in label_violations(e).collect()}
    assert got == {("0", "start_date missing"), ("1", "status unknown"), ("2", "status unknown")}


def test_windows(spark):
    w = rolling_windows(D("2008-09-01"), D("2010-09-01"), 36, 12, 12)
    assert [(x.start.year, x.split.year, x.end.year) for x in w] == [(2008, 2011, 2012), (2009, 2012, 2013), (2010, 2013, 2014)]
    frame = windows_frame(spark, D("2008-09-01"), D("2010-09-01"), 36, 12, 12).orderBy("window_id").collect()
    assert [(r.train_start, r.split_date, r.test_end) for r in frame] == [(x.start, x.split, x.end) for x in w]
    assert add_months(D("2011-01-31"), 1) == D("2011-02-28")


def test_target_bounds_move_back():
    assert LabelSpec(3).bounds(D("1998-01-01"), D("2000-06-01")) == (D("1996-10-15"), D("1999-01-20"))


def test_transition_needs_previous_survival(spark):
    e = _enrolments(spark, [("Withdrew", "2010-10-16", None), ("Withdrew", "2010-10-10", None)])
    got = {(r.enrollid, r.transition, r.persist) for r in transitions(e, D("2005-01-01"), D("2020-01-01")).collect()}
    assert got == {(0, "0->1", True), (0, "1->2", False), (1, "0->1", False)}


def test_spine_by_window_equals_per_window(spark):
    rows = [("Withdrew", "2012-01-01", None)] * 6
    e = _enrolments(spark, rows).withColumn("start_date", F.add_months("start_date", (F.col("enrollid") * 5).cast("int")))
    w = rolling_windows(D("2010-01-01"), D("2012-01-01"), 18, 12, 6)
    together = {(r.window_id, r.enrollid) for r in spine_by_window(e, LabelSpec(1), w).collect()}
    single = {(x.window_id, r.enrollid) for x in w for r in LabelSpec(1).spine(e, x.start, x.split).collect()}
    assert together == single and together
