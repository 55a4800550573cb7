"""All windows in one job equal the single-window matrices, and read each fact table once."""

import re
from dataclasses import replace
from datetime import date

import pytest

from cohortspark.functions.calendar import Window
from cohortspark.operators import features as FT
from cohortspark.operators.labels import LabelSpec
from cohortspark.operators.matrix import MatrixSpec, Restriction, assemble
from cohortspark.operators.windowed import assemble_windows, part_of
from queries.base import tables
from queries.matrices import flagship_spec

SF = "/root/testdata/sf0.001"
WINDOWS = [Window(0, date(1996, 1, 1), date(1998, 1, 1), date(1999, 1, 1)), Window(3, date(1997, 6, 1), date(1999, 6, 1), None)]
NAMES = [n for n in FT.CATALOGUE if n != "PersistThreeSemesters"]


def key(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"rank_point_in_time": True, "bound_attendance_averages": True, "latest_nulls": "last"}])
def test_every_window_equals_its_own_matrix(spark, options):
    t = tables(spark, SF)
    o = FT.Options(networks={"is_partner_a": "AFRICA", "is_partner_b": "ASIA"}, **options)
    spec = replace(flagship_spec(NAMES, options=o), restrictions=(Restriction("PersistTwoSemesters"),))
    matrix = assemble_windows(t, spec, WINDOWS).cache()
    for w in WINDOWS:
        for part in ("train", "test"):
            one = assemble(t, replace(spec, train_start=w.start, split=w.split, test_end=w.end), part)
            got = part_of(matrix, w.window_id, part)
            assert got.columns == one.columns and got.dtypes == one.dtypes
            assert key(got) == key(one) and one.count() > 0
    matrix.unpersist()


def test_each_fact_table_is_read_once(spark):
    """However many windows: one scan of the contacts, and no more scans than for one window."""
    t, scans = tables(spark, SF), []
    spec = flagship_spec(NAMES, options=FT.Options(networks={"is_partner_a": "A", "is_partner_b": "B"}))
    for windows in (WINDOWS[:1], WINDOWS):
        plan = assemble_windows(t, spec, windows)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet.*events\.parquet", plan)) == 1  # contacts
        scans.append(plan.count("FileScan parquet"))
    assert scans[0] == scans[1]


def test_no_window_and_repeated_ids(spark):
    spec = MatrixSpec(LabelSpec(3), ["numberAPsYear12", "Major"], date(1998, 1, 1), date(2000, 1, 1))
    with pytest.raises(ValueError):
        assemble_windows(tables(spark, SF), spec, [WINDOWS[0], WINDOWS[0]])
