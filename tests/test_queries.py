"""Every registered query against its DuckDB oracle on the smallest data set."""

import os

import pytest

from queries.catalogue import ORACLES, QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"
SLOW = {"model_grid"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, name):
    assert compare(spark, name, SF) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_no_row_at_a_time_python_in_plans(spark):
    for name in ("training_matrix", "label_table", "rank_family", "auc_exact", "integrate_enrollments"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_features_never_use_facts_after_the_split(spark):
    """Dropping every fact dated on or after the split must not change bounded features."""
    from pyspark.sql import functions as F

    from cohortspark.operators.matrix import assemble
    from queries.base import SPLIT, tables
    from queries.matrices import flagship_spec

    names = ("numberAPsYear12", "totalNumberofContacts", "AlumsEverAttendedSpecificCollege", "highestCompositeACT")
    t = tables(spark, SF)
    cut = dict(t)
    for table, column in (("courses", "grade_available"), ("contacts", "contact_date"), ("acttests", "date")):
        cut[table] = t[table].filter(F.col(column) < F.lit(SPLIT))
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    for part in ("train", "test"):
        assert key(assemble(t, flagship_spec(names), part)) == key(assemble(cut, flagship_spec(names), part))


def test_families_keep_the_spine(spark):
    from cohortspark.operators.features import CATALOGUE, Feature

    assert len(CATALOGUE) == 93
    with pytest.raises(ValueError):
        Feature("x", ("x",), "enrollid", "categorical", "survival")
    with pytest.raises(ValueError):
        Feature("x", ("x",), "other", "boolean", "survival")
