"""Exploration against numpy."""

import numpy as np
import pytest

from cohortspark.operators import explore as V


def test_pca_and_correlation_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.array([[1.0, 0.5, 0.0], [0.0, 1.0, 0.3], [0.0, 0.0, 2.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    corr = np.corrcoef(x.T)
    values = np.sort(np.linalg.eigvalsh(corr))[::-1]
    got = V.pca_variance(df, ["a", "b", "c"]).orderBy("component").collect()
    assert [r.variance for r in got] == pytest.approx(list(values / values.sum()))
    assert got[-1].cumulative == pytest.approx(1.0)
    cells = {(r.a, r.b): r["corr"] for r in V.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert cells[("a", "c")] == pytest.approx(corr[0, 2]) and len(cells) == 9
    scores = np.array([r.pc0 for r in V.pca_project(df, ["a", "b", "c"], ["id"]).collect()])
    assert scores.var(ddof=1) == pytest.approx(values[0])


def test_moments_do_not_depend_on_partitions(spark):
    """Large means, 120 columns, a constant one and nulls; equal to numpy however the rows lie."""
    from cohortspark.operators.gram import moments

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 120)) + 1e7
    x[:, 3] = 2.0
    x[:, 5] = x[:, 4] * 2 - 7
    names = [f"c.{i}" for i in range(120)]
    rows = [tuple(map(float, r)) for r in x] + [tuple([None] + [1.0] * 119)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))
    keep = [i for i in range(120) if i != 3]
    for parts in (1, 7):
        m = moments(df.repartition(parts), names)
        assert m.rows == 400 and np.allclose(m.mean, x.mean(0), rtol=1e-12)
        assert np.allclose(m.correlation()[np.ix_(keep, keep)], np.corrcoef(x[:, keep].T), atol=1e-7)
        assert np.isnan(m.correlation()[3]).all()
    cells = {(r.a, r.b): r["corr"] for r in V.correlation_matrix(df, names).collect()}
    assert len(cells) == 14_400 and cells["c.3", "c.0"] is None and abs(cells["c.4", "c.5"] - 1) < 1e-9
    assert moments(df.limit(0), names).rows == 0
    plan = V.pca_project(df, names, ["c.0".join("``")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
