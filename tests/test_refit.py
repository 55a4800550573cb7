"""Refits: every replicate equals a single weighted fit; weights are the same in numpy and in columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import refit
from cohortspark.operators.experiment import k_fold_auc, k_fold_scores
from cohortspark.operators.models import ModelSpec, fit
from cohortspark.operators.resample import k_folds, poisson_weights, replicate_weight, weight_key


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=600), rng.normal(size=600) * 3
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * a - 0.3 * b - 0.5)))).astype(int)
    rows = [(i, float(x), float(z), float(i % 2), int(t)) for i, (x, z, t) in enumerate(zip(a, b, y))]
    return spark.createDataFrame([*rows, (1000, None, 1.0, 0.0, 1), (1001, 1.0, 1.0, 0.0, None)], "id long, a double, b double, cd double, y int").repartition(5)


def test_replicates_equal_single_weighted_fits(spark, data):
    groups = {"one": ["a"], "all": ["b", "a", "cd"]}
    coef = refit.fit_many(data, "id", groups, "y", refit.Bootstrap(4, 7), C=0.5)
    assert coef["one"].shape == (5, 2) and coef["all"].shape == (5, 4)
    clean = data.dropna().coalesce(1).cache()  # one partition: the single fits run a job per iteration
    for g, columns in groups.items():
        for r in (0, 1, 4):
            weighted = clean.withColumn("w", F.lit(1.0) if r == 0 else replicate_weight("id", r - 1, 7)).filter("w > 0")
            one = fit(ModelSpec("LogisticRegression", {"C": 0.5, "max_iter": 500}), weighted, columns, "y", "w").model
            assert np.allclose(coef[g][r], [*one.coefficients.toArray(), one.intercept], atol=2e-3), (g, r)


def test_without_penalty_scores_are_weighted_shares(spark, data):
    rows = data.dropna().select("id", F.col("cd").alias("x"), "y")
    coef = refit.fit_many(rows, "id", {"x": ["x"]}, "y", refit.Bootstrap(20), C=1e15)["x"]
    table = rows.toPandas()
    keys = rows.select("id", *[k.alias(n) for k, n in zip(weight_key(0, ["id"]), ("k1", "k2"))]).toPandas().set_index("id").loc[table.id]
    w = poisson_weights(keys.k1.to_numpy(), keys.k2.to_numpy(), np.ones(len(table), int), 20)
    for r in range(20):
        for x in (0.0, 1.0):
            at = (table.x == x).to_numpy()
            share = (w[at, r] * table.y[at]).sum() / w[at, r].sum()
            assert 1 / (1 + np.exp(-(coef[r + 1, 0] * x + coef[r + 1, 1]))) == pytest.approx(share, abs=1e-7)


def test_partitions_and_blocks_do_not_matter(spark, data, monkeypatch):
    args = ("id", {"all": ["a", "b"]}, "y", refit.Bootstrap(30, 1))
    whole = refit.fit_many(data, *args)["all"]
    monkeypatch.setattr(refit, "BLOCK_NUMBERS", 25)
    monkeypatch.setattr(refit, "ROWS", 17)
    assert np.allclose(refit.fit_many(data.repartition(2), *args)["all"], whole, atol=1e-6)


def test_separable_constant_and_empty(spark):
    rows = [(i, float(i > 5), 1.0, int(i > 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, x double, c double, y int")
    coef = refit.fit_many(df, "id", {"x": ["x"], "c": ["c"]}, "y", refit.Bootstrap(10))
    assert np.isfinite(coef["x"]).all() and (coef["x"][:, 0] > 0).all() and np.abs(coef["c"][:, 0]).max() < 5
    got = refit.auc_by_feature_group(df, df, {"x": ["x"], "c": ["c"]}, "y", "id", n_boot=10).collect()
    assert {r.feature_group: (r.lower, r.auc, r.upper) for r in got} == {"x": (1.0, 1.0, 1.0), "c": (0.5, 0.5, 0.5)}
    assert refit.auc_by_feature_group(df, df.limit(0), {"x": ["x"]}, "y", "id", n_boot=3).collect() == []


def test_replicate_cells_against_plain_scores(spark, data):
    clean = data.dropna()
    coef = refit.fit_many(data, "id", {"all": ["a", "b"]}, "y", refit.Bootstrap(3))
    got = {r.rep: r.auc for r in refit.E.auc_of_cells(refit.replicate_cells(clean, {"all": ["a", "b"]}, "y", coef), ["feature_group", "rep"]).collect()}
    t = clean.toPandas()
    for r in range(4):
        z = t.a * coef["all"][r, 0] + t.b * coef["all"][r, 1]
        pos, neg = z[t.y == 1].to_numpy(), z[t.y == 0].to_numpy()
        assert got[r] == pytest.approx((pos[:, None] > neg).mean(), abs=1e-9)


def test_aucs_of_packed_runs_equal_those_of_cells(spark, data, monkeypatch):
    """Many ranges, short runs, ties, counts beyond a byte and unknown scores: the same AUC, bit by bit, and no row per test row and fit."""
    groups = {"all": ["a", "b"], "cd": ["cd"]}
    coef = refit.fit_many(data, "id", groups, "y", refit.Bootstrap(20))
    coef["cd"][3] = np.nan
    test = data.unionByName(data.select("id", F.round("a", 0).alias("a"), F.lit(1.0).alias("b"), "cd", "y").withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(299)))))
    want = {(r.feature_group, r.rep): tuple(r) for r in refit.E.auc_of_cells(refit.replicate_cells(test, groups, "y", coef), ["feature_group", "rep"]).collect()}
    for rows, span in ((refit.CELLS, refit.RANGE), (50, 40)):
        monkeypatch.setattr(refit, "CELLS", rows)
        monkeypatch.setattr(refit, "RANGE", span)
        out = refit.replicate_aucs(test, groups, "y", coef)
        got = {(r.feature_group, r.rep): tuple(r) for r in out.collect()}
        assert len(got) == 42 and got == want
    assert got["cd", 3][2] == 0.5
    monkeypatch.setattr(refit, "replicate_cells", None)
    assert refit.auc_by_feature_group(data, test, groups, "y", "id", n_boot=5).count() == 2


def test_fits_spread_over_all_cores(spark, data):
    """Few bytes meet all fits: adaptive execution must not put them into one task."""
    few = data.groupBy("id", "a", "b", "cd", "y").count()
    assert refit._dealt(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_folds_in_one_solve_equal_single_fits(spark, data):
    spec = ModelSpec("LogisticRegression", {"C": 1.0, "max_iter": 500})
    scores = k_fold_scores(data, "id", ["a", "b"], "y", spec, k=3)
    got = {r.id: (r.fold, r.score) for r in scores.collect()}
    folded = k_folds(data, "id", 3).dropna().coalesce(1).cache()
    assert {r.id: r.fold for r in folded.collect()} == {i: f for i, (f, _) in got.items()}
    for i in range(3):
        scorer = fit(spec, folded.filter(F.col("fold") != i), ["a", "b"], "y")
        for r in scorer.score(folded.filter(F.col("fold") == i)).collect():
            assert got[r.id][1] == pytest.approx(r.score, abs=2e-3)
    assert 0.7 < k_fold_auc(scores, "y").first()["mean"] < 0.95


def test_weights_are_poisson_and_unrelated():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(0, 2**31 - 1, 3000), rng.integers(0, 2**31 - 1, 3000)
    for count in (1, 5, 63, 64, 900):
        w = poisson_weights(k1, k2, np.full(3000, count), 400)
        assert abs(w.mean() - count) < 0.01 * count + 0.01 and abs(w.var() - count) < 0.02 * count
    w, v = poisson_weights(k1, k2, np.ones(3000, int), 400), poisson_weights(k1, k2, np.ones(3000, int), 400, 2)
    assert abs(np.corrcoef(w.ravel(), v.ravel())[0, 1]) < 0.005
    assert abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.005
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.005


def test_columns_and_arrays_agree(spark):
    df = spark.range(500)
    keys = df.select("id", *[k.alias(n) for k, n in zip(weight_key(3, ["id"]), ("k1", "k2"))]).toPandas()
    w = poisson_weights(keys.k1.to_numpy(), keys.k2.to_numpy(), np.ones(500, int), np.array([0, 9, 1499]))
    got = df.select("id", *[replicate_weight("id", r, 3).alias(f"r{r}") for r in (0, 9, 1499)]).toPandas()
    assert (got[["r0", "r9", "r1499"]].to_numpy() == w).all()
