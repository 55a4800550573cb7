"""Metrics, resampling, models: edge cases and brute-force comparisons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortspark.operators import experiment as XP
from cohortspark.operators import metrics as E
from cohortspark.operators.models import ModelSpec, fit, nearest, neighbour_votes
from cohortspark.operators.resample import bootstrap_auc, bootstrap_mean, k_folds, replicate_weight


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(y * 0.7, 1.0), 1)
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, y int, s double")


def test_auc_ties_and_single_class(spark):
    same = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert E.auc(same, "y", "s").first().auc == 0.5
    one = spark.createDataFrame([(1, 0.1), (1, 0.5)], "y int, s double")
    assert E.auc(one, "y", "s").first().auc is None


def test_auc_equals_spark_evaluator(scored):
    raw = scored.withColumn("y", F.col("y").cast("double"))
    expected = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(raw)
    assert E.auc(scored, "y", "s").first().auc == pytest.approx(expected, abs=1e-12)


def test_precision_at_small_k_is_zero(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(9)], "id long, y int, s double")
    row = E.precision_top_k(df, 0.1, "y", "s", "id").first()
    assert (row.r, row.precision) == (0, 0.0)


@pytest.mark.parametrize("k", [0.1, 0.25, 0.333, 1.0])
def test_precision_top_k_equals_sort(scored, k):
    rows = sorted(scored.collect(), key=lambda r: (-r.s, r.id))
    r = int(k * len(rows))
    expected = sum(1 - x.y for x in rows[:r]) / r
    assert E.precision_top_k(scored, k, "y", "s", "id", pos_label=0).first().precision == pytest.approx(expected)


def test_summary_agrees_with_single_metrics(scored):
    row = E.ranking_summary(scored, "y", "s", (0.1,), 1).first()
    assert row.auc == pytest.approx(E.auc(scored, "y", "s").first().auc)
    assert row.aupr == pytest.approx(E.pr_area(scored, "y", "s").first().aupr)
    hits = row.hits0 + (E.edge_hits(scored, "y", "s", "id", row.edge0, row.take0).first().hits if row.take0 else 0)
    assert hits / row.r0 == pytest.approx(E.precision_top_k(scored, 0.1, "y", "s", "id").first().precision)


def test_curves(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    roc = sorted((r.fpr, r.tpr) for r in E.roc_points(df, "y", "s").collect())
    assert roc == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    pop = sorted((r.fraction, r.precision, r.recall) for r in E.population_curve(df, "y", "s").collect())
    assert pop == [(0.25, 1.0, 0.5), (0.5, 0.5, 0.5), (0.75, pytest.approx(2 / 3), 1.0)]
    # (0,1) (.5,1) (.5,.5) (1,2/3): trapezoids .5 and .5*(.5+2/3)/2
    assert E.pr_area(df, "y", "s").first().aupr == pytest.approx(0.5 + 0.5 * (0.5 + 2 / 3) / 2)


def test_folds_have_exact_sizes(spark):
    sizes = [r.n for r in k_folds(spark.range(103), "id", 10).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).orderBy("fold").collect()]
    assert sizes == [103 * (i + 1) // 10 - 103 * i // 10 for i in range(10)]


def test_bootstrap_interval_brackets_estimate_and_repeats(scored):
    estimate = E.auc(scored, "y", "s").first().auc
    a = bootstrap_auc(scored, "y", "s", n_boot=200, seed=1).first()
    b = bootstrap_auc(scored.repartition(7), "y", "s", n_boot=200, seed=1).first()
    c = bootstrap_auc(scored, "y", "s", n_boot=200, seed=1, parts=40).first()
    assert a.lower <= estimate <= a.upper and a.replicates == 200
    assert (a.lower, a.upper) == (b.lower, b.upper)
    assert (c.lower, c.upper) == (pytest.approx(a.lower), pytest.approx(a.upper))
    # roughly the normal-theory width
    assert 0.05 < a.upper - a.lower < 0.2


def test_bootstrap_mean_brackets_mean(scored):
    for r in bootstrap_mean(scored, "s", ["y"], n_boot=200, tasks=4).collect():
        assert r.lower < r["mean"] < r.upper


def test_replicate_weights_are_poisson(spark):
    w = spark.range(20000).select(replicate_weight("id", 4, 1).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(w.m - 1) < 0.03 and abs(w.v - 1) < 0.06


def _brute(points, k):
    out = {}
    for i, a in points:
        d = sorted((round(float(((a - b) ** 2).sum()), 9), j) for j, b in points if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def test_nearest_is_exact_with_skewed_blocks(spark):
    rng = np.random.default_rng(5)
    # a third of the points share one location
    pts = [(i, np.zeros(3) if i % 3 == 0 else rng.normal(size=3) * 4) for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in pts], "id long, v array<double>, y int")
    got = {}
    for r in nearest(df, df, 4, "id", "id", "v", "y", True, block_rows=16, query_rows=50, sample_pivots=5).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    assert {i: [j for _, j in sorted(x)] for i, x in got.items()} == _brute(pts, 4)


def test_distance_votes_let_exact_hits_decide(spark):
    nn = spark.createDataFrame([(1, 0.0, 1), (1, 0.5, 0), (1, 0.6, 0), (2, 1.0, 0), (2, 2.0, 1), (2, 4.0, 1)], "id long, distance double, y int")
    got = {r.id: (r.predicted, r.share) for r in neighbour_votes(nn, "id", "y", "distance").collect()}
    assert got[1] == (1, 1.0) and got[2][0] == 0 and got[2][1] == pytest.approx(1 / 1.75)


MODELS = [
    ModelSpec("LogisticRegression", {"C": 1.0, "max_iter": 10, "class_weight": "balanced"}), ModelSpec("SVM", {"max_iter": 5}),
    ModelSpec("RandomForest", {"n_estimators": 3, "max_depth": 3}), ModelSpec("GBC", {"n_estimators": 2}), ModelSpec("DTC", {"max_depth": 3}),
    ModelSpec("GNB"), ModelSpec("SGD", {"loss": "hinge", "max_iter": 5}), ModelSpec("AdaBoost", {"n_estimators": 3}), ModelSpec("KNN", {"n_neighbors": 7}),
]


@pytest.mark.parametrize("spec", MODELS, ids=lambda s: s.name)
def test_models_rank_better_than_chance(scored, spec):
    data = scored.withColumn("x", F.col("id") % 5).withColumnRenamed("id", XP.ROW_KEY)
    out = fit(spec, data, ["s", "x"], "y").score(data)
    assert out.count() == 400
    assert XP.evaluate(out, "y").auc > 0.6
    assert {r[0] for r in out.select("predicted").distinct().collect()} <= {0, 1}


def test_unknown_models_are_refused(scored):
    with pytest.raises(ValueError):
        fit(ModelSpec("SVM", {"kernel": "rbf"}), scored, ["s"], "y")
    with pytest.raises(ValueError):
        fit(ModelSpec("Other"), scored, ["s"], "y")


def test_coefficients_are_sorted(scored):
    scorer = fit(ModelSpec("LogisticRegression", {"max_iter": 5}), scored.withColumn("z", -F.col("s")), ["z", "s"], "y")
    names = [n for n, _ in scorer.coefficients()]
    assert names == ["s", "z"]


def test_grid_and_feature_lists():
    assert len(XP.parameter_grid({"a": [1, 2], "b": 3, "c": [4, 5]})) == 4
    assert list(XP.feature_lists(["a", "b", "c"])) == [("a", "b", "c")]
    assert len(list(XP.feature_lists(["a", "b", "c"], 2))) == 6
    with pytest.raises(ValueError):
        list(XP.feature_lists(["a"], 0))


def test_experiment_row(scored):
    data = scored.withColumn("x", F.when(F.col("id") % 10 != 0, F.col("s"))).withColumn("only_train", F.lit(1.0))
    row = XP.run_experiment(data.drop("id"), data.drop("id", "only_train"), ["x", "only_train"], "y", ModelSpec("DTC", {"max_depth": 2}), "lax")
    assert row["features"] == ["x"] and row["train_rows_dropped"] == 40 and row["train_max_nulls"] == 40
    assert 0.5 < row["auc"] <= 1 and sum(row["confusion"].values()) == 360


def test_neighbours_prune_and_bound_copies(spark):
    """Clustered points: most blocks are never visited; repeated points and queries, null vectors and empty tables."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 6)) * 50
    x = np.vstack([centres[i % 20] + rng.normal(size=6) for i in range(1500)] + [centres[0]] * 40)
    rows = [(i, [float(a) for a in v], i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (9999, None, 1)], "id long, v array<double>, y int").repartition(5)
    seen = {}
    got = {}
    for r in nearest(df, df, 5, "id", "id", "v", "y", block_rows=20, query_rows=30, visited=seen).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)))[:5]
        assert [n for _, n in sorted(got[i])] == [j for _, j in want] or [round(a, 6) for a, _ in sorted(got[i])] == [round(a, 6) for a, _ in want]
    assert seen["queries"] == len(x) and seen["visits"] < 0.3 * seen["queries"] * seen["blocks"]
    none = df.limit(0)
    assert nearest(df, none, 3, "id", "id", "v", "y").collect() == [] == nearest(none, df, 3, "id", "id", "v", "y").collect()
    assert nearest(df, df, 3, "id", "id", "v", "y").columns == nearest(df, none, 3, "id", "id", "v", "y").columns


def test_neighbours_out_of_no_order_travel_in_groups(spark):
    """Points without clusters: nothing is passed over, and yet a query is copied once per cell, not once per block."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, y int").repartition(4)
    seen, got = {}, {}
    for r in nearest(df, df, 3, "id", "id", "v", "y", True, block_rows=4, query_rows=90, visited=seen).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    assert {i: [j for _, j in sorted(n)] for i, n in got.items()} == _brute(list(enumerate(x)), 3)
    assert seen["visits"] > 0.9 * seen["queries"] * seen["blocks"] > 100 * seen["queries"] and seen["copies"] <= 20 * seen["queries"]


def test_neighbours_pass_over_all_points_of_their_id(spark):
    """Ids that repeat more often than k, and null ids: still k others each."""
    rows = [(i // 5, [float(i // 5), 0.0], i) for i in range(40)] + [(None, [0.1, 0.0], -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    got = {}
    for r in nearest(df, df, 3, "id", "id", "v", "y", exclude_self=True).collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbour))
    assert got == {i: [(1.0, i - 1 if i else 1)] * 3 for i in range(8)}


def test_frames_of_a_search_are_bounded():
    from cohortspark.operators import models as MO

    frame = pd.DataFrame({"x": range(10_000)})
    parts = list(MO._slices([frame, frame.iloc[:0]], 1024))
    assert pd.concat(parts).equals(frame) and max(map(len, parts)) * 1024 <= MO._SCRATCH


def test_neighbour_ties_do_not_depend_on_partitions(spark):
    train = spark.createDataFrame([(float(i % 3), int(i % 2)) for i in range(30)], "x double, y int")
    test = spark.createDataFrame([(1, 0.5), (2, 1.5)], "row_key long, x double")
    score = lambda t: sorted((r.row_key, r.score) for r in fit(ModelSpec("KNN", {"n_neighbors": 7}), t, ["x"], "y").score(test).collect())
    assert score(train.repartition(1)) == score(train.repartition(6).orderBy("y"))
