"""Cases where an answer was once wrong without an error."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.contracts import CONTRACTS
from cohortspark.operators import explore as V
from cohortspark.operators import joins as J
from cohortspark.operators import metrics as E
from cohortspark.operators import rows as R
from cohortspark.operators.experiment import evaluate, k_fold_scores
from cohortspark.operators.features import windowed_aggregates
from cohortspark.operators.models import ModelSpec, _depth, check_parameters, fit, nearest
from cohortspark.plans import integration as I


def test_depth_is_never_cut_silently():
    assert _depth(None) == 30 and _depth(7) == 7
    with pytest.raises(ValueError):
        _depth(100)


def test_neighbours_of_tiny_vectors(spark):
    rows = [(i, [i * 1e-6], i) for i in range(100)]
    e = spark.createDataFrame(rows, "id long, v array<double>, y long")
    out = nearest(e, e, 1, "id", "id", "v", "y", exclude_self=True, sample_pivots=2).collect()
    assert all(abs(r.id - r.neighbour) == 1 for r in out) and len(out) == 100


def test_repeated_rows_in_the_neighbour_scorer(spark):
    """Three equal test rows; of the three nearest training rows, which are equal too, one is positive."""
    train = spark.createDataFrame([(0.0, 0), (0.0, 0), (0.0, 1), (9.0, 1), (9.0, 1)], "x double, y int")
    test = spark.createDataFrame([(0.0, 0)] * 3, "x double, y int").withColumn("row_key", F.xxhash64("x", "y"))
    out = fit(ModelSpec("KNN", {"n_neighbors": 3}), train, ["x"], "y").score(test).collect()
    assert [round(r.score, 9) for r in out] == [round(1 / 3, 9)] * 3


def test_top_k_cuts_through_equal_ties(spark):
    df = spark.createDataFrame([(1, 0.5, 7)] * 4 + [(0, 0.5, 7)] * 2, "y int, s double, t long")
    assert E.precision_top_k(df, 0.5, "y", "s", "t").first()["precision"] == 1.0
    two = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit(None)))
    assert [r["precision"] for r in E.precision_top_k(two, 0.5, "y", "s", "t", ["g"]).collect()] == [1.0, 1.0]


def test_evaluation_with_equal_row_keys(spark):
    df = spark.createDataFrame([(0, 0.2, 0, 1)] * 6 + [(1, 0.9, 1, 2)] * 14, "y int, score double, predicted int, row_key long")
    found = evaluate(df, "y")
    assert found.precision0_top10 == 1.0 and found.precision0_top25 == 1.0 and found.auc == 1.0


def test_ids_do_not_follow_the_cluster(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("x"))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, J.assign_ids([df], "id").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and [r[0] for r in seen[0]] == list(range(1, 301))


@pytest.mark.parametrize("width", [3, 14])
def test_constant_columns_have_no_correlation(spark, width):
    names = [f"c.{i}" for i in range(width)]
    data = [[float(5 if i == 0 else (r * (i + 3)) % 7 + r) for i in range(width)] for r in range(20)]
    df = spark.createDataFrame([tuple(x) for x in data], ", ".join(f"`{n}` double" for n in names))
    got = {(r.a, r.b): r["corr"] for r in V.correlation_matrix(df, names).collect()}
    want = np.corrcoef(np.array(data)[:, 1:].T)
    assert len(got) == width * width and all(got[("c.0", n)] is None for n in names)
    assert all(abs(got[(names[i + 1], names[j + 1])] - want[i, j]) < 1e-9 for i in range(width - 1) for j in range(width - 1))
    pairs = V.pairwise_fit(df.withColumn("g", F.lit(1)), names[:3], ["g"]).collect()
    assert {(p.x, p.y): p["corr"] is None for p in pairs} == {("c.0", "c.1"): True, ("c.0", "c.2"): True, ("c.1", "c.2"): False}


def test_regression_ignores_half_known_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 5.0), (1, 3.0, 7.0), (1, 100.0, None), (1, None, 9.0)], "g int, x double, y double")
    fit_ = V.pairwise_fit(df, ["x", "y"], ["g"]).first()
    assert (round(fit_.slope, 9), round(fit_.intercept, 9), round(fit_["corr"], 9)) == (2.0, 1.0, 1.0)


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "`college_name_St. Mary` int, `a``b` int")
    counts = R.null_counts(df).first().asDict()
    assert counts == {"__rows": 3, "college_name_St. Mary": 1, "a`b": 1}
    assert R.apply_null_policy(df, "lax").count() == 1 and R.mandatory(df, ["college_name_St. Mary"]).count() == 2
    with pytest.raises(R.NullRowsError):
        R.apply_null_policy(df)
    assert R.mandatory_counts(df, df.columns).first().rows_after == 1
    flags = spark.createDataFrame([(1, 0), (2, 1)], "x int, `St. M_isnull` int")
    assert R.drop_flagged(flags).collect() == [(1,)]


def test_a_missing_input_is_an_error(spark):
    with pytest.raises(ValueError, match="missing input"):
        I.run_manifest(I.MANIFEST_B, {})
    assert I.run_manifest(I.MANIFEST_B, {}, skip=I.missing_tables(I.MANIFEST_B, {})) == {}


def test_values_lost_by_a_cast_are_reported(spark):
    contract = CONTRACTS["acttests"]
    field = next(f for f in contract.partner_schema().fields if f.dataType.simpleString() not in ("string", "boolean"))
    df = spark.createDataFrame([("k1", "no number"), ("k2", None)], f"k string, `{field.name}` string")
    got = [(r.table, r.key, r.value) for r in contract.lost_values(df, ["k"]).collect()]
    assert got == [("acttests", "k1", "no number")] and contract.lost_values(df.select("k"), ["k"]).count() == 0


def test_folds_are_cut_before_nulls_go(spark):
    rows = [(i, float(i), i % 2) if i % 4 else (i, None, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    got = k_fold_scores(df, "id", ["x"], "y", ModelSpec("GNB", {}), k=4)
    from cohortspark.operators.resample import k_folds

    want = {r.id: r.fold for r in k_folds(df, "id", 4, 0).collect()}
    assert {r.id: r.fold for r in got.collect()} == {i: want[i] for i in range(80) if i % 4}


def test_a_window_without_facts_has_no_row(spark):
    from collections import namedtuple

    Win = namedtuple("Win", "window_id split")
    facts = spark.createDataFrame([(1, date(2010, 1, 1)), (2, date(2012, 1, 1))], "k int, d date")
    windows = [Win(0, date(2011, 1, 1)), Win(1, date(2013, 1, 1))]
    out = windowed_aggregates(facts, "k", "d", windows, {"n": lambda p: F.count(F.when(p, 1))}).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize(
    "name,params",
    [("SVM", {"kernel": "rbf"}), ("SVM", {"penalty": "l1"}), ("SGD", {"loss": "hinge", "penalty": "l1"}), ("SGD", {"loss": "modified_huber"}), ("DTC", {"max_features": 3}),
     ("RandomForest", {"min_samples_split": 5}), ("AdaBoost", {"algorithm": "SAMME.R"}), ("GNB", {"priors": 1}), ("KNN", {"weights": "x"}), ("Other", {})],
)
def test_parameters_that_spark_lacks_are_refused(name, params):
    with pytest.raises(ValueError):
        check_parameters(ModelSpec(name, params))


def test_parameters_that_are_taken(spark):
    check_parameters(ModelSpec("SGD", {"loss": "log", "penalty": "elasticnet"}))
    df = spark.createDataFrame([(float(i % 3), int(i % 3 > 1)) for i in range(60)], "x double, y int")
    fit(ModelSpec("RandomForest", {"n_estimators": 2, "max_depth": 2, "class_weight": "subsample", "min_samples_split": 2}), df, ["x"], "y")
