"""Every model saved, loaded and scored alike."""

import numpy as np
import pytest

from cohortspark.operators.models import ModelSpec, fit
from cohortspark.sources.scorers import load_scorer, save_scorer

SPECS = [
    ModelSpec("LogisticRegression", {"max_iter": 5}), ModelSpec("SVM", {"max_iter": 5}), ModelSpec("SGD", {"loss": "log", "max_iter": 5}),
    ModelSpec("RandomForest", {"n_estimators": 3, "max_depth": 3}), ModelSpec("GBC", {"n_estimators": 2}), ModelSpec("DTC", {"max_depth": 2}),
    ModelSpec("DTC", {"max_depth": 2, "criterion": "entropy"}), ModelSpec("GNB"), ModelSpec("AdaBoost", {"n_estimators": 3}),
    ModelSpec("KNN", {"n_neighbors": 3, "weights": "distance"}),
]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_loaded_scorers_score_alike(spark, tmp_path, spec):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), int(a + 0.3 * b + rng.normal() * 0.5 > 0)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "row_key long, a double, `b c` double, y int")
    scorer = fit(spec, df, ["a", "b c"], "y")
    for _ in range(2):  # the second time over the first
        save_scorer(spark, scorer, str(tmp_path / "s"))
    again = load_scorer(spark, str(tmp_path / "s"))
    key = lambda s: sorted((r.row_key, round(r.score, 12), r.predicted) for r in s.score(df).select("row_key", "score", "predicted").collect())
    assert key(again) == key(scorer) and list(again.features) == ["a", "b c"]
