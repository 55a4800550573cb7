"""Fitted scorers as tables: save any of the nine models and load it again."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Row, SparkSession

from cohortspark.operators.models import NeighbourScorer, Scorer, Stump, StumpScorer

_META = "kind string, features array<string>, margin boolean, shares boolean, label string, k int, weights string"
_STUMPS = "place int, feature int, threshold double, left double, right double, weight double"


def save_scorer(spark: SparkSession, scorer: Scorer | StumpScorer | NeighbourScorer, path: str) -> None:
    """Write a scorer below ``path``: one row that says what it is, and its model, stumps or points.

    An existing scorer there is replaced.  Neighbour scorers keep their training rows,
    so what is saved grows with them.
    """
    meta = {"kind": type(scorer).__name__, "features": list(scorer.features), "margin": None, "shares": None, "label": None, "k": None, "weights": None}
    if isinstance(scorer, Scorer):
        scorer.model.write().overwrite().save(f"{path}/model")
        meta |= {"margin": scorer.margin, "shares": scorer.shares}
    elif isinstance(scorer, StumpScorer):
        rows = [(i, s.feature, s.threshold, s.left, s.right, s.weight) for i, s in enumerate(scorer.stumps)]
        spark.createDataFrame(rows, _STUMPS).coalesce(1).write.mode("overwrite").parquet(f"{path}/stumps")
    else:
        columns = list(dict.fromkeys([*scorer.features, scorer.label]))
        scorer.train.select(*[f"`{c}`" for c in columns]).write.mode("overwrite").parquet(f"{path}/points")
        meta |= {"label": scorer.label, "k": scorer.k, "weights": scorer.weights}
    spark.createDataFrame([Row(**meta)], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_scorer(spark: SparkSession, path: str) -> Scorer | StumpScorer | NeighbourScorer:
    """The scorer that :func:`save_scorer` wrote; it gives the same scores."""
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    if meta["kind"] == "Scorer":
        return Scorer(DefaultParamsReader.loadParamsInstance(f"{path}/model", spark), meta["features"], meta["margin"], meta["shares"])
    if meta["kind"] == "StumpScorer":
        rows = spark.read.schema(_STUMPS).parquet(f"{path}/stumps").orderBy("place").collect()  # one row per boosting round
        return StumpScorer([Stump(r["feature"], r["threshold"], r["left"], r["right"], r["weight"]) for r in rows], meta["features"])
    return NeighbourScorer(spark.read.parquet(f"{path}/points"), meta["features"], meta["label"], meta["k"], meta["weights"])
