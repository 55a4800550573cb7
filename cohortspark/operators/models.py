"""Classifiers on Spark ML (D01-D10), boosted stumps and exact nearest neighbours.

A model is described by ``ModelSpec(name, params)`` with the parameter names of
the usual single-node library; ``fit`` returns a scorer whose ``score`` adds
``score`` (of class 1) and ``predicted`` to a frame.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import cut_lineage, stored

FEATURES, LABEL, WEIGHT = "__features", "__label", "__weight"
_CUT_EVERY = 10
_SCRATCH = 4_000_000


@dataclass(frozen=True)
class ModelSpec:
    name: str
    params: Mapping = field(default_factory=dict)


def assemble_vector(df: DataFrame, features: Sequence[str], label: str | None = None, weight: str | None = None) -> DataFrame:
    """Numeric feature vector, binarised label (value >= 1) and row weight."""
    safe = [f"__f{i}" for i in range(len(features))]
    out = df.withColumns({s: F.col(f"`{c}`").cast("double") for s, c in zip(safe, features)})
    if label is not None:
        out = out.withColumn(LABEL, (F.col(label).cast("int") >= 1).cast("double"))
        out = out.withColumn(WEIGHT, F.lit(1.0) if weight is None else F.col(weight).cast("double"))
    return VectorAssembler(inputCols=safe, outputCol=FEATURES).transform(out).drop(*safe)


def _class_weight(df: DataFrame, balanced) -> DataFrame:
    """``balanced`` or an explicit ``{class: weight}`` scales the row weight.

    ``subsample`` balances too, with the class shares of all training rows.
    """
    if not balanced:
        return df
    if balanced in ("balanced", "auto", "subsample", "balanced_subsample"):
        counts = {r[LABEL]: r["n"] for r in df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        balanced = {k: total / (len(counts) * n) for k, n in counts.items()}
    w = F.lit(1.0)
    for k, v in balanced.items():
        w = F.when(F.col(LABEL) == float(k), F.lit(float(v))).otherwise(w)
    return df.withColumn(WEIGHT, F.col(WEIGHT) * w)


@dataclass
class Scorer:
    """A fitted Spark ML classifier with a uniform score column."""

    model: Model
    features: Sequence[str]
    margin: bool = False
    shares: bool = False

    def score(self, df: DataFrame) -> DataFrame:
        vectors = assemble_vector(df, self.features)
        raw = self.model.transform(vectors)
        if self.shares:
            return raw.withColumn("score", F.col("prediction")).withColumn("predicted", (F.col("score") > 0.5).cast("int")).drop(FEATURES, "prediction")
        source = "rawPrediction" if self.margin else "probability"
        return raw.withColumn("score", vector_to_array(source)[1]).withColumn("predicted", F.col("prediction").cast("int")).drop(
            FEATURES, "rawPrediction", "probability", "prediction"
        )

    def coefficients(self) -> list[tuple[str, float]]:
        """Coefficient per feature, largest first; empty for other models."""
        if not hasattr(self.model, "coefficients"):
            return []
        pairs = zip(self.features, self.model.coefficients.toArray().tolist())
        return sorted(pairs, key=lambda kv: -kv[1])


#: Parameters each model takes; any other is an error.
PARAMETERS = {
    "LogisticRegression": {"C", "penalty", "max_iter", "class_weight", "random_state"},
    "SVM": {"C", "kernel", "penalty", "max_iter", "class_weight", "random_state"},
    "SGD": {"loss", "alpha", "penalty", "l1_ratio", "max_iter", "class_weight", "random_state"},
    "RandomForest": {"n_estimators", "max_depth", "max_features", "min_samples_leaf", "min_samples_split", "criterion", "bootstrap", "class_weight", "random_state"},
    "GBC": {"n_estimators", "learning_rate", "max_depth", "subsample", "min_samples_leaf", "min_samples_split", "random_state"},
    "DTC": {"max_depth", "max_features", "min_samples_leaf", "min_samples_split", "criterion", "class_weight", "random_state"},
    "GNB": set(),
    "AdaBoost": {"n_estimators", "learning_rate", "algorithm", "random_state"},
    "KNN": {"n_neighbors", "weights"},
}


def check_parameters(spec: ModelSpec) -> None:
    """Raise for what Spark's learners cannot do, instead of fitting something else under the same label."""
    if spec.name not in PARAMETERS:
        raise ValueError(f"unknown model {spec.name!r}")
    p = spec.params
    unknown = sorted(set(p) - PARAMETERS[spec.name])
    if unknown:
        raise ValueError(f"{spec.name} has no parameter {', '.join(unknown)}")
    hinge = spec.name == "SVM" or (spec.name == "SGD" and p.get("loss", "hinge") == "hinge")
    wrong = {
        "kernel": p.get("kernel", "linear") != "linear",  # only the linear kernel is available
        "loss": p.get("loss", "hinge") not in ("hinge", "log"),
        "penalty": p.get("penalty", "l2") not in (("l2",) if hinge else ("l2", "l1", "elasticnet") if spec.name == "SGD" else ("l2", "l1")),
        "min_samples_split": int(p.get("min_samples_split", 2)) > 2,
        "max_features": spec.name == "DTC" and p.get("max_features") is not None,
        "algorithm": p.get("algorithm", "SAMME") != "SAMME",
        "weights": p.get("weights", "uniform") not in ("uniform", "distance"),
    }
    for name, bad in wrong.items():
        if bad:
            raise ValueError(f"{spec.name}: {name}={p[name]!r} is not available")


#: The deepest tree Spark ML grows.
MAX_DEPTH = 30


def _depth(wanted) -> int:
    """Unlimited (None) is the deepest tree there is; more than that is an error, never a silent cap."""
    if wanted is not None and int(wanted) > MAX_DEPTH:
        raise ValueError(f"max_depth {wanted} is beyond {MAX_DEPTH}, the deepest tree available")
    return MAX_DEPTH if wanted is None else int(wanted)


def _estimator(spec: ModelSpec, rows: int):
    """Spark ML estimator for a spec; ``rows`` converts C to a per-row penalty.

    Trees by Gini impurity are grown as regression trees of the 0/1 label: the
    splits are the same, since the variance is half the impurity, but Spark's
    classification trees merge leaves of one predicted class and so lose the
    shares that rank the rows.
    """
    p = dict(spec.params)
    common = dict(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT)
    penalty = 1.0 / (float(p.get("C", 1.0)) * max(rows, 1))
    depth = _depth(p.get("max_depth"))
    leaf = int(p.get("min_samples_leaf", 1))
    seed = int(p.get("random_state") or 0)
    rounds = int(p.get("max_iter", 100))
    if spec.name == "LogisticRegression" or (spec.name == "SGD" and p.get("loss") == "log"):
        if spec.name == "SGD":
            penalty = float(p.get("alpha", 1e-4))
        mix = {"l2": 0.0, "l1": 1.0, "elasticnet": float(p.get("l1_ratio", 0.15))}[p.get("penalty", "l2")]
        return C.LogisticRegression(regParam=penalty, elasticNetParam=mix, standardization=False, maxIter=rounds, **common)
    if spec.name == "SVM" or (spec.name == "SGD" and p.get("loss", "hinge") == "hinge"):
        if spec.name == "SGD":
            penalty = float(p.get("alpha", 1e-4))
        return C.LinearSVC(regParam=penalty, standardization=False, maxIter=rounds, **common)
    if spec.name == "RandomForest":
        subset = {"auto": "sqrt", "sqrt": "sqrt", "log2": "log2", None: "all"}.get(p.get("max_features", "auto"), str(p.get("max_features")))
        if p.get("criterion", "gini") == "gini":
            return R.RandomForestRegressor(
                numTrees=int(p.get("n_estimators", 10)), maxDepth=depth, minInstancesPerNode=leaf, impurity="variance",
                featureSubsetStrategy=subset, bootstrap=bool(p.get("bootstrap", True)), seed=seed, **common,
            )
        return C.RandomForestClassifier(
            numTrees=int(p.get("n_estimators", 10)), maxDepth=depth, minInstancesPerNode=leaf, impurity=p.get("criterion", "gini"),
            featureSubsetStrategy=subset, bootstrap=bool(p.get("bootstrap", True)), seed=seed, **common,
        )
    if spec.name == "GBC":
        return C.GBTClassifier(
            maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)), maxDepth=_depth(p.get("max_depth", 3)),
            subsamplingRate=float(p.get("subsample", 1.0)), minInstancesPerNode=leaf, seed=seed, **common,
        )
    if spec.name == "DTC":
        if p.get("criterion", "gini") == "gini":
            return R.DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=leaf, impurity="variance", seed=seed, **common)
        return C.DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, impurity=p.get("criterion", "gini"), seed=seed, **common)
    if spec.name == "GNB":
        return C.NaiveBayes(modelType="gaussian", **common)
    raise ValueError(f"unknown model {spec.name!r}")


def fit(spec: ModelSpec, train: DataFrame, features: Sequence[str], label: str, weight: str | None = None):
    """Fit one model; AdaBoost and KNN have their own drivers below."""
    check_parameters(spec)
    data = _class_weight(assemble_vector(train, features, label, weight), spec.params.get("class_weight"))
    if spec.name == "AdaBoost":
        return fit_stumps(data, features, int(spec.params.get("n_estimators", 50)), float(spec.params.get("learning_rate", 1.0)))
    if spec.name == "KNN":
        return NeighbourScorer(train, features, label, int(spec.params.get("n_neighbors", 5)), spec.params.get("weights", "uniform"))
    needs_rows = spec.name in ("LogisticRegression", "SVM")
    rows = data.agg(F.sum(WEIGHT)).first()[0] or 1 if needs_rows else 1
    margin = spec.name == "SVM" or (spec.name == "SGD" and spec.params.get("loss", "hinge") == "hinge")
    shares = spec.name in ("RandomForest", "DTC") and spec.params.get("criterion", "gini") == "gini"
    return Scorer(_estimator(spec, rows).fit(data), features, margin, shares)


# --- D03: boosted stumps ----------------------------------------------------------

@dataclass(frozen=True)
class Stump:
    feature: int
    threshold: float
    left: float
    right: float
    weight: float

    def vote(self, values: Column) -> Column:
        below = F.get(values, F.lit(self.feature)) <= F.lit(self.threshold)
        return F.when(below, F.lit(self.left)).otherwise(F.lit(self.right))


@dataclass(frozen=True)
class StumpScorer:
    stumps: Sequence[Stump]
    features: Sequence[str]

    def score(self, df: DataFrame) -> DataFrame:
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features])
        out = df.withColumn("__x", values)
        total = sum(s.weight for s in self.stumps) or 1.0
        vote = sum((s.vote(F.col("__x")) * F.lit(s.weight) for s in self.stumps), F.lit(0.0)) / F.lit(total)
        return out.withColumn("score", vote).withColumn("predicted", (F.col("score") > 0.5).cast("int")).drop("__x")


def _stump_of(tree, weight: float) -> Stump | None:
    root = tree._java_obj.rootNode()
    if root.subtreeDepth() == 0:
        return None
    split = root.split()
    return Stump(split.featureIndex(), split.threshold(), root.leftChild().prediction(), root.rightChild().prediction(), weight)


def fit_stumps(data: DataFrame, features: Sequence[str], rounds: int, learning_rate: float = 1.0) -> StumpScorer:
    """Discrete boosting of depth-1 trees.

    A stump is one comparison, so re-weighting and scoring are plain column
    expressions.  The weight column grows by one factor per round; its lineage
    is cut every few rounds through the checkpoint folder.
    """
    tree = C.DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxDepth=1)
    current = cut_lineage(data.select(FEATURES, LABEL, WEIGHT))
    stumps: list[Stump] = []
    for i in range(rounds):
        stump = _stump_of(tree.fit(current), 0.0)
        if stump is None:
            break
        miss = (stump.vote(vector_to_array(FEATURES)) != F.col(LABEL)).cast("double")
        row = current.agg(F.sum(F.col(WEIGHT) * miss).alias("bad"), F.sum(WEIGHT).alias("all")).first()
        error = row["bad"] / row["all"]
        if error >= 0.5:
            break
        weight = learning_rate * (math.log((1 - error) / error) if error > 0 else math.log(1e10))
        stumps.append(Stump(stump.feature, stump.threshold, stump.left, stump.right, weight))
        if error == 0:
            break
        current = current.withColumn(WEIGHT, F.col(WEIGHT) * F.exp(F.lit(weight) * miss) / F.lit(row["all"]))
        if (i + 1) % _CUT_EVERY == 0:
            current = cut_lineage(current)
    return StumpScorer(stumps, features)


# --- D09: exact nearest neighbours ----------------------------------------------------

#: Most pivots: their vectors are on the driver and travel with the tasks.
MAX_PIVOTS = 1024
#: Cells' best lists of a query meet in so many groups before they meet as one.
TOP_GROUPS = 32
#: Points, and queries, are cut into about so many groups, so that copies of either grow as the rows do.
GRID = 16
#: Numbers in the vectors of one group at most; beyond GRID times as many there are more groups.
_GROUP_VALUES = 4_194_304


@dataclass(frozen=True)
class Pivots:
    """Centres around which points lie in blocks."""

    centres: np.ndarray

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances to all pivots; they differ by rounding only."""
        norms = (v * v).sum(1)[:, None] + (self.centres * self.centres).sum(1)
        d2, slack = norms - 2 * v @ self.centres.T, 1e-12 * norms + 1e-30
        return np.sqrt(np.maximum(d2 - slack, 0)), np.sqrt(np.maximum(d2, 0) + slack)

    def chain(self) -> np.ndarray:
        """The pivots in an order in which each is followed by the nearest one left."""
        out, left = [0], np.ones(len(self.centres), dtype=bool)
        left[0] = False
        while left.any():
            rest = np.flatnonzero(left)
            out.append(int(rest[((self.centres[rest] - self.centres[out[-1]]) ** 2).sum(1).argmin()]))
            left[out[-1]] = False
        return np.array(out)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _slices(batches, width: int):
    """Parts of the frames whose rows times ``width`` stay within the scratch."""
    step = max(1, _SCRATCH // 4 // width)
    for pdf in batches:
        for at in range(0, len(pdf), step):
            yield pdf.iloc[at : at + step]


class _Best:
    """The ``need`` nearest points of each query: squared distances and positions of points, which follow their ids."""

    def __init__(self, qm: np.ndarray, pm: np.ndarray, bound: np.ndarray, need: int, qcode: np.ndarray | None, pcode: np.ndarray | None):
        self.qm, self.pm, self.need, self.bound, self.qcode, self.pcode = qm, pm, need, bound, qcode, pcode
        self.d2, self.at = np.full((len(qm), need), np.nan), np.full((len(qm), need), len(pm))
        self.qn, self.pn = (qm * qm).sum(1), (pm * pm).sum(1)

    def limit(self, rows: np.ndarray) -> np.ndarray:
        """No farther point counts; NaN where too few are known."""
        return np.fmin(self.bound[rows], self.d2[rows, self.need - 1])

    def scan(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Look at some points for some queries: a matrix product tells what may be near, differences decide."""
        step = max(1, _SCRATCH // len(cols))
        for i in range(0, len(rows), step):
            self._scan(rows[i : i + step], cols)

    def _scan(self, rows: np.ndarray, cols: np.ndarray) -> None:
        # squared distance less the query's norm, and less what rounding may add
        off = (-2 * self.qm[rows]) @ self.pm[cols].T + self.pn[cols] * (1 - 1e-12)
        if self.qcode is not None:
            mine = np.flatnonzero(np.isin(self.qcode[rows], self.pcode[cols]))
            for i in mine:
                off[i, self.pcode[cols] == self.qcode[rows[i]]] = np.inf
        most = self.limit(rows) - self.qn[rows] * (1 - 1e-12) + 1e-30
        unknown = np.flatnonzero(np.isnan(most))
        if len(unknown) and len(cols) > self.need:
            slack = 2e-12 * (self.qn[rows[unknown]] + self.pn[cols].max()) + 1e-30
            most[unknown] = np.partition(off[unknown], self.need - 1, axis=1)[:, self.need - 1] + 2 * slack
        r, c = np.nonzero(~(off > most[:, None]))
        r, c = rows[r], cols[c]
        if self.qcode is not None:
            other = self.qcode[r] != self.pcode[c]
            r, c = r[other], c[other]
        step = max(1, _SCRATCH // 4 // self.qm.shape[1])
        for i in range(0, len(r), step):
            diff = self.qm[r[i : i + step]] - self.pm[c[i : i + step]]
            self._merge(r[i : i + step], c[i : i + step], np.einsum("nd,nd->n", diff, diff))

    def _merge(self, r: np.ndarray, c: np.ndarray, d2: np.ndarray) -> None:
        have = np.unique(r)
        row = np.concatenate([np.repeat(have, self.need), r])
        d2, at = np.concatenate([self.d2[have].ravel(), d2]), np.concatenate([self.at[have].ravel(), c])
        order = np.lexsort((at, d2, row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        top = order[(first[:, None] + np.arange(self.need)).ravel()]
        self.d2[have], self.at[have] = d2[top].reshape(-1, self.need), at[top].reshape(-1, self.need)


def _distinct_enough(v: np.ndarray, ids: np.ndarray, k: int, others: bool) -> np.ndarray:
    """Which points can be among k nearest: of equal ones those with the smallest ids (given in ascending order).

    Where a query passes over its own id, k points of each of the k + 1 smallest ids.
    """
    same = pd.factorize(pd.Series(list(map(bytes, np.ascontiguousarray(v)))))[0]
    rows = pd.DataFrame({"v": same, "id": ids})
    if not others:
        return (rows.groupby("v").cumcount() < k).to_numpy()
    fresh = ~rows.duplicated(["v", "id"])
    return ((rows.groupby(["v", "id"]).cumcount() < k) & (fresh.groupby(rows["v"]).cumsum() <= k + 1)).to_numpy()


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    query_id: str,
    point_id: str,
    vector: str,
    payload: str,
    exclude_self: bool = False,
    block_rows: int = 4096,
    query_rows: int = 65536,
    sample_pivots: int | None = None,
    visited: dict | None = None,
) -> DataFrame:
    """Exact k nearest points per query: ``(query_id, neighbour, distance, payload)``.

    Points lie in blocks of at most about ``block_rows`` around pivots, about the square
    root of their number (``MAX_PIVOTS`` at most, then pivots hold several blocks).
    Blocks of pivots near each other form cells, ``GRID`` of them as long as a task can
    hold one.  First every query searches the cell of its own pivot, its own block first;
    the k-th distance found there is its bound.  Then it visits the other cells with a
    block that the triangle inequality allows to hold a nearer point.  A task holds a cell
    and a part of its queries (``query_rows`` at most), passes over blocks out of reach,
    and emits the k best per query, and these meet in two levels, so neither pairs nor
    long lists exist.  A query is copied at most once per cell and a cell once per part,
    so both grow as the rows do while the grid holds them.

    Ties go to the smaller point id; points that share an id are points of their
    own.  Query rows that repeat an id (and so its vector) are one query.  Rows
    with a null vector take no part; without points there are no rows.  With
    ``exclude_self`` a query passes over all points of its id, and null ids take no part.
    ``visited`` gets the number of blocks, of queries, of the blocks in their reach and of the copies of queries.
    Writes points and first results to the shared folder and runs a few small jobs when called.
    """
    known = lambda key: F.col(vector).isNotNull() & (F.col(key).isNotNull() if exclude_self else F.lit(True))
    # floats travel as floats and become doubles in the tasks
    kind = {df.select(vector).schema[0].dataType.simpleString() for df in (queries, points)}
    v = F.col(vector).cast("array<float>" if kind == {"array<float>"} else "array<double>").alias("v")
    pts = points.filter(known(point_id)).select(F.col(point_id).alias("pid"), v, F.col(payload).alias("payload"))
    qs = queries.filter(known(query_id)).select(F.col(query_id).alias("qid"), v).dropDuplicates(["qid"])
    total = pts.count()
    count = sample_pivots or min(MAX_PIVOTS, math.isqrt(max(total - 1, 0)) + 1)
    # the points with the smallest id hash, ``count`` at most
    chosen = pts.select("pid", "v").orderBy(F.xxhash64("pid"), "pid", "v").limit(count).collect()
    id_type, pid_type, pay_type = qs.schema["qid"].dataType, pts.schema["pid"].dataType, pts.schema["payload"].dataType
    best_schema = T.StructType(
        [T.StructField("qid", id_type), T.StructField("cell", T.IntegerType()), T.StructField("d2", T.DoubleType()), T.StructField("pid", pid_type), T.StructField("payload", pay_type)]
    )
    if not chosen:
        none = queries.sparkSession.createDataFrame([], best_schema)
        return none.select(F.col("qid").alias(query_id), F.col("pid").alias("neighbour"), F.col("d2").alias("distance"), F.col("payload").alias(payload))
    pivots = Pivots(np.array([r["v"] for r in chosen], dtype="float64"))
    width = max(len(chosen), pivots.centres.shape[1])

    def place(batches):
        for pdf in _slices(batches, width):
            _, d = pivots.distances(_vectors(pdf["v"]))
            yield pdf.assign(pivot=d.argmin(axis=1).astype("int32"), r=d.min(axis=1))

    placed_schema = T.StructType([*pts.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("r", T.DoubleType())])
    near = stored(pts.mapInPandas(place, placed_schema).withColumn("at", F.monotonically_increasing_id()), "points")
    # one row per pivot comes back
    of_pivot = {r["pivot"]: r for r in near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius")).collect()}
    used = np.array([p for p in pivots.chain() if p in of_pivot])
    sizes, radii = np.array([of_pivot[p]["n"] for p in used]), np.array([of_pivot[p]["radius"] for p in used])
    blocks = -(-sizes // block_rows)
    # a cell holds the blocks that begin in its stretch of rows
    most = max(block_rows, _GROUP_VALUES // max(1, pivots.centres.shape[1]))
    cell_rows = max(block_rows, min(most, -(-total // GRID)))
    starts, steps = np.cumsum(sizes) - sizes, -(-sizes // blocks)
    cell_of = lambda at, part: (starts[at] + part * steps[at]) // cell_rows
    cells = np.unique(np.concatenate([cell_of(at, np.arange(n)) for at, n in enumerate(blocks)]))
    # the pivots of a cell are neighbours in the chain
    low_at = np.searchsorted(cell_of(np.arange(len(used)), blocks - 1), cells)
    high_at = np.searchsorted(cell_of(np.arange(len(used)), 0), cells, side="right")
    lookup = lambda keys, values, key: F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(keys, values) for x in pair]), F.col(key))
    # the points of one pivot are spread by row, so that a pivot with a third of all points, or of equal ones, becomes many blocks
    near = (
        near.withColumn("part", F.pmod(F.xxhash64("at"), lookup(used, blocks, "pivot")).cast("int"))
        .withColumn("cell", F.floor((lookup(used, starts, "pivot") + F.col("part") * lookup(used, steps, "pivot")) / cell_rows).cast("int"))
        .withColumn("pivot", lookup(used, range(len(used)), "pivot").cast("int"))
        .drop("at", "r")
    )
    visit_schema = T.StructType(
        [T.StructField(c, T.IntegerType()) for c in ("cell", "pivot", "part")] + [*qs.schema.fields, T.StructField("bound", T.DoubleType())]
    )

    def own(batches):
        """The cell a query searches first, and its block there."""
        for pdf in _slices(batches, width):
            _, d = pivots.distances(_vectors(pdf["v"]))
            at = d[:, used].argmin(axis=1)
            part = np.arange(len(pdf)) % blocks[at]
            yield pd.DataFrame({"cell": cell_of(at, part).astype("int32"), "pivot": at.astype("int32"), "part": part.astype("int32"), "qid": pdf["qid"].to_numpy(), "v": pdf["v"].to_numpy(), "bound": np.nan})

    def in_reach(low: np.ndarray, high: np.ndarray, bound: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pivots ``at`` may hold a point within the bound, a squared distance (NaN: unknown)."""
        reach = np.sqrt(bound)
        unknown = np.isnan(reach)
        if unknown.any():
            reach[unknown] = np.inf
            if not exclude_self:
                # the nearest pivots that together hold enough bound the k-th distance
                far = high[unknown] + radii
                order = np.argsort(far, axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())).argmax(axis=1)
                reach[unknown] = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
        return ~(low[:, at] - radii[at] > (reach * (1 + 1e-9) + 1e-9)[:, None])

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({c: [] for c in best_schema.names})
        cell = int(q["cell"].iloc[0])
        p = p.sort_values("pid", kind="stable")
        codes = pd.factorize(pd.concat([p["pid"], q["qid"]] if exclude_self else [p["pid"]], ignore_index=True), use_na_sentinel=False)[0]
        keep = _distinct_enough(pm := _vectors(p["v"]), codes[: len(p)], k, exclude_self)
        pid, pay, pm = p["pid"].to_numpy()[keep], p["payload"].to_numpy()[keep], pm[keep]
        qid, qm = q["qid"].to_numpy(), _vectors(q["v"])
        apart = (codes[len(p) :], codes[: len(p)][keep]) if exclude_self else (None, None)
        found = _Best(qm, pm, q["bound"].to_numpy(dtype="float64"), k, *apart)
        members = pd.DataFrame({"pivot": p["pivot"].to_numpy()[keep], "part": p["part"].to_numpy()[keep]}).groupby(["pivot", "part"]).indices
        mine = q[["pivot", "part"]].reset_index(drop=True)
        step = max(1, _SCRATCH // 4 // width)
        for i in range(0, len(qid), step):
            rows = np.arange(i, min(i + step, len(qid)))
            low, high = (d[:, used] for d in pivots.distances(qm[rows]))
            done = {}
            for key, at in mine.iloc[rows].groupby(["pivot", "part"]).indices.items():
                if key in members:
                    done[key] = at
                    found.scan(rows[at], members[key])
            for key, cols in members.items():
                open_rows = in_reach(low, high, found.limit(rows), np.array([key[0]]))[:, 0]
                open_rows[done.get(key, [])] = False
                if open_rows.any():
                    found.scan(rows[open_rows], cols)
        r, c = np.nonzero(found.at < len(pid))
        top = found.at[r, c]
        return pd.DataFrame({"qid": qid[r], "cell": np.int32(cell), "d2": found.d2[r, c], "pid": pid[top], "payload": pay[top]})

    def searched(visits: DataFrame, loads: dict[int, int], part_rows: int) -> DataFrame:
        """The k best of every visit; ``loads`` are the visits per cell."""
        copies = lookup(loads, [math.ceil(n / part_rows) for n in loads.values()], "cell")
        spread = near.filter(F.col("cell").isin(list(loads))) if len(loads) < len(cells) else near
        spread = spread.withColumn("qpart", F.explode(F.sequence(F.lit(0), copies - 1)))
        cut = visits.withColumn("qpart", F.pmod(F.xxhash64("qid"), copies).cast("int"))
        return cut.groupBy("cell", "qpart").cogroup(spread.groupBy("cell", "qpart")).applyInPandas(best, best_schema)

    first = stored(qs.mapInPandas(own, visit_schema), "own-cell")
    # one row per cell comes back
    loads = {r["cell"]: r["n"] for r in first.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    queried = sum(loads.values())
    part_rows = min(query_rows, most, max(block_rows, -(-queried // GRID)))
    found = stored(searched(first, loads, part_rows) if loads else queries.sparkSession.createDataFrame([], best_schema), "own-best")
    bound = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("bound"))

    def admitted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Pivots in a query's reach, and the other cells with a block of one."""
        low, high = (d[:, used] for d in pivots.distances(_vectors(pdf["v"])))
        inside = in_reach(low, high, pdf["bound"].to_numpy(dtype="float64"), np.arange(len(used)))
        before = np.concatenate([np.zeros((len(pdf), 1), dtype="int64"), np.cumsum(inside, axis=1)], axis=1)
        return inside, (before[:, high_at] > before[:, low_at]) & (cells != pdf["cell"].to_numpy()[:, None])

    def visit(batches):
        """The other cells a query has to look at, a bounded number of rows at a time."""
        for pdf in _slices(batches, width):
            rows, cols = np.nonzero(admitted(pdf)[1])
            for i in range(0, len(rows), 10_000):
                out = pdf.iloc[rows[i : i + 10_000]]
                yield out.assign(cell=cells[cols[i : i + 10_000]].astype("int32"), pivot=np.int32(-1), part=np.int32(-1))

    def count_visits(batches):
        for pdf in _slices(batches, width):
            inside, other = admitted(pdf)
            yield pd.DataFrame({"cell": [*cells.tolist(), -1], "n": [*other.sum(axis=0).tolist(), int((inside @ blocks).sum())]})

    bounded = first.drop("bound").join(bound, "qid", "left").select(*visit_schema.names)
    after = {r["cell"]: r["n"] for r in bounded.mapInPandas(count_visits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    if visited is not None:
        visited |= {"blocks": int(blocks.sum()), "queries": queried, "visits": after.get(-1, 0), "copies": queried + sum(n for c, n in after.items() if c >= 0)}
    loads = {c: n for c, n in after.items() if c >= 0 and n}
    every = found.unionByName(searched(bounded.mapInPandas(visit, visit_schema), loads, part_rows)) if loads else found
    top = lambda rows, *keys: rows.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("nn"))), 1, k).alias("nn"))
    lists = every.select("qid", F.pmod("cell", F.lit(TOP_GROUPS)).alias("group"), F.array(F.struct("d2", "pid", "payload")).alias("nn"))
    ranked = top(top(lists, "qid", "group"), "qid")
    return ranked.select("qid", F.explode("nn").alias("x")).select(
        F.col("qid").alias(query_id), F.col("x.pid").alias("neighbour"), F.sqrt("x.d2").alias("distance"), F.col("x.payload").alias(payload)
    )


def neighbour_votes(neighbours: DataFrame, query_id: str, payload: str, weights: str = "uniform") -> DataFrame:
    """Share of votes per class; ``distance`` weights by 1/d, exact hits take all."""
    if weights == "uniform":
        w = F.lit(1.0)
        weighted = neighbours.withColumn("__w", w)
    elif weights == "distance":
        hits = neighbours.groupBy(query_id).agg(F.max(F.col("distance") == 0).alias("__exact"))
        joined = neighbours.join(hits, query_id)
        zero = F.col("distance") == 0
        weighted = joined.withColumn(
            "__w", F.when(F.col("__exact"), zero.cast("double")).otherwise(1.0 / F.when(~zero, F.col("distance")))
        ).drop("__exact")
    else:
        raise ValueError("weights must be 'uniform' or 'distance'")
    totals = weighted.groupBy(query_id, payload).agg(F.sum("__w").alias("__v"))
    whole = totals.groupBy(query_id).agg(
        F.sum("__v").alias("__all"),
        F.min(F.struct((-F.col("__v")).alias("n"), F.col(payload).alias("c"), F.col("__v").alias("v"))).alias("__best"),
    )
    return whole.select(query_id, F.col("__best.c").alias("predicted"), (F.col("__best.v") / F.col("__all")).alias("share"))


@dataclass(frozen=True)
class NeighbourScorer:
    train: DataFrame
    features: Sequence[str]
    label: str
    k: int = 5
    weights: str = "uniform"

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (weight share of class 1) and ``predicted``; rows of one ``row_key`` are alike.

        Training rows that repeat are points of their own; of different ones at the
        same distance the smaller hash of their content counts, so the result does
        not depend on files or partitions.
        """
        vec = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features])
        points = self.train.select(vec.alias("v"), (F.col(self.label).cast("int") >= 1).cast("int").alias("y")).withColumn("pid0", F.xxhash64("v", "y"))
        queries = df.select("row_key", vec.alias("v"))
        nn = nearest(queries, points, self.k, "row_key", "pid0", "v", "y")
        if self.weights == "distance":
            exact = nn.groupBy("row_key").agg(F.max(F.col("distance") == 0).alias("__exact"))
            nn = nn.join(exact, "row_key")
            zero = F.col("distance") == 0
            w = F.when(F.col("__exact"), zero.cast("double")).otherwise(1.0 / F.when(~zero, F.col("distance")))
        else:
            w = F.lit(1.0)
        share = nn.withColumn("__w", w).groupBy("row_key").agg((F.sum(F.col("__w") * F.col("y")) / F.sum("__w")).alias("score"))
        return df.join(share, "row_key", "left").withColumn("predicted", (F.col("score") > 0.5).cast("int"))
