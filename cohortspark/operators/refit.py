"""Many weighted logistic regressions at once.

Bootstrap replicates and cross-validation folds fit one model many times on the
same rows under other weights.  Here a task holds a batch of rows once and adds up,
for every weighting that is still moving, the loss, gradient and Gram sums of one
Newton step; only those sums travel, in blocks of bounded size.  So 1,500 refits of
all feature groups take about as many passes over the rows as one fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortspark.operators import metrics as E  # noqa: F401 (read by tests as refit.E)
from cohortspark.operators.resample import _interval, poisson_weights, weight_key
from cohortspark.operators.rows import any_null, quoted
from cohortspark.session import stored

#: Numbers in a block of sums, rows of a batch taken at once, and groups in which tasks' blocks meet first.
BLOCK_NUMBERS, ROWS, FAN = 1 << 17, 1024, 32
#: Keeps steps finite where a column is constant or the penalty is off.
LEAST_PENALTY = 1e-9
#: Scores are compared to this many digits: what differs less is a tie.
SCORE_DIGITS = 9
#: Distinct test rows scored at once, test rows of a range of one fit's scores (about), sampled rows that set a range's
#: bounds, and fits in a batch of runs.
CELLS, RANGE, RANGE_SAMPLE, RUN_FITS = 1 << 15, 1 << 17, 64, 16


@dataclass(frozen=True)
class Bootstrap:
    """Weighting 0 is the data as it is; the others are Poisson(1) weights by row key."""

    replicates: int
    seed: int = 0

    @property
    def fits(self) -> int:
        return self.replicates + 1

    def key(self, key: str) -> tuple[Column, Column]:
        return weight_key(self.seed, [key])

    def weights(self, a: np.ndarray, b: np.ndarray, fits: np.ndarray) -> np.ndarray:
        drawn = poisson_weights(a, b, np.ones(len(a), np.int64), fits - 1)
        return np.where(fits == 0, 1.0, drawn)


@dataclass(frozen=True)
class LeaveOut:
    """Weighting i is all rows but those of fold i; the key is the fold."""

    folds: int

    @property
    def fits(self) -> int:
        return self.folds

    def key(self, key: str) -> tuple[Column, Column]:
        return F.col(key).cast("long"), F.lit(0).cast("long")

    def weights(self, a: np.ndarray, b: np.ndarray, fits: np.ndarray) -> np.ndarray:
        return (a[:, None] != fits).astype(float)


Weighting = Bootstrap | LeaveOut


def _rows(df: DataFrame, features: Sequence[str], label: str, extra: Sequence[Column] = ()) -> DataFrame:
    """(y, x, extra...) of rows without nulls; x is the feature vector."""
    clean = df.filter(~any_null([*features, label]))
    return clean.select(
        F.when(F.col(label).cast("int") >= 1, 1.0).otherwise(0.0).alias("y"), F.array(*[quoted(c).cast("double") for c in features]).alias("x"), *extra
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` on every core: few bytes, which adaptive execution would put into a task or two, but each row meets all fits."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """fits x (1 + p + p(p+1)/2): loss, gradient and upper Gram triangle of each weighting; x has a column of ones."""
    z = np.clip(x @ coef.T, -500, 500)
    prob = 1 / (1 + np.exp(-z))
    loss = (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
    grad = (w * (prob - y[:, None])).T @ x
    i, j = np.triu_indices(x.shape[1])
    gram = (w * prob * (1 - prob)).T @ (x[:, i] * x[:, j])
    return np.column_stack([loss, grad, gram])


def fit_many(
    train: DataFrame, key: str, groups: Mapping[str, Sequence[str]], label: str, weighting: Weighting, C: float = 1.0, max_iter: int = 50, tol: float = 1e-10
) -> dict[str, np.ndarray]:
    """Per feature group the coefficients (fits x features + intercept, the intercept last).

    Minimises ``sum w * logloss + |coefficients|^2 / (2 C)`` by Newton steps; the
    intercept has no penalty.  A step that raises the loss is halved until it does
    not; fits that stand still take no part in further passes.  Rows with a null in
    any of the features or the label are left out.  The rows are written once to the
    shared folder; the driver holds coefficients and sums, whose size depends on
    fits and features only.
    """
    features = sorted({f for g in groups.values() for f in g})
    at = {name: [features.index(f) for f in g] for name, g in groups.items()}
    a, b = weighting.key(key)
    rows = stored(_dealt(_rows(train, features, label, [a.alias("a"), b.alias("b")])), "refit")
    n = weighting.fits
    state = {g: _State(n, len(cols) + 1, C) for g, cols in at.items()}
    for _ in range(max_iter):
        moving = {g: (np.flatnonzero(s.moving), s.trial[s.moving]) for g, s in state.items() if s.moving.any()}
        if not moving:
            break
        sums = _pass(rows, features, at, moving, weighting)
        for g in moving:
            state[g].update(sums[g], tol)
    return {g: s.coef for g, s in state.items()}


class _State:
    """Newton iterations of one feature group: accepted coefficients, and the trial under way of every fit."""

    def __init__(self, fits: int, width: int, C: float):
        self.coef, self.trial = np.zeros((fits, width)), np.zeros((fits, width))
        self.loss, self.step = np.full(fits, np.inf), np.zeros((fits, width))
        self.moving = np.ones(fits, bool)
        self.penalty = np.r_[np.full(width - 1, max(1 / C, LEAST_PENALTY)), LEAST_PENALTY]

    def update(self, sums: np.ndarray, tol: float) -> None:
        who = np.flatnonzero(self.moving)
        width, trial = self.coef.shape[1], self.trial[who]
        loss = sums[:, 0] + 0.5 * (self.penalty * trial * trial).sum(1)
        better = loss <= self.loss[who] + 1e-12 * np.abs(loss)
        # where the loss rose: half the step, from the accepted point
        for i in who[~better]:
            self.step[i] /= 2
            self.trial[i] = self.coef[i] + self.step[i]
            self.moving[i] = np.abs(self.step[i]).max() > 1e-9
        if not better.any():
            return
        ok, sums, loss, trial = who[better], sums[better], loss[better], trial[better]
        gain = self.loss[ok] - loss
        self.coef[ok], self.loss[ok] = trial, loss
        grad = sums[:, 1 : width + 1] + self.penalty * trial
        gram = np.zeros((len(ok), width, width))
        i, j = np.triu_indices(width)
        gram[:, i, j] = gram[:, j, i] = sums[:, width + 1 :]
        gram[:, range(width), range(width)] += self.penalty
        self.step[ok] = -np.linalg.solve(gram, grad[:, :, None])[:, :, 0]
        self.trial[ok] = trial + self.step[ok]
        still = (gain < tol * (1 + np.abs(loss))) & (np.abs(self.step[ok]).max(1) < 1e-7 * (1 + np.abs(trial).max(1)))
        self.moving[ok[still]] = False


def _pass(rows: DataFrame, features, at, moving, weighting: Weighting) -> dict[str, np.ndarray]:
    """The Newton sums of all moving fits, from one reading of the rows."""
    width = {g: 1 + len(at[g]) + 1 + (len(at[g]) + 1) * (len(at[g]) + 2) // 2 for g in moving}
    step = {g: max(1, BLOCK_NUMBERS // width[g]) for g in moving}
    every = np.unique(np.concatenate([fits for fits, _ in moving.values()]))
    blocks = [(g, lo) for g in moving for lo in range(0, len(moving[g][0]), step[g])]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = 0, {x: 0.0 for x in blocks}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                cut = batch.slice(lo, ROWS)
                part = cut.column("part")[0].as_py()
                x, y = np.column_stack([_matrix(cut, len(features)), np.ones(cut.num_rows)]), cut.column("y").to_numpy()
                w = weighting.weights(cut.column("a").to_numpy(), cut.column("b").to_numpy(), every)
                for g, first in blocks:
                    fits, coef = (v[first : first + step[g]] for v in moving[g])
                    total[g, first] = total[g, first] + newton_sums(x[:, [*at[g], -1]], y, w[:, np.searchsorted(every, fits)], coef)
        for i, x in enumerate(blocks):
            if not np.isscalar(total[x]):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part % FAN]), pa.array([total[x].ravel()], pa.list_(pa.float64()))], names=["block", "slot", "sums"])

    def add(t: pa.Table) -> pa.Table:
        got = t.column("sums").combine_chunks()
        return t.select(["block", "slot"]).slice(0, 1).append_column("sums", pa.array([got.flatten().to_numpy().reshape(len(got), -1).sum(0)], pa.list_(pa.float64())))

    kind = "block long, slot long, sums array<double>"
    made = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(sums, kind)
    made = made.groupBy("block", "slot").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind)
    out = {g: np.zeros((len(moving[g][0]), width[g])) for g in moving}
    for r in made.select("block", "sums").toArrow().to_pylist():
        g, first = blocks[r["block"]]
        got = np.array(r["sums"]).reshape(-1, width[g])
        out[g][first : first + len(got)] = got
    return out


def _test_cells(test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(x, p, n): test rows of each class per feature vector."""
    return _rows(test, features, label).groupBy("x").agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("n"))


def replicate_cells(test: DataFrame, groups: Mapping[str, Sequence[str]], label: str, coef: Mapping[str, np.ndarray]) -> DataFrame:
    """(feature_group, rep, score, p, n): test rows of each class per score of each fit.

    Rows with equal features are counted before any fit scores them; rows x fits
    exist only as distinct feature vectors x fits.
    """
    features = sorted({f for g in groups.values() for f in g})
    cells = _test_cells(test, features, label)
    at = {name: [features.index(f) for f in g] for name, g in groups.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([_matrix(batch, len(features)), np.ones(batch.num_rows)])
            p, n = batch.column("p").to_numpy(), batch.column("n").to_numpy()
            for g in groups:
                for lo in range(0, len(coef[g]), 64):
                    z = np.round(x[:, [*at[g], -1]] @ coef[g][lo : lo + 64].T, SCORE_DIGITS) + 0.0
                    fits = z.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([g] * z.size), pa.array(np.tile(np.arange(lo, lo + fits, dtype=np.int32), len(x))), pa.array(z.ravel()),
                            pa.array(np.repeat(p, fits)), pa.array(np.repeat(n, fits)),
                        ],
                        names=["feature_group", "rep", "score", "p", "n"],
                    )

    long = cells.mapInArrow(score, "feature_group string, rep int, score double, p long, n long")
    return long.groupBy("feature_group", "rep", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _summed(score: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in ascending order (NaN equals NaN and comes last) and their counts."""
    order = score.argsort(kind="stable")
    score, p, n = score[order], p[order], n[order]
    first = np.flatnonzero(np.r_[True, (score[1:] != score[:-1]) & ~np.isnan(score[:-1])])
    return score[first], np.add.reduceat(p, first), np.add.reduceat(n, first)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows, the last one of fewer."""
    held, count = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            cut = batch.slice(lo, rows)
            if count + cut.num_rows > rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
            held.append(cut)
            count += cut.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def replicate_aucs(test: DataFrame, groups: Mapping[str, Sequence[str]], label: str, coef: Mapping[str, np.ndarray]) -> DataFrame:
    """(feature_group, rep, auc, positives, negatives): the exact AUC of every fit, as ``auc_of_cells`` of :func:`replicate_cells` has it.

    A task sorts its test rows by the scores of each fit and sends them as runs,
    packed, cut at bounds that a sample of the rows sets per fit; runs of a range
    meet and are merged, and ranges add up by their totals.  So rows x fits travel
    as numbers, not as rows of their own, and a task holds a range of one fit.
    Writes the distinct test rows to the shared folder and runs a few small jobs when called.
    """
    features = sorted({f for g in groups.values() for f in g})
    at = {name: [features.index(f) for f in g] for name, g in groups.items()}
    names = list(groups)
    cells = stored(_dealt(_test_cells(test, features, label)), "refit-cells")
    ranges = max(1, -(-cells.count() // RANGE))
    scores = lambda g, x, fits: np.round(x[:, [*at[g], -1]] @ coef[g][fits].T, SCORE_DIGITS) + 0.0
    bounds = {g: np.empty((0, len(coef[g]))) for g in names}
    if ranges > 1:
        # the bounds say where rows meet, not what is counted
        few = cells.select("x").orderBy(F.xxhash64("x"), "x").limit(ranges * RANGE_SAMPLE).collect()
        few = np.column_stack([np.array([r["x"] for r in few]), np.ones(len(few))])
        places = np.arange(1, ranges) * len(few) // ranges
        bounds = {g: np.sort(scores(g, few, slice(None)), axis=0)[places] for g in names}
    kind = pa.schema([("g", pa.int32()), ("rep", pa.int32()), ("at", pa.int32()), ("score", pa.binary()), ("p", pa.binary()), ("n", pa.binary())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, CELLS):
            x = np.column_stack([_matrix(batch, len(features)), np.ones(batch.num_rows)])
            p, n = batch.column("p").to_numpy(), batch.column("n").to_numpy()
            for i, g in enumerate(names):
                for lo in range(0, len(coef[g]), RUN_FITS):
                    z, out = scores(g, x, slice(lo, lo + RUN_FITS)), []
                    for j in range(z.shape[1]):
                        s, *counts = _summed(z[:, j], p, n)
                        packed = np.uint8 if max(c.max() for c in counts) < 256 else np.int64
                        a, b = (c.astype(packed) for c in counts)
                        cut = [0, *np.searchsorted(s, bounds[g][:, lo + j], side="right"), len(s)]
                        out += [(i, lo + j, r, s[u:v].tobytes(), a[u:v].tobytes(), b[u:v].tobytes()) for r, (u, v) in enumerate(zip(cut, cut[1:])) if u < v]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kind.types)], schema=kind)

    def merge(t: pa.Table) -> pa.Table:
        score = [np.frombuffer(v.as_buffer()) for v in t.column("score")]
        count = lambda c: np.concatenate([np.frombuffer(v.as_buffer(), np.uint8 if v.as_buffer().size == len(s) else np.int64).astype(np.int64) for v, s in zip(t.column(c), score)])
        _, p, n = _summed(np.concatenate(score), count("p"), count("n"))
        # a pair of equal scores is half a win
        wins = int((p * (2 * (np.cumsum(n) - n) + n)).sum()) / 2
        return t.select(["g", "rep", "at"]).slice(0, 1).append_column("w", pa.array([wins])).append_column("p", pa.array([int(p.sum())])).append_column("n", pa.array([int(n.sum())]))

    made = cells.mapInArrow(runs, "g int, rep int, at int, score binary, p binary, n binary")
    made = made.groupBy("g", "rep", "at").applyInArrow(merge, "g int, rep int, at int, w double, p long, n long")
    lower = W.partitionBy("g", "rep").orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    placed = made.withColumn("below", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    positives, negatives = F.sum("p"), F.sum("n")
    pairs = positives.cast("double") * negatives
    auc = F.when(pairs > 0, F.sum(F.col("w") + F.col("p").cast("double") * F.col("below")) / pairs)
    found = placed.groupBy("g", "rep").agg(auc.alias("auc"), positives.alias("positives"), negatives.alias("negatives"))
    named = F.get(F.array(*[F.lit(g) for g in names]), F.col("g"))
    return found.select(named.alias("feature_group"), "rep", "auc", "positives", "negatives")


def auc_by_feature_group(
    train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], label: str, key: str, n_boot: int = 1500, alpha: float = 0.05, C: float = 1.0, seed: int = 0
) -> DataFrame:
    """(feature_group, lower, auc, upper, replicates): test AUC of a refit logistic regression per feature group.

    The interval has the order statistics of ``n_boot`` refits under bootstrap
    weights of the training rows; refits whose AUC is unknown are left out.
    """
    coef = fit_many(train, key, groups, label, Bootstrap(n_boot, seed), C)
    aucs = stored(replicate_aucs(test, groups, label, coef), "refit-auc")  # fits x groups rows
    spread = _interval(aucs.filter("rep > 0"), ["feature_group"], "auc", alpha)
    return spread.join(aucs.filter("rep = 0").select("feature_group", "auc"), "feature_group").select("feature_group", "lower", "auc", "upper", "replicates")


def k_fold_scores(df: DataFrame, fold: str, k: int, features: Sequence[str], label: str, C: float = 1.0) -> DataFrame:
    """The rows of ``df`` without nulls, each with the ``score`` of the model fitted on the other folds."""
    coef = fit_many(df, fold, {"all": features}, label, LeaveOut(k), C)["all"]
    models = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in coef])
    model = F.element_at(models, F.col(fold).cast("int") + 1)
    z = sum((quoted(c).cast("double") * F.get(model, F.lit(i)) for i, c in enumerate(features)), F.get(model, F.lit(len(features))))
    return df.filter(~any_null([*features, label])).withColumn("score", 1 / (1 + F.exp(-z)))
