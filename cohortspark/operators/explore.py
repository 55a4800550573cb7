"""Exploration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import metrics as E
from cohortspark.operators.gram import Moments, moments, principal_axes
from cohortspark.operators.resample import bootstrap_auc, bootstrap_mean
from cohortspark.operators.rows import any_null, quoted


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form ``(keep..., feature, value)``; values become double."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.feature", "__p.value")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` over rows without nulls; null where a column is constant or there are no rows.

    One pass of p x p sums, whatever the number of columns; runs a job when called.
    """
    corr = moments(df, columns).correlation()
    rows = [(a, b, None if np.isnan(corr[i, j]) else float(corr[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def _both(x: Column, y: Column) -> Column:
    """``x`` where both are known."""
    return F.when(x.isNotNull() & y.isNotNull(), x)


def pair_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over known pairs; null, not an error, when one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(_both(x, y)) * F.stddev_pop(_both(y, x)))


def pairwise_fit(df: DataFrame, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Correlation and regression line of every column pair per group, one pass."""
    aggs, cells = [], []
    for i, (x, y) in enumerate(combinations(columns, 2)):
        xs, ys = quoted(x).cast("double"), quoted(y).cast("double")
        slope = F.try_divide(F.covar_pop(xs, ys), F.var_pop(_both(xs, ys)))
        line = F.avg(_both(ys, xs)) - slope * F.avg(_both(xs, ys))
        aggs += [pair_correlation(xs, ys).alias(f"r{i}"), slope.alias(f"s{i}"), line.alias(f"i{i}")]
        cells.append(
            F.struct(
                F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("corr"),
                F.col(f"s{i}").alias("slope"), F.col(f"i{i}").alias("intercept"),
            )
        )
    wide = df.groupBy(*group).agg(*aggs)
    return wide.select(*group, F.explode(F.array(*cells)).alias("__c")).select(*group, "__c.*")


def _axes(df: DataFrame, columns: Sequence[str]) -> tuple[Moments, np.ndarray, np.ndarray]:
    """Moments, and eigenvalues and axes of the standardised columns; constant ones have no part in them."""
    m = moments(df, columns)
    corr = m.correlation()
    corr[np.isnan(corr)] = 0.0
    return m, *principal_axes(corr)


def standardised(df: DataFrame, columns: Sequence[str], m: Moments | None = None) -> list[Column]:
    """Each column with mean 0 and sample deviation 1; 0 where it is constant."""
    m = moments(df, columns) if m is None else m
    scale = m.deviation()
    return [(quoted(c).cast("double") - float(u)) / float(s) if s > 0 else F.lit(0.0) for c, u, s in zip(columns, m.mean, scale)]


def pca_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explained variance per component of the standardised columns and its running total (p values)."""
    _, values, _ = _axes(df, columns)
    shares = np.maximum(values, 0) / max(values.sum(), 1e-300)
    rows = [(i, float(r), float(t)) for i, (r, t) in enumerate(zip(shares, np.cumsum(shares)))]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double")


def pca_project(df: DataFrame, columns: Sequence[str], keep: Sequence[str], components: int = 1) -> DataFrame:
    """Rows without nulls projected on the first components of the standardised columns.

    A projection is an expression of the row: no vectors, no model.
    """
    m, _, axes = _axes(df, columns)
    scaled = standardised(df, columns, m)
    score = lambda k: sum((z * float(w) for z, w in zip(scaled, axes[:, k])), F.lit(0.0))
    return df.filter(~any_null(columns)).select(*keep, *[score(i).alias(f"pc{i}") for i in range(components)])


def window_counts(df: DataFrame, target: str, window: str) -> DataFrame:
    """Rows per outcome and window."""
    return df.groupBy(window, target).agg(F.count(F.lit(1)).alias("n"))


def window_means(df: DataFrame, target: str, window: str, columns: Sequence[str], n_boot: int = 1500, alpha: float = 0.05) -> DataFrame:
    """Mean of each feature per outcome and window with a bootstrap interval."""
    long = unpivot(df, [window, target], columns)
    return bootstrap_mean(long, "value", [window, target, "feature"], n_boot, alpha)


def auc_by_feature(df: DataFrame, target: str, index: str, columns: Sequence[str]) -> DataFrame:
    """Each feature used as a score, AUC per index value, in one job."""
    return E.auc(unpivot(df, [index, target], columns), target, "value", [index, "feature"])


def auc_by_feature_ci(df: DataFrame, target: str, index: str, columns: Sequence[str], n_boot: int = 1500, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """The same with a bootstrap interval."""
    long = unpivot(df, [index, target], columns)
    group = [index, "feature"]
    point = E.auc(long, target, "value", group)
    interval = bootstrap_auc(long, target, "value", group, n_boot, alpha, seed)
    return point.join(interval, group, "left")
