"""Means and co-moments of many columns in one pass.

A task adds up its rows' deviations from its own means, p x p numbers, and pairs of
tasks are joined with the shift between their means, so no digits are lost to large
values.  Sums meet in ``FAN`` groups before one row goes to the driver; the plan does
not grow with the columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.rows import any_null, quoted

FAN = 32


@dataclass(frozen=True)
class Moments:
    """Rows, means and summed products of deviations of the columns."""

    rows: int
    mean: np.ndarray
    products: np.ndarray

    def joined(self, other: Moments) -> Moments:
        n = self.rows + other.rows
        if n == 0:
            return self
        shift = other.mean - self.mean
        products = self.products + other.products + np.outer(shift, shift) * (self.rows * other.rows / n)
        return Moments(n, self.mean + shift * (other.rows / n), products)

    def packed(self) -> np.ndarray:
        return np.r_[self.rows, self.mean, self.products.ravel()]

    @staticmethod
    def unpacked(x: np.ndarray, p: int) -> Moments:
        return Moments(int(x[0]), x[1 : p + 1], x[p + 1 :].reshape(p, p))

    def correlation(self) -> np.ndarray:
        """Not-a-number where a column is constant."""
        spread = np.sqrt(np.diag(self.products))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(np.outer(spread, spread) > 0, self.products / np.outer(spread, spread), np.nan)

    def deviation(self) -> np.ndarray:
        """Sample deviations."""
        return np.sqrt(np.diag(self.products) / max(self.rows - 1, 1))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Over rows without a null in any of ``columns``; runs one job."""
    p = len(columns)
    none = Moments(0, np.zeros(p), np.zeros((p, p)))
    rows = df.filter(~any_null(columns)).select(F.array(*[quoted(c).cast("double") for c in columns]).alias("x"), F.spark_partition_id().cast("long").alias("part"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = none, 0
        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                mean = x.mean(0)
                total = total.joined(Moments(len(x), mean, (x - mean).T @ (x - mean)))
        yield pa.RecordBatch.from_arrays([pa.array([part % FAN]), pa.array([total.packed()], pa.list_(pa.float64()))], names=["slot", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = none
        for s in t.column("sums"):
            total = total.joined(Moments.unpacked(s.values.to_numpy(), p))
        return pa.table({"slot": pa.array([0]), "sums": pa.array([total.packed()], pa.list_(pa.float64()))})

    kind = "slot long, sums array<double>"
    made = rows.mapInArrow(sums, kind).groupBy("slot").applyInArrow(add, kind).groupBy("slot").applyInArrow(add, kind)
    got = made.first()
    return none if got is None else Moments.unpacked(np.array(got["sums"]), p)


def principal_axes(correlation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit axes as columns.

    An axis points to where its largest loading is positive; of loadings that are
    equal to nine digits the first decides.
    """
    values, axes = np.linalg.eigh(correlation)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    for k in range(axes.shape[1]):
        size = np.abs(axes[:, k])
        axes[:, k] *= np.sign(axes[np.flatnonzero(size >= size.max() - 1e-9)[0], k])
    return values, axes
