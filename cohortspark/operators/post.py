"""Postprocessing of training matrices: one-hot, null dummies, fills.

Whatever depends on the data (category names, which columns have nulls, medians)
is learned once from the training rows in a single aggregate job; applying the
result is a plain projection, identical for train and test.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.operators.joins import assign_ids
from cohortspark.operators.ranks import ordered_totals
from cohortspark.session import stored

#: Categories a column may become columns for; beyond, :func:`sparse_one_hot` keeps them in one vector.
WIDE_LIMIT = 2000
ONE_HOT, NULL_DUMMY, FILL_ZERO, FILL_MEDIAN = "one_hot", "null_dummy", "fill_zero", "fill_median"
STEPS = (ONE_HOT, NULL_DUMMY, FILL_ZERO, FILL_MEDIAN)


def _zero(df: DataFrame, column: str) -> Column:
    boolean = isinstance(df.schema[column].dataType, T.BooleanType)
    return F.lit(False) if boolean else F.lit(0)


def quoted(column: str) -> Column:
    return F.col(f"`{column}`")


@dataclass(frozen=True)
class PostPlan:
    """What was learned from the training rows."""

    steps: Mapping[str, str]
    categories: Mapping[str, Sequence] = field(default_factory=dict)
    with_nulls: frozenset = frozenset()
    medians: Mapping[str, float] = field(default_factory=dict)

    def outputs(self, column: str) -> list[str]:
        """Columns that replace ``column``."""
        step = self.steps.get(column)
        if step == ONE_HOT:
            return [f"{column}_{v}" for v in self.categories[column]]
        if step == NULL_DUMMY and column in self.with_nulls:
            return [f"{column}_isnull", column]
        return [column]

    def apply(self, df: DataFrame) -> DataFrame:
        """M06-M09 as one projection; other columns pass through in place."""
        out: list[Column] = []
        for c in df.columns:
            step = self.steps.get(c)
            if step == ONE_HOT:
                for v in self.categories[c]:
                    out.append(F.coalesce(quoted(c) == F.lit(v), F.lit(False)).cast("int").alias(f"{c}_{v}"))
            elif step == NULL_DUMMY:
                out.append(F.coalesce(quoted(c), _zero(df, c)).alias(c))
                if c in self.with_nulls:
                    out.append(quoted(c).isNull().cast("int").alias(f"{c}_isnull"))
            elif step == FILL_ZERO:
                out.append(F.coalesce(quoted(c), _zero(df, c)).alias(c))
            elif step == FILL_MEDIAN and c in self.medians:
                out.append(F.coalesce(quoted(c), F.lit(self.medians[c])).alias(c))
            else:
                out.append(quoted(c))
        return df.select(*out)


def exact_median(df: DataFrame, column: str) -> float | None:
    """Median of a column without nulls, from ordered counts per value.

    The built-in exact percentile merges all distinct values in one task; here
    only the one or two middle values are picked from sliced running counts.
    """
    value = quoted(column).cast("double")
    cells = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = ordered_totals(cells, (), "v", ["c"])
    at = lambda i: F.max(F.when((F.col("c_before") <= i) & (i < F.col("c_before") + F.col("c")), F.col("v")))
    low, high = F.floor((F.col("c_total") - 1) / 2), F.floor(F.col("c_total") / 2)
    return placed.agg(((at(low) + at(high)) / 2).alias("m")).first()["m"]


def learn(train: DataFrame, steps: Mapping[str, str], test: DataFrame | None = None, approximate_median: bool = False) -> PostPlan:
    """Learn a plan from the training rows: one aggregate job with one result row, and
    one more job per one-hot column and exact median.

    With ``test``, categories that do not occur there are dropped, so that both
    matrices have the same columns after separate encoding would be intersected.
    A column of more than ``WIDE_LIMIT`` categories is an error: the driver never
    holds more of them (see :func:`sparse_one_hot`).
    """
    for column, step in steps.items():
        if step not in STEPS:
            raise ValueError(f"unknown postprocessing step {step!r} for {column}")
    steps = {c: s for c, s in steps.items() if c in train.columns}
    hot = [c for c, s in steps.items() if s == ONE_HOT]
    dummy = [c for c, s in steps.items() if s == NULL_DUMMY]
    median = [c for c, s in steps.items() if s == FILL_MEDIAN]
    aggs = [F.count_if(quoted(c).isNull()).alias(f"d{i}") for i, c in enumerate(dummy)]
    if approximate_median:
        aggs += [F.percentile_approx(quoted(c), 0.5).alias(f"m{i}") for i, c in enumerate(median)]
    row = train.agg(*aggs).first() if aggs else None
    medians = {c: row[f"m{i}"] if approximate_median else exact_median(train, c) for i, c in enumerate(median)}
    categories = {c: few_categories(train, c, test) for c in hot}
    return PostPlan(
        steps=steps,
        categories=categories,
        with_nulls=frozenset(c for i, c in enumerate(dummy) if row[f"d{i}"] > 0),
        medians={c: float(m) for c, m in medians.items() if m is not None},
    )


def few_categories(train: DataFrame, column: str, test: DataFrame | None = None) -> list:
    """The known values of a column in order, of those in ``test`` too; at most ``WIDE_LIMIT``, else an error."""
    values = train.select(quoted(column).alias("v")).filter("v IS NOT NULL").distinct()
    if test is not None:
        values = values.join(test.select(quoted(column).alias("v")), "v", "left_semi")
    found = [r["v"] for r in values.limit(WIDE_LIMIT + 1).collect()]
    if len(found) > WIDE_LIMIT:
        raise ValueError(f"{column} has more than {WIDE_LIMIT} categories; use sparse_one_hot")
    return sorted(found)


def category_positions(train: DataFrame, column: str) -> DataFrame:
    """M06 at any width: (category, position) with positions 0, 1, ... that depend on the set of categories only."""
    return assign_ids([train.select(quoted(column).alias("category")).filter("category IS NOT NULL")], "position").withColumn("position", F.col("position") - 1)


def with_positions(df: DataFrame, column: str, positions: DataFrame, out: str) -> DataFrame:
    """``df`` with the category's position; null for null and for categories that ``positions`` lacks."""
    key = positions.select(F.col("category").alias("__category"), F.col("position").alias(out))
    return df.join(key, quoted(column) == F.col("__category"), "left").drop("__category")


def sparse_one_hot(train: DataFrame, columns: Sequence[str], test: DataFrame | None = None, out: str = "one_hot") -> tuple[DataFrame, DataFrame | None, list[int]]:
    """M06 for columns with any number of categories: one sparse vector per row for the learners.

    Returns train and test with the vector column ``out``, and the width of each
    column's part.  Categories come from the training rows; null and new ones have
    zeros.  Positions live in a table, so nothing grows on the driver; it learns
    the widths only.
    """
    widths, parts = [], [train, test]
    for i, column in enumerate(columns):
        positions = stored(category_positions(train, column), "categories")
        widths.append(positions.count())
        parts = [None if p is None else with_positions(p, column, positions, f"__p{i}") for p in parts]

    def encode(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        size, at = sum(widths), 0
        hits = []
        for i, w in enumerate(widths):
            hits.append(F.col(f"__p{i}") + at)
            at += w
        known = F.array_compact(F.array(*hits)) if hits else F.array()
        return df.withColumn(out, _sparse(size)(known.cast("array<int>"))).drop(*[f"__p{i}" for i in range(len(widths))])

    return encode(parts[0]), encode(parts[1]), widths


def _sparse(size: int):
    @F.pandas_udf(VectorUDT())
    def vector(positions: pd.Series) -> pd.DataFrame:
        at = [np.sort(p) for p in positions]
        return pd.DataFrame({"type": np.zeros(len(at), "int8"), "size": size, "indices": at, "values": [np.ones(len(p)) for p in at]})

    return vector


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """M06 for one column; values default to those that occur."""
    plan = learn(df, {column: ONE_HOT}) if values is None else PostPlan({column: ONE_HOT}, {column: list(values)})
    return plan.apply(df)


def null_dummy(df: DataFrame, column: str) -> DataFrame:
    """Indicator only when there is a null, then fill with zero."""
    return learn(df, {column: NULL_DUMMY}).apply(df)


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M08."""
    return PostPlan({c: FILL_ZERO for c in columns}).apply(df)


def fill_median(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """M09."""
    return learn(df, {c: FILL_MEDIAN for c in columns}, approximate_median=approximate).apply(df)
