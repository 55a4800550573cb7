"""Aggregates: guarded averages, weighted ratios, modes, pivots, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_if_count(value: Column, when: Column, count: int) -> Column:
    """Average of the matching values if exactly ``count`` of them are known, else null."""
    hit = F.when(when, value)
    return F.when(F.count(hit) == count, F.avg(hit))


def sum_flag(flag: Column, when: Column | None = None) -> Column:
    """Sum of a boolean as integer; null when no row qualifies or all flags are null."""
    as_int = flag.cast("int")
    return F.sum(as_int if when is None else F.when(when, as_int))


def count_where(when: Column) -> Column:
    """Count of qualifying rows, null when there is none (the group has no row then)."""
    n = F.count(F.when(when, 1))
    return F.when(n > 0, n)


def weighted_ratio(points: Column, weight: Column, exclude_unknown: bool = False) -> Column:
    """``sum(points*weight)/sum(weight)``.

    Rows without points add weight to the denominator only, unless
    ``exclude_unknown``.
    """
    total = F.sum(F.when(points.isNotNull(), weight) if exclude_unknown else weight)
    gained = F.coalesce(F.sum(points * weight), F.lit(0.0))
    return F.when(total != 0, gained / total)


def mode_by(df: DataFrame, group: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group, ties go to the smallest value.

    Counting per (group, value) first keeps hot groups spread; the second step
    sees one row per distinct value and combines on the map side.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(*group).agg(best.alias("__best")).select(*group, F.col("__best.v").alias(name))


def single_valued_groups(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Groups having exactly one distinct value, with that value."""
    lo, hi = F.min(value), F.max(value)
    return df.groupBy(*group).agg(lo.alias("__lo"), hi.alias("__hi")).filter("__lo = __hi").select(
        *group, F.col("__lo").alias(value)
    )


def pivot_counts(df: DataFrame, key: str, category: str, values: Sequence[str], prefix: str, fill: bool = True) -> DataFrame:
    """One count column per category value, static schema, one shuffle.

    Keys without any listed category are absent from the result.
    """
    aggs = [F.count(F.when(F.col(category) == v, 1)) for v in values]
    out = df.filter(F.col(category).isin(*values)).groupBy(key).agg(
        *[(a if fill else F.when(a > 0, a)).alias(f"{prefix}{v}") for a, v in zip(aggs, values)]
    )
    return out


def pivot_shares(df: DataFrame, key: str, category: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """Percent of the key's rows per category; null categories do not count."""
    total = F.count(category)
    return df.filter(F.col(category).isNotNull()).groupBy(key).agg(
        *[(F.lit(100.0) * F.count(F.when(F.col(category) == v, 1)) / total).alias(f"{prefix}{v}") for v in values]
    )


def nested_average(df: DataFrame, key: str, cell: Sequence[str], wanted: Mapping[str, Column]) -> DataFrame:
    """Mean over the counts of (key, cell) groups; absent cells do not count.

    ``wanted`` maps an output name to a predicate over the cell columns, so any
    number of nested averages share one two-stage aggregation.
    """
    cells = df.groupBy(key, *cell).agg(F.count(F.lit(1)).alias("__n"))
    return cells.groupBy(key).agg(*[F.avg(F.when(p, F.col("__n"))).alias(n) for n, p in wanted.items()])


def group_mean_first(df: DataFrame, key: str, means: Sequence[str], first: str, order: Sequence[str]) -> DataFrame:
    """Group means plus one attribute, taken from the first row by a stated order."""
    rank = F.struct(*order)
    picked = F.min(F.struct(rank.alias("o"), F.col(first).alias("v")))
    return df.groupBy(key).agg(*[F.avg(m).alias(m) for m in means], picked.alias("__first")).select(
        key, *means, F.col("__first.v").alias(first)
    )


def latest_values(date_col: str, tie: Sequence[str], values: Sequence[str], nulls: str = "first") -> Column:
    """W02 as a struct whose maximum over a group ends in ``v``, the values of its latest row."""
    d = F.col(date_col)
    unknown = d.isNull() if nulls == "first" else d.isNotNull()
    order = F.struct(unknown.alias("u"), d.alias("d"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie)])
    return F.struct(order.alias("o"), F.struct(*values).alias("v"))


def latest_by_key(df: DataFrame, key: Sequence[str], date_col: str, tie: Sequence[str], values: Sequence[str], nulls: str = "first") -> DataFrame:
    """Values of the latest row per key.

    ``nulls='first'`` lets a row without a date win, as a descending sort with
    nulls first does; ``'last'`` prefers dated rows.  ``tie`` breaks equal dates,
    largest first.  A struct maximum combines on the map side.
    """
    return df.groupBy(*key).agg(F.max(latest_values(date_col, tie, values, nulls)).alias("__last")).select(*key, "__last.v.*")


def crosstab_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Cross-tabulation with explicit column values; null rows drop out."""
    return (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row)
        .agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"{column}_{str(v).lower()}") for v in values])
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A21."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def repair_by_mode(
    df: DataFrame,
    owner: str,
    group: str,
    item: str,
    placeholders: Sequence[str],
    shared_groups: Sequence[str],
    out: str,
) -> DataFrame:
    """Overwrite unreliable ids by the usual id of the group or owner.

    * unknown group: null;
    * a group served by one id: every row gets the group's most common real id;
    * a group listed in ``shared_groups``: only placeholder rows change, to the
      owner's most common real id, or the group's when the owner never had one.
    """
    marked = df.withColumn("__real", F.when(~F.coalesce(F.col(item).isin(*placeholders), F.lit(False)), F.col(item)))
    by_group = mode_by(marked.filter(F.col(group).isNotNull()), [group], "__real", "__group_mode")
    by_owner = mode_by(marked, [owner], "__real", "__owner_mode")
    joined = marked.join(by_group, group, "left").join(by_owner, owner, "left")
    is_placeholder = F.col(item).isin(*placeholders)
    in_shared = F.col(group).isin(*shared_groups) if shared_groups else F.lit(False)
    fixed = (
        F.when(F.col(group).isNull(), F.lit(None))
        .when(~in_shared, F.col("__group_mode"))
        .when(is_placeholder, F.coalesce(F.col("__owner_mode"), F.col("__group_mode")))
        .otherwise(F.col(item))
    )
    return joined.withColumn(out, fixed).drop("__real", "__group_mode", "__owner_mode")
