"""Ordered totals and ranks without single-task sorts (W01, W05; basis of E03-E07).

Everything here first aggregates to one row per (group, value).  Those cells are
dealt to range partitions by (group, value), so that a group of any size spreads
over as many partitions as it fills; sums run inside a partition, and the totals
of a group's parts, a few rows, give each part its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortspark.session import stored


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"__r_{k}"])
    return cond


def ranged(cells: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``cells`` dealt to range partitions by (group, order), nulls last, with ``__part``, their number in order, and ``__k``, the group.

    Written once: two readings of the exchange would draw its bounds twice.  The
    number of partitions is that of the session's shuffles unless given, so it grows
    with the cluster.  Runs a job when called.
    """
    keys = [F.col(c).asc_nulls_last() for c in (*group, *order)]
    parts = parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a struct is equal field by field, nulls included
    named = F.struct(*[F.col(g) for g in group]) if group else F.struct(F.lit(0).alias("all"))
    return stored(cells.repartitionByRange(parts, *keys).withColumns({"__part": F.spark_partition_id(), "__k": named}), "ordered")


def ordered_totals(
    cells: DataFrame, group: Sequence[str], order: str | Sequence[str], sums: Sequence[str], slices: Column | None = None, parts: int | None = None
) -> DataFrame:
    """Add ``{s}_before`` (rows of the group with a smaller value) and ``{s}_total``.

    ``cells`` holds one row per (group, order); null values come last.  They are cut
    by range partitions (see :func:`ranged`), or, without a job of their own, by
    ``slices``, a caller's monotone column of the value.
    """
    order = [order] if isinstance(order, str) else list(order)
    if slices is not None:
        return _sliced_totals(cells, group, order, sums, slices)
    cut = ranged(cells, group, order, parts)
    per_part = cut.groupBy("__part", "__k").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    # a group has one row per part here
    earlier = W.partitionBy("__k").orderBy(F.col("__part").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        F.struct("__part").alias("__at"),
        "__k",
        *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(W.partitionBy("__k")).alias(f"{s}_total") for s in sums],
    )
    cut = cut.withColumn("__at", F.struct("__part"))
    inside = W.partitionBy("__at", "__k").orderBy(*[F.col(o).asc_nulls_last() for o in order]).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumns({f"__l_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    if not group:
        offsets = F.broadcast(offsets)  # one row per partition
    joined = local.join(offsets, ["__at", "__k"])
    return joined.withColumns({f"{s}_before": F.col(f"__l_{s}") + F.col(f"__o_{s}") for s in sums}).drop(
        "__at", "__part", "__k", *[f"__l_{s}" for s in sums], *[f"__o_{s}" for s in sums]
    )


def _sliced_totals(cells: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], slices: Column) -> DataFrame:
    """:func:`ordered_totals` by the caller's slices; plain key columns, which sort faster than structs."""
    sliced, keys = cells.withColumn("__slice", slices), [*group, "__slice"]
    per_slice = sliced.groupBy(*keys).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    over_group = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    earlier = over_group.orderBy(F.col("__slice").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(over_group).alias(f"{s}_total") for s in sums],
    )
    inside = W.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order]).rowsBetween(W.unboundedPreceding, -1)
    local = sliced.withColumns({f"__l_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    joined = local.join(offsets, _null_safe(local, offsets, keys))
    return joined.withColumns({f"{s}_before": F.col(f"__l_{s}") + F.col(f"__o_{s}") for s in sums}).drop(
        "__slice", *[f"__r_{k}" for k in keys], *[f"__l_{s}" for s in sums], *[f"__o_{s}" for s in sums]
    )


def percent_rank_by(
    df: DataFrame, group: Sequence[str], value: str, out: str = "percent_rank", slices: Column | None = None
) -> DataFrame:
    """Percent rank of each row inside its group, null values last.

    ``(rows with a smaller value) / (group size - 1)``, 0 for a group of one.
    Computed on counts per distinct value, so the cost of a hot group is its
    number of distinct values, not its number of rows; the per-value ranks are
    then joined back (a broadcast when they are small).
    """
    keys = [*group, value]
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered_totals(cells, group, value, ["__n"], slices)
    rank = F.when(F.col("__n_total") > 1, F.col("__n_before") / (F.col("__n_total") - 1)).otherwise(F.lit(0.0))
    right = ranked.select(*[F.col(k).alias(f"__r_{k}") for k in keys], rank.alias(out))
    return df.join(right, _null_safe(df, right, keys), "left").drop(*[f"__r_{k}" for k in keys])
