"""Row and column operators: null policy, column pruning by content, blocklists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its literal name: dots and backticks are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def any_null(columns: Sequence[str]) -> Column:
    """True where one of the columns is null."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | quoted(c).isNull()
    return bad


def add_empty_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Typed all-null columns, ``{name: type}``."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})


def lower_names(df: DataFrame) -> DataFrame:
    """P03."""
    return df.toDF(*[c.lower() for c in df.columns])


def mandatory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose mandatory columns are all known."""
    return df.filter(~any_null(columns))


def mandatory_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts before and after the mandatory filter, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(~any_null(columns)).alias("rows_after"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows`` and the null count of each column, in a single pass."""
    columns = list(columns or df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(quoted(c).isNull()).alias(c) for c in columns],
    )


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, nulls, percent)`` per column, one pass over the data."""
    columns = list(columns or df.columns)
    counts = null_counts(df, columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("nulls")) for c in columns])
    return counts.select("__rows", F.explode(pairs).alias("p")).select(
        F.col("p.column").alias("column"),
        F.col("p.nulls").alias("nulls"),
        (F.round(F.col("p.nulls") / F.col("__rows"), 3) * 100).alias("percent"),
    )


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value.  Runs one aggregate job that returns one row."""
    counts = df.agg(*[F.count(quoted(c)).alias(c) for c in df.columns]).first()
    return df.select(*[quoted(c) for c in df.columns if counts[c] > 0])


class NullRowsError(ValueError):
    """Raised by the strict null policy."""


def apply_null_policy(df: DataFrame, policy: str = "strict", columns: Sequence[str] | None = None) -> DataFrame:
    """``lax`` drops rows with any null, ``strict`` fails when there is one.

    ``lax`` stays lazy; ``strict`` needs one probing job that stops at the first null.
    """
    if policy not in ("strict", "lax"):
        raise ValueError("policy must be 'lax' or 'strict'")
    columns = list(columns or df.columns)
    if policy == "lax":
        return df.filter(~any_null(columns))
    if df.filter(any_null(columns)).limit(1).count():
        raise NullRowsError("rows with nulls under the strict null policy")
    return df


def drop_flagged(df: DataFrame, suffix: str = "_isnull") -> DataFrame:
    """Drop rows where any null indicator is set, then the indicators."""
    flags = [c for c in df.columns if c.endswith(suffix)]
    if not flags:
        return df
    total = sum((quoted(c) for c in flags), F.lit(0))
    return df.filter(total == 0).drop(*[quoted(c) for c in flags])


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by a stated order.

    A struct minimum is an aggregate with map-side combine, so a hot key never
    collects in one task the way a window over the key would.
    """
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    packed = df.groupBy(*keys).agg(
        F.min(F.struct(rank.alias("__order"), F.struct(*[c for c in df.columns]).alias("__row"))).alias("__first")
    )
    return packed.select("__first.__row.*")


def exclude_ids(df: DataFrame, column: str, blocked: DataFrame | Sequence) -> DataFrame:
    """Drop rows with a blocked id; a null id is kept."""
    if isinstance(blocked, DataFrame):
        return df.join(blocked.select(F.col(blocked.columns[0]).alias(column)), column, "left_anti")
    return df.filter(~F.coalesce(F.col(column).isin(*blocked), F.lit(False))) if blocked else df


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns present in both frames, in the order of the first."""
    return [c for c in a.columns if c in set(b.columns)]
