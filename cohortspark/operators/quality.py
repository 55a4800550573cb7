"""Declarative data contracts checked as DataFrames (Q01-Q10).

A rule passes when its condition is true or unknown, as a CHECK constraint does.
Row rules of a table are evaluated in one scan; unique and foreign-key rules
each add one aggregation or anti join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import stored


@dataclass(frozen=True)
class Check:
    """One row rule: ``condition(as_of)`` must not be false.  ``kind`` and ``args`` say which one it is."""

    column: str
    rule: str
    condition: Callable[[date], Column]
    kind: str = ""
    args: tuple = ()


def has_length(column: str, n: int) -> Check:
    """Q01."""
    return Check(column, f"length = {n}", lambda _: F.length(column) == n, "length", (n,))


def max_length(column: str, n: int) -> Check:
    """Q01, declared width of a text column."""
    return Check(column, f"length <= {n}", lambda _: F.length(column) <= n, "width", (n,))


def one_of(column: str, values: Sequence) -> Check:
    """Q02."""
    return Check(column, "allowed values", lambda _: F.col(column).isin(*values), "values", tuple(values))


def in_range(column: str, lower=None, upper=None, open_lower: bool = False, open_upper: bool = False) -> Check:
    """Q03."""
    def condition(_):
        c, ok = F.col(column), F.lit(True)
        if lower is not None:
            ok = ok & (c > lower if open_lower else c >= lower)
        if upper is not None:
            ok = ok & (c < upper if open_upper else c <= upper)
        return ok
    return Check(column, f"range {lower}..{upper}", condition, "range", (lower, upper, open_lower, open_upper))


def multiple_of(column: str, step: int) -> Check:
    """Q03."""
    return Check(column, f"multiple of {step}", lambda _: F.col(column) % step == 0, "multiple", (step,))


def after(column: str, floor: date) -> Check:
    """Q04."""
    return Check(column, f"after {floor}", lambda _: F.col(column) > F.lit(floor), "after", (floor,))


def not_after_today(column: str, days: int = 0) -> Check:
    """Q04: at most ``days`` days after the reference date."""
    return Check(column, f"not after today + {days}", lambda d: F.col(column) <= F.date_add(F.lit(d), days), "not_after", (days,))


def before_months_ahead(column: str, months: int) -> Check:
    """Q04: earlier than the reference date plus some months."""
    return Check(column, f"before today + {months} months", lambda d: F.col(column) < F.add_months(F.lit(d), months), "before_months", (months,))


def satisfies(column: str, rule: str, condition: Column | str) -> Check:
    """Q05: any expression, typically across columns."""
    return Check(column, rule, lambda _: F.expr(condition) if isinstance(condition, str) else condition, "sql", (condition,))


def matches(column: str, pattern: str) -> Check:
    """Q06, case-insensitive."""
    return Check(column, f"matches {pattern}", lambda _: F.col(column).rlike(f"(?i){pattern}"), "matches", (pattern,))


def not_null(column: str) -> Check:
    """Q08."""
    return Check(column, "not null", lambda _: F.col(column).isNotNull(), "known")


def year_before(column: str, years_ahead: int = 0, inclusive: bool = False) -> Check:
    """Q10: a year earlier than (or equal to) the reference year plus an offset."""
    def condition(d):
        limit = F.lit(d.year + years_ahead)
        return F.col(column) <= limit if inclusive else F.col(column) < limit
    return Check(column, f"year < now + {years_ahead}" if not inclusive else f"year <= now + {years_ahead}", condition, "year", (years_ahead, inclusive))


_COLUMNS = ("table", "rule", "key", "value")


def _named(df: DataFrame, table: str, key: Sequence[str], cells: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """``(table, rule, key, value)`` per row and cell (rule, column, condition) whose condition is true.

    Rows where none is true go first; the others are copied by the numbers of the cells,
    from which the texts follow, so that a count of rules makes no text per row.
    """
    some = reduce(lambda a, b: a | b, [condition for *_, condition in cells])
    number = F.array(*[F.when(condition, F.lit(i)) for i, (*_, condition) in enumerate(cells)])
    found = df.filter(some).withColumn("__cell", F.explode(number)).filter("__cell IS NOT NULL")
    by_cell = lambda texts: F.coalesce(*[F.when(F.col("__cell") == i, t) for i, t in enumerate(texts)])
    return found.select(
        F.lit(table).alias("table"),
        by_cell([F.lit(rule) for rule, *_ in cells]).alias("rule"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"),
        by_cell([F.col(column).cast("string") for _, column, _ in cells]).alias("value"),
    )


def row_violations(df: DataFrame, table: str, key: Sequence[str], checks: Sequence[Check], as_of: date) -> DataFrame:
    """``(table, rule, key, value)`` per broken row rule, all rules in one scan."""
    return _named(df, table, key, [(f"{c.column}: {c.rule}", c.column, ~c.condition(as_of)) for c in checks])


def unique_violations(df: DataFrame, table: str, columns: Sequence[str], primary: bool = False) -> DataFrame:
    """Q07: repeated keys; rows with a null part are exempt, except in a primary key."""
    name = ", ".join(columns)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    bad = (~known | (F.col("__n") > 1)) if primary else (known & (F.col("__n") > 1))
    return groups.filter(bad).select(
        F.lit(table).alias("table"),
        F.lit(f"{name}: {'primary key' if primary else 'unique'}").alias("rule"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key"),
        F.col("__n").cast("string").alias("value"),
    )


def fk_violations(df: DataFrame, table: str, key: Sequence[str], column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Q09: rows whose known reference has no parent row (left anti join)."""
    right = parent.select(F.col(parent_column).alias(column))
    return df.filter(F.col(column).isNotNull()).join(right, column, "left_anti").select(
        F.lit(table).alias("table"),
        F.lit(f"{column}: references").alias("rule"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"),
        F.col(column).cast("string").alias("value"),
    )


def references(df: DataFrame, table: str, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Known references of a table as rows ``(table, rule, key, value)``, one per column, from one scan."""
    return _named(df, table, key, [(f"{c}: references", c, F.col(c).isNotNull()) for c in columns])


def probe(refs: Sequence[DataFrame], parent: DataFrame, parent_column: str) -> DataFrame:
    """Q09 for all references to one parent: one anti join, whatever the number of tables.

    The different values are looked up, not every row; those without a parent are written
    once, in a job of their own when this is called, and rows that have one of them come out.
    """
    known = parent.select(F.col(parent_column).cast("string").alias("value"))
    rows = all_violations(refs)
    unknown = stored(rows.select("value").distinct().join(known, "value", "left_anti"), "unknown")
    return rows.join(unknown, "value", "left_semi").select(*_COLUMNS)


def fan_out(df: DataFrame, key: str) -> DataFrame:
    """Keys that would multiply rows when this frame is joined on ``key``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def all_violations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*_COLUMNS) for p in parts])
