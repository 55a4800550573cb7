"""Half-yearly check dates (L01/X35) and rolling windows.

Check dates fall on 20 January and 15 October.  Numbering them consecutively
(two per calendar year) turns "the n-th check date after a date" into integer
arithmetic, so no loop or user function is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: (month, day) of the two check dates
WINTER_CHECK = (1, 20)
AUTUMN_CHECK = (10, 15)
_WINTER = WINTER_CHECK[0] * 100 + WINTER_CHECK[1]
_AUTUMN = AUTUMN_CHECK[0] * 100 + AUTUMN_CHECK[1]


def _require(n: int) -> None:
    if n == 0:
        raise ValueError("n must not be 0: it counts check dates after (n>0) or before (n<0) a date")


def nth_check_date(c: Column | str, n: int) -> Column:
    """The n-th check date strictly after (n>0) or strictly before (n<0) a date column."""
    _require(n)
    c = F.col(c) if isinstance(c, str) else c
    md = F.month(c) * 100 + F.dayofmonth(c)
    if n > 0:
        slot = F.when(md < _WINTER, 0).when(md < _AUTUMN, 1).otherwise(2) + (n - 1)
    else:
        slot = F.when(md <= _WINTER, -1).when(md <= _AUTUMN, 0).otherwise(1) + (n + 1)
    index = 2 * F.year(c) + slot
    year = F.shiftright(index, 1)
    return F.when(
        index % 2 == 0, F.make_date(year, F.lit(WINTER_CHECK[0]), F.lit(WINTER_CHECK[1]))
    ).otherwise(F.make_date(year, F.lit(AUTUMN_CHECK[0]), F.lit(AUTUMN_CHECK[1])))


def checks_between(start: Column | str, until: Column | str) -> Column:
    """Number of check dates strictly after ``start`` and strictly before ``until``.

    "The n-th check date after start lies before until" is the same as this
    count reaching n, which is much cheaper than building n dates.  The value is
    zero or negative when no check date lies between.
    """
    start = F.col(start) if isinstance(start, str) else start
    until = F.col(until) if isinstance(until, str) else until
    md_start = F.month(start) * 100 + F.dayofmonth(start)
    md_until = F.month(until) * 100 + F.dayofmonth(until)
    first = 2 * F.year(start) + F.when(md_start < _WINTER, 0).when(md_start < _AUTUMN, 1).otherwise(2)
    last = 2 * F.year(until) + F.when(md_until <= _WINTER, -1).when(md_until <= _AUTUMN, 0).otherwise(1)
    return last - first + 1


def shift_check_dates(d: date | None, n: int) -> date | None:
    """Driver-side form of :func:`nth_check_date`, for window bounds."""
    _require(n)
    if d is None:
        return None
    md = d.month * 100 + d.day
    if n > 0:
        slot = (0 if md < _WINTER else 1 if md < _AUTUMN else 2) + n - 1
    else:
        slot = (-1 if md <= _WINTER else 0 if md <= _AUTUMN else 1) + n + 1
    year, odd = divmod(2 * d.year + slot, 2)
    return date(year, *(AUTUMN_CHECK if odd else WINTER_CHECK))


def add_months(d: date, months: int) -> date:
    """Driver-side month arithmetic, clipped to the length of the target month."""
    year, month0 = divmod(d.year * 12 + d.month - 1 + months, 12)
    month = month0 + 1
    following = date(year + month // 12, month % 12 + 1, 1)
    return date(year, month, min(d.day, (following - date(year, month, 1)).days))


@dataclass(frozen=True)
class Window:
    """One train/test period: train ``[start, split)``, test ``[split, end)``."""

    window_id: int
    start: date
    split: date
    end: date | None = None


def rolling_windows(first: date, last: date, train_months: int, test_months: int | None, step_months: int) -> list[Window]:
    """Consecutive windows; a configuration-sized list on the driver."""
    if step_months <= 0:
        raise ValueError("step_months must be positive")
    out: list[Window] = []
    k = 0
    while (start := add_months(first, k * step_months)) <= last:
        split = add_months(start, train_months)
        end = None if test_months is None else add_months(split, test_months)
        out.append(Window(k, start, split, end))
        k += 1
    return out


def windows_frame(spark: SparkSession, first: date, last: date, train_months: int, test_months: int, step_months: int) -> DataFrame:
    """The same windows generated inside Spark."""
    step = F.expr(f"interval {int(step_months)} month")
    return (
        spark.range(1)
        .select(F.posexplode(F.sequence(F.lit(first), F.lit(last), step)).alias("window_id", "train_start"))
        .withColumn("split_date", F.add_months("train_start", train_months))
        .withColumn("test_end", F.add_months("split_date", test_months))
    )
