"""Survival labels over half-yearly check dates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.calendar import checks_between, shift_check_dates
from cohortspark.functions.cleaning import half_open
from cohortspark.operators.rows import mandatory

# fixed values: the six enrolment states
MATRICULATING = "Matriculating"
NEVER_STARTED = "Did not matriculate"
LEFT = ("Transferred out", "Withdrew")
GRADUATED = "Graduated"
ATTENDING = "Attending"
STATUSES = (MATRICULATING, NEVER_STARTED, *LEFT, GRADUATED, ATTENDING)
HALF_YEARS = tuple(range(1, 9))


def label_name(n: int) -> str:
    return f"persist_{n}_halfyear"


def survived(n: int, until_end: Column | None = None, until_verified: Column | None = None) -> Column:
    """Did the record outlive its n-th check date?  True, false or unknown.

    Graduated and still-attending records only ever prove survival: when their
    date lies before the check date the answer is unknown, not false.  The two
    arguments are the check dates outlived by the end and by the last
    verification, when the caller has them as columns already.
    """
    by_end = checks_between("start_date", "end_date") if until_end is None else until_end
    by_verified = checks_between("start_date", "date_last_verified") if until_verified is None else until_verified
    state = F.col("status")
    return (
        F.when(state == NEVER_STARTED, False)
        .when(state.isin(*LEFT), by_end >= n)
        .when((state == GRADUATED) & (by_end >= n), True)
        .when((state == ATTENDING) & (by_verified >= n), True)
    )


def labelled(rows: DataFrame, half_years: Sequence[int]) -> DataFrame:
    """Add label columns; the outlived check dates are counted once per row."""
    counted = rows.withColumns(
        {
            "__by_end": checks_between("start_date", "end_date"),
            "__by_verified": checks_between("start_date", "date_last_verified"),
        }
    )
    by_end, by_verified = F.col("__by_end"), F.col("__by_verified")
    return counted.withColumns({label_name(n): survived(n, by_end, by_verified) for n in half_years}).drop(
        "__by_end", "__by_verified"
    )


def label_table(enrolments: DataFrame, half_years: Sequence[int] = HALF_YEARS, ids: Sequence[str] = ("enrollid", "studentid", "collegeid")) -> DataFrame:
    """One boolean per half-year, in one projection; rows need a start date and a status."""
    known = mandatory(enrolments, ["start_date", "status"])
    return labelled(known, half_years).select(*ids, *[label_name(n) for n in half_years])


def label_violations(enrolments: DataFrame, key: str = "enrollid") -> DataFrame:
    """Rows no label rule covers (unknown status or missing start date)."""
    state = F.col("status")
    rule = F.when(F.col("start_date").isNull(), "start_date missing").when(
        ~F.coalesce(state.isin(*STATUSES), F.lit(False)), "status unknown"
    )
    return enrolments.select(F.col(key).cast("string").alias("key"), rule.alias("rule"), state.alias("value")).filter(
        F.col("rule").isNotNull()
    )


@dataclass(frozen=True)
class LabelSpec:
    """The target "survived n half-years" restricted to a window of start dates.

    Both bounds move back n check dates, so the outcome of every row in the
    window is known by the upper bound.
    """

    n: int

    @property
    def column(self) -> str:
        return label_name(self.n)

    def bounds(self, lower: date | None, upper: date | None) -> tuple[date | None, date | None]:
        return shift_check_dates(lower, -self.n), shift_check_dates(upper, -self.n)

    def spine(self, enrolments: DataFrame, lower: date | None = None, upper: date | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Rows with a known label whose start date lies in the shifted window."""
        lo, hi = self.bounds(lower, upper)
        rows = enrolments.filter(half_open("start_date", lo, hi) & F.col("status").isNotNull() & F.col("start_date").isNotNull())
        return labelled(rows, [self.n]).select("enrollid", "studentid", "collegeid", *keep, self.column).filter(
            F.col(self.column).isNotNull()
        )


def transitions(enrolments: DataFrame, lower: date | None, upper: date | None, last: int = 8) -> DataFrame:
    """The chain 0->1 ... 7->8 as one frame ``(enrollid, transition, persist)``.

    A row takes part in step n when it survived n-1 half-years, its outcome at n
    is known and its start lies in the window shifted by n check dates.  All
    steps come out of one scan: each row is expanded to the steps it belongs to.
    """
    known = labelled(mandatory(enrolments, ["start_date", "status"]), range(1, last + 1))
    steps = []
    for n in range(1, last + 1):
        lo, hi = LabelSpec(n).bounds(lower, upper)
        outcome = F.col(label_name(n))
        inside = half_open("start_date", lo, hi) & outcome.isNotNull()
        if n > 1:
            inside = inside & F.coalesce(F.col(label_name(n - 1)), F.lit(False))
        steps.append(
            F.when(inside, F.struct(F.lit(f"{n - 1}->{n}").alias("transition"), outcome.alias("persist")))
        )
    return (
        known.withColumn("__s", F.explode(F.array_compact(F.array(*steps))))
        .select(*enrolments.columns, "__s.transition", "__s.persist")
    )


def spine_by_window(enrolments: DataFrame, label: LabelSpec, windows, part: str | Sequence[str] = "train", keep: Sequence[str] = ()) -> DataFrame:
    """Spine rows of every rolling window in one scan, with a ``window_id``.

    The windows are a short configuration list; each row is expanded to the
    windows that contain its start date, so there is no range join.  With several
    parts the rows carry their ``part`` too, from the same scan.
    """
    parts = [part] if isinstance(part, str) else list(part)
    hits = []
    for p in parts:
        for w in windows:
            lo, hi = label.bounds(*((w.start, w.split) if p == "train" else (w.split, w.end)))
            hits.append(F.when(half_open("start_date", lo, hi), F.struct(F.lit(w.window_id).alias("window_id"), F.lit(p).alias("part"))))
    known = mandatory(enrolments, ["start_date", "status"])
    return (
        labelled(known, [label.n])
        .filter(F.col(label.column).isNotNull())
        .withColumn("__at", F.explode(F.array_compact(F.array(*hits))))
        .select("__at.window_id", *([] if isinstance(part, str) else ["__at.part"]), "enrollid", "studentid", "collegeid", *keep, label.column)
    )
