"""The feature catalogue for all rolling windows and both parts in one job.

Features depend on a window only through its split date.  Facts with a date are
tagged with the windows whose split they precede and aggregated by (key, window):
one shuffle, in which the map side already combines the tags, and a row only for
windows that hold a fact of the key.  Everything that comes from one fact table is
one aggregation, so contacts, courses, attendance and test scores are each read
once, however many features and windows are asked for.  Train and test rows of a
window see the same features (no fact on or after the split) and share them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import cleaning as X
from cohortspark.functions.calendar import Window
from cohortspark.operators import features as FT
from cohortspark.operators import matrix as M
from cohortspark.operators.features import CATALOGUE, Bounds, Options, Tables
from cohortspark.operators.labels import MATRICULATING, NEVER_STARTED, spine_by_window
from cohortspark.operators.ranks import percent_rank_by

ID, PART = "window_id", "part"

#: Families by the fact table that answers them together.
FUSED = {
    "advanced_courses": "courses", "course_ranks": "courses",
    "contact_counts": "contacts", "last_contact": "contacts", "contact_shares": "contacts",
    "attendance_totals": "attendance", "attendance_averages": "attendance", "attendance_yearly": "attendance",
    "best_act": "acttests", "college_alumni": "alumni",
}


def tagged(facts: DataFrame, date_col: str, windows: Sequence[Window]) -> DataFrame:
    """Each fact once per window whose split it precedes, with that ``window_id``; facts without a date are in none."""
    hits = [F.when(X.half_open(date_col, None, w.split), F.lit(w.window_id)) for w in windows]
    return facts.withColumn(ID, F.explode(F.array_compact(F.array(*hits))))


def courses(t: Tables, windows: Sequence[Window], wanted: Sequence[str], o: Options) -> DataFrame:
    """F54-F68 by (studentid, window)."""
    ranks, rest = FT.rank_columns(), FT.advanced_columns()
    rows = FT._courses(t, ["was_ap", "was_honors", "course_number", "percent_grade", "semester_taken"])
    if not any(c in ranks for c in wanted):
        rows = tagged(rows, "grade_available", windows)
    elif o.rank_point_in_time:  # ranks among what each window knows
        rows = tagged(rows, "grade_available", windows)
        rows = percent_rank_by(rows, [ID, "course_number"], "percent_grade", "__rank", F.expr(o.rank_slices) if o.rank_slices else None)
    else:
        rows = percent_rank_by(rows, ["course_number"], "percent_grade", "__rank", F.expr(o.rank_slices) if o.rank_slices else None)
        rows = tagged(rows, "grade_available", windows)
    cols = rest | ranks
    return rows.filter(F.col("__gap").isin(0, 1, 2)).groupBy("studentid", ID).agg(*[cols[c].alias(c) for c in wanted])


def contacts(t: Tables, windows: Sequence[Window], wanted: Sequence[str], o: Options) -> DataFrame:
    """F70-F75 by (studentid, window)."""
    cols = FT.contact_columns(o)
    return tagged(t["contacts"], "contact_date", windows).groupBy("studentid", ID).agg(*[cols[c].alias(c) for c in wanted])


def acttests(t: Tables, windows: Sequence[Window], wanted: Sequence[str], o: Options) -> DataFrame:
    """F69 by (studentid, window)."""
    rows = tagged(t["acttests"].filter(F.col("test_level") == "ACT"), "date", windows)
    return rows.groupBy("studentid", ID).agg(F.max("score_composite").alias("max_composite_act_score"))


def alumni(t: Tables, windows: Sequence[Window], wanted: Sequence[str], o: Options) -> DataFrame:
    """F18 by (collegeid, window)."""
    rows = tagged(t["enrollments"].filter(~F.col("status").isin(MATRICULATING, NEVER_STARTED)), "start_date", windows)
    return rows.groupBy("collegeid", ID).agg(F.count(F.lit(1)).alias("alum_count"))


def attendance(t: Tables, windows: Sequence[Window], wanted: Sequence[str], o: Options) -> DataFrame:
    """F80-F93 by (studentid, window).

    Two levels: one count per (student, year, type) and window, and one without a
    date bound, which most of the averages use; then per student and window.
    """
    rows = FT._attendance(t, range(7)).filter(F.col("attendance_type").isin(*FT.ATTENDANCE_TYPES))
    inside = {w.window_id: F.count_if(X.half_open("attendance_date", None, w.split)).alias(f"__w{w.window_id}") for w in windows}
    cells = rows.groupBy("studentid", "__gap", "attendance_type").agg(F.count(F.lit(1)).alias("__all"), *inside.values())
    cells = cells.withColumn(
        "__at", F.explode(F.array(*[F.struct(F.lit(w.window_id).alias(ID), F.col(f"__w{w.window_id}").alias("__n")) for w in windows]))
    ).select("studentid", "__gap", "attendance_type", "__all", f"__at.{ID}", "__at.__n")
    upper = F.col("__gap").isin(*FT.UPPER_SCHOOL_YEARS)
    held = F.sum(F.when(upper, F.col("__n"))) > 0

    def column(name: str) -> Column:
        if name.startswith("HSTotal_"):
            hit = upper & (F.col("attendance_type") == name.removeprefix("HSTotal_"))
            return F.when(held, F.coalesce(F.sum(F.when(hit, F.col("__n"))), F.lit(0)))
        bounded = o.bound_attendance_averages or name == "YearlyAvgAttendance"
        count = F.nullif("__n", F.lit(0)) if bounded else F.col("__all")
        return F.avg(F.when(FT.yearly_average(*FT._AVERAGES[name]), count))

    return cells.groupBy("studentid", ID).agg(*[column(c).alias(c) for c in wanted])


BUILD: Mapping[str, Callable[..., DataFrame]] = {f.__name__: f for f in (courses, contacts, acttests, alumni, attendance)}


def assemble_windows(tables: Tables, spec: M.MatrixSpec, windows: Sequence[Window], parts: Sequence[str] = ("train", "test")) -> DataFrame:
    """M01-M04 for every window: window_id, part, ids, target and the feature columns in the order asked for.

    Target, features, restrictions and options are those of ``spec``; its dates are
    replaced by the windows'.  Rows of a window and part equal those of
    ``matrix.assemble`` with the window's dates.
    """
    if len({w.window_id for w in windows}) < len(windows):
        raise ValueError("windows need different ids")
    rows = M.restricted(tables["enrollments"], tables, spec.restrictions, spec.options)
    carried = [c for c in rows.columns if c not in M.IDS]
    spine = spine_by_window(rows, spec.target, windows, list(parts), keep=carried)
    families = M._by_family(spec.features)
    split = F.element_at(F.create_map(*[F.lit(x) for w in windows for x in (w.window_id, w.split)]), F.col(ID)) if windows else F.lit(None).cast("date")
    known = F.col("start_date") < split
    late = {c: F.when(known, F.col(c)) for c in ("degree_subject", "major") if c in families.get("enrolment_attributes", ())}
    fused: dict[str, list[str]] = {}
    unbounded = []
    for family, wanted in families.items():
        if family in FUSED:
            fused.setdefault(FUSED[family], []).extend(c for c in wanted if c not in fused.get(FUSED[family], []))
        else:
            unbounded.append(family)
    names = [f for f in spec.features if CATALOGUE[f].family in unbounded]
    # families without a date bound are those of any single window
    joined = M.add_features(spine, tables, names, Bounds(), spec.options)
    for source in sorted(fused, key=lambda s: s == "alumni"):  # joins by student first, then by college
        made = BUILD[source](tables, windows, fused[source], spec.options)
        joined = joined.join(made, ["collegeid" if source == "alumni" else "studentid", ID], "left")
    joined = joined.withColumns(late) if late else joined
    return joined.select(ID, PART, *M.IDS, spec.target.column, *[f"`{c}`" for c in M.feature_columns(spec.features)])


def window_of(spec: M.MatrixSpec, window_id: int) -> Window:
    return Window(window_id, spec.train_start, spec.split, spec.test_end)


def part_of(matrix: DataFrame, window_id: int, part: str) -> DataFrame:
    return matrix.filter((F.col(ID) == window_id) & (F.col(PART) == part)).drop(ID, PART)
