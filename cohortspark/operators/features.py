"""The feature catalogue (F01-F93) as fused families.

A *family* is one scan and at most a few aggregations that yield every column
wanted from the same facts; a *feature* names one column of a family.  The
matrix therefore joins about a dozen families instead of ninety features.

``tables`` is any mapping with the integrated tables: students, enrollments,
colleges, schools, courses, hs_enrollment, gpa_by_year, gpa_cumulative,
acttests, contacts, attendance.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import cleaning as X
from cohortspark.operators import aggregates as A
from cohortspark.operators.labels import LabelSpec, NEVER_STARTED, MATRICULATING, label_name, labelled
from cohortspark.operators.ranks import percent_rank_by

Tables = Mapping[str, DataFrame]

# fixed values
ATTENDANCE_TYPES = ("tardy", "unexcused", "suspended", "excused", "early_dismissal")
AWAY_TYPES = ("tardy", "unexcused", "early_dismissal")
CONTACT_MEDIA = (
    "Call", "Email", "In Person", "Text", "Social Networking", "School Visit",
    "Mail", "IM", "Parent Contact", "College Contact",
)
UPPER_SCHOOL_YEARS = (0, 1, 2, 3)
MIDDLE_SCHOOL_YEARS = (4, 5, 6)
SUMMER_TERM = 3
KINDS = ("boolean", "numerical", "categorical", "date")


@dataclass(frozen=True)
class Bounds:
    """Half-open date bound applied to the facts behind a feature."""

    lower: date | None = None
    upper: date | None = None


@dataclass(frozen=True)
class Options:
    """Choices a user can make; the defaults keep the established behaviour."""

    rank_point_in_time: bool = False       # bound facts before ranking, not after
    bound_attendance_averages: bool = False
    latest_nulls: str = "first"
    networks: Mapping[str, str] = field(default_factory=lambda: {"is_partner_a": "A", "is_partner_b": "B"})
    contact_media: Sequence[str] = CONTACT_MEDIA
    # None: courses are ranked over range partitions of (course, grade), at the price of
    # a job of their own.  A monotone expression of the grade cuts each course at its
    # values instead and stays lazy.  The ranks are the same.
    rank_slices: str | None = "floor(percent_grade)"


Build = Callable[[Tables, Bounds, Sequence[str], Options], DataFrame]


@dataclass(frozen=True)
class Feature:
    """One named feature: where it comes from and how it is postprocessed."""

    name: str
    columns: tuple[str, ...]
    key: str
    kind: str
    family: str
    bounded: bool = False
    post: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"feature kind must be one of {KINDS}")
        if self.kind == "categorical" and self.post != "one_hot":
            raise ValueError("categorical features must be one-hot encoded")
        if self.key not in ("enrollid", "studentid", "collegeid"):
            raise ValueError("features are keyed by enrollid, studentid or collegeid")


# --- families -----------------------------------------------------------------

def student_attributes(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F03, F04, F14-F16."""
    return t["students"].select("studentid", *wanted)


def school_class(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F01.  One row per school enrolment: several rows per student multiply the spine."""
    return t["hs_enrollment"].select("studentid", "high_school_class")


def final_gpa(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F05."""
    return t["gpa_cumulative"].select("studentid", *wanted)


def gpa_years(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """All yearly averages from one aggregate."""
    classes = t["hs_enrollment"].select("studentid", "high_school_class")
    rows = t["gpa_by_year"].select("studentid", "school_year", "unweighted_gpa").join(classes, "studentid", "left")
    gap, gpa = X.years_before("high_school_class", "school_year"), F.col("unweighted_gpa")
    cols = {f"year{12 - k}_unweightedgpa": A.only_if_count(gpa, gap == k, 1) for k in range(4)}
    cols["avg_y11_y12_unweightedgpa"] = A.only_if_count(gpa, gap <= 1, 2)
    cols["avg_y9_y10_unweightedgpa"] = A.only_if_count(gpa, (gap > 1) & (gap < 4), 2)
    cols["unweighted_gpa_diff"] = cols["avg_y11_y12_unweightedgpa"] - cols["avg_y9_y10_unweightedgpa"]
    return rows.groupBy("studentid").agg(*[cols[c].alias(c) for c in wanted])


def recent_school(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """school of the enrolment that ended last; equal dates go to the larger school id."""
    last = A.latest_by_key(t["hs_enrollment"], ["studentid"], "end_date", ["schoolid"], ["schoolid"], o.latest_nulls)
    return last.join(t["schools"].select("schoolid", "name"), "schoolid", "left").select("studentid", "name")


def college_attributes(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F17, F19-F41."""
    renamed = t["colleges"].withColumnRenamed("name", "college_name")
    return renamed.select("collegeid", *wanted)


def college_alumni(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """enrolments that really started, per college."""
    started = ~F.col("status").isin(MATRICULATING, NEVER_STARTED)
    rows = t["enrollments"].filter(started & X.half_open("start_date", b.lower, b.upper))
    return rows.groupBy("collegeid").agg(F.count(F.lit(1)).alias("alum_count"))


def enrolment_columns(b: Bounds, wanted: Sequence[str]) -> dict[str, Column]:
    """Expressions over one enrolment row for F50, F51, F76-F78.

    Subject and major are unknown for rows outside the bound.
    """
    inside = X.half_open("start_date", b.lower, b.upper)
    cols = {
        "start_date": lambda: F.col("start_date"),
        "is_spring": lambda: X.winter_start("start_date"),
        "degree_type": lambda: F.col("degree_type"),
        "degree_subject": lambda: F.when(inside, F.col("degree_subject")),
        "major": lambda: F.when(inside, F.col("major")),
    }
    return {c: cols[c]() for c in wanted}


def enrolment_attributes(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F50, F51, F76-F78."""
    return t["enrollments"].select("enrollid", *[c.alias(n) for n, c in enrolment_columns(b, wanted).items()])


def age_column() -> Column:
    return X.completed_years("start_date", "date_of_birth")


def enrolment_age(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F02."""
    born = t["students"].select("studentid", "date_of_birth")
    return t["enrollments"].join(born, "studentid", "left").select("enrollid", age_column().alias("age_at_enrollment"))


def network_columns(wanted: Sequence[str], o: Options) -> dict[str, Column]:
    return {c: X.member("network", [o.networks[c]]) for c in wanted}


def enrolment_network(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F52, F53."""
    nets = t["students"].select("studentid", "network")
    joined = t["enrollments"].join(nets, "studentid", "left")
    return joined.select("enrollid", *[c.alias(n) for n, c in network_columns(wanted, o).items()])


def first_starts(t: Tables) -> DataFrame:
    """Earliest start of an enrolment that really started, per student."""
    started = F.when(F.col("status") != NEVER_STARTED, F.col("start_date"))
    return t["enrollments"].groupBy("studentid").agg(F.min(started).alias("__first"))


def first_column() -> Column:
    return X.not_before("__first", "start_date")


def first_enrolment(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """no earlier enrolment that really started.

    The group minimum is aggregated and joined back (J12), not windowed, so a
    student with very many rows does not end up in one task.
    """
    rows = t["enrollments"].select("enrollid", "studentid", "start_date").join(first_starts(t), "studentid", "left")
    return rows.select("enrollid", first_column().alias("is_first_enrollment"))


def _courses(t: Tables, columns: Sequence[str]) -> DataFrame:
    classes = t["hs_enrollment"].select("studentid", "high_school_class")
    rows = t["courses"].select("studentid", "year_taken", "grade_available", *columns).join(classes, "studentid", "left")
    return rows.withColumn("__gap", X.years_before("high_school_class", "year_taken"))


def advanced_columns() -> dict[str, Column]:
    """F54-F59 over course rows with ``__gap``: six conditional sums."""
    cols = {}
    for k in range(3):
        cols[f"numberapsyear{12 - k}"] = A.sum_flag(F.col("was_ap"), F.col("__gap") == k)
        cols[f"numberhonsyear{12 - k}"] = A.sum_flag(F.col("was_honors"), F.col("__gap") == k)
    return cols


def advanced_courses(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """One scan."""
    rows = _courses(t, ["was_ap", "was_honors"]).filter(X.half_open("grade_available", b.lower, b.upper) & F.col("__gap").isin(0, 1, 2))
    cols = advanced_columns()
    return rows.groupBy("studentid").agg(*[cols[c].alias(c) for c in wanted])


def rank_columns() -> dict[str, Column]:
    """F60-F68 over course rows with ``__gap`` and ``__rank``: nine conditional aggregates."""
    cols = {}
    for k in range(3):
        rank = F.when((F.col("__gap") == k) & (F.col("semester_taken") != SUMMER_TERM), F.col("__rank"))
        for name, fn in (("max", F.max), ("min", F.min), ("avg", F.avg)):
            cols[f"{name}rankyear{12 - k}"] = fn(rank)
    return cols


def course_ranks(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """One percent rank per course, nine conditional aggregates on top.

    By default the rank compares all grades of a course and the date bound only
    selects which ranks are aggregated.
    """
    inside = X.half_open("grade_available", b.lower, b.upper)
    rows = _courses(t, ["course_number", "percent_grade", "semester_taken"])
    if o.rank_point_in_time:
        rows = rows.filter(inside)
    slices = F.expr(o.rank_slices) if o.rank_slices else None
    ranked = percent_rank_by(rows, ["course_number"], "percent_grade", "__rank", slices)
    rows = ranked.filter(inside & F.col("__gap").isin(0, 1, 2) & (F.col("semester_taken") != SUMMER_TERM))
    cols = rank_columns()
    return rows.groupBy("studentid").agg(*[cols[c].alias(c) for c in wanted])


def best_act(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F69."""
    rows = t["acttests"].filter((F.col("test_level") == "ACT") & X.half_open("date", b.lower, b.upper))
    return rows.groupBy("studentid").agg(F.max("score_composite").alias("max_composite_act_score"))


def contact_columns(o: Options) -> dict[str, Column]:
    """F70-F75 over contact rows: counts, the struct of the last successful one, percent per medium of those with one."""
    known = F.count("contact_medium")
    share = lambda m: F.when(known > 0, F.lit(100.0) * F.count(F.when(F.col("contact_medium") == m, 1)) / F.when(known > 0, known))
    last = A.latest_values("contact_date", ["contact_medium"], ["contact_medium"], o.latest_nulls)
    return {
        "num_contacts": F.count(F.lit(1)),
        "student_initiated_contacts": A.count_where(F.col("initiated_by_student")),
        "total_unsuccessful_contacts": A.count_where(~F.col("was_successful")),
        "number_counselors": F.count_distinct("counselor_id"),
        "last_contact_medium": F.max(F.when(F.col("was_successful"), last))["v"]["contact_medium"],
        **{m: share(m) for m in o.contact_media},
    }


def contact_counts(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """One scan, one distinct count."""
    rows = t["contacts"].filter(X.half_open("contact_date", b.lower, b.upper))
    cols = contact_columns(o)
    return rows.groupBy("studentid").agg(*[cols[c].alias(c) for c in wanted])


def last_contact(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """medium of the last successful contact; equal dates go to the larger medium name."""
    rows = t["contacts"].filter(X.half_open("contact_date", b.lower, b.upper) & F.col("was_successful"))
    last = A.latest_by_key(rows, ["studentid"], "contact_date", ["contact_medium"], ["contact_medium"], o.latest_nulls)
    return last.withColumnRenamed("contact_medium", "last_contact_medium")


def contact_shares(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """percent of contacts per medium."""
    rows = t["contacts"].filter(X.half_open("contact_date", b.lower, b.upper))
    return A.pivot_shares(rows, "studentid", "contact_medium", o.contact_media).select("studentid", *wanted)


def _attendance(t: Tables, years: Sequence[int]) -> DataFrame:
    classes = t["hs_enrollment"].select("studentid", "high_school_class")
    rows = t["attendance"].join(classes, "studentid", "left")
    return rows.withColumn("__gap", X.years_before("high_school_class", "school_year")).filter(F.col("__gap").isin(*years))


def attendance_totals(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F81."""
    rows = _attendance(t, UPPER_SCHOOL_YEARS).filter(X.half_open("attendance_date", b.lower, b.upper))
    return A.pivot_counts(rows, "studentid", "attendance_type", ATTENDANCE_TYPES, "HSTotal_").select("studentid", *wanted)


def yearly_average(types: Sequence[str], years: Sequence[int]):
    """predicate over (gap, type) cells for :func:`attendance_averages`."""
    unknown = set(types) - set(ATTENDANCE_TYPES) or set(years) - set(range(7))
    if unknown:
        raise ValueError(f"not an attendance type or relative year: {sorted(unknown)}")
    return F.col("attendance_type").isin(*types) & F.col("__gap").isin(*years)


_AVERAGES = {
    **{
        f"Avg{prefix}{name}": (types, years)
        for prefix, years in (("HS", UPPER_SCHOOL_YEARS), ("MS", MIDDLE_SCHOOL_YEARS))
        for name, types in (
            ("Tardy", ("tardy",)),
            ("Suspended", ("suspended",)),
            ("Excused", ("excused",)),
            ("Unexcused", ("unexcused",)),
            ("EarlyDismissal", ("early_dismissal",)),
            ("Away", AWAY_TYPES),
        )
    },
    "YearlyAvgAttendance": (ATTENDANCE_TYPES, UPPER_SCHOOL_YEARS),
}


def attendance_averages(t: Tables, b: Bounds, wanted: Sequence[str], o: Options, custom: Mapping | None = None) -> DataFrame:
    """Thirteen nested averages over one two-stage aggregation.

    The twelve named averages ignore the date bound unless
    ``bound_attendance_averages`` is set; the generic one is bounded.
    """
    specs = {**_AVERAGES, **(custom or {})}
    rows = _attendance(t, range(7)).filter(F.col("attendance_type").isin(*ATTENDANCE_TYPES))
    if o.bound_attendance_averages or list(wanted) == ["YearlyAvgAttendance"]:
        rows = rows.filter(X.half_open("attendance_date", b.lower, b.upper))
    return A.nested_average(
        rows, "studentid", ["__gap", "attendance_type"], {c: yearly_average(*specs[c]) for c in wanted}
    )


def survival(t: Tables, b: Bounds, wanted: Sequence[str], o: Options) -> DataFrame:
    """F42-F49 used as restrictors: unbounded labels by enrolment."""
    numbers = [n for n in range(1, 9) if label_name(n) in wanted]
    return labelled(t["enrollments"], numbers).select("enrollid", *wanted)


FAMILIES: dict[str, Build] = {
    f.__name__: f
    for f in (
        student_attributes, school_class, final_gpa, gpa_years, recent_school, college_attributes,
        college_alumni, enrolment_attributes, enrolment_age, enrolment_network, first_enrolment,
        advanced_courses, course_ranks, best_act, contact_counts, last_contact, contact_shares,
        attendance_totals, attendance_averages, survival,
    )
}
FAMILIES["attendance_yearly"] = attendance_averages


# --- catalogue ------------------------------------------------------------------

def _catalogue() -> dict[str, Feature]:
    out: list[Feature] = []

    def add(name, column, key, kind, family, bounded=False, post=None):
        columns = (column,) if isinstance(column, str) else tuple(column)
        out.append(Feature(name, columns, key, kind, family, bounded, post))

    add("HSClass", "high_school_class", "studentid", "numerical", "school_class")
    add("StudentAgeAtEnrollment", "age_at_enrollment", "enrollid", "numerical", "enrolment_age")
    add("StudentGender", "is_female", "studentid", "boolean", "student_attributes")
    add("StudentEthnicity", "ethnicity", "studentid", "categorical", "student_attributes", post="one_hot")
    add("finalUnweightedGPA", "cumulative_unweighted_gpa", "studentid", "numerical", "final_gpa", post="null_dummy")
    for year in (12, 11, 10, 9):
        add(f"year{year}GPA", f"year{year}_unweightedgpa", "studentid", "numerical", "gpa_years")
    add("avgYear11_12UnweightedGPA", "avg_y11_y12_unweightedgpa", "studentid", "numerical", "gpa_years")
    add("avgYear9_10UnweightedGPA", "avg_y9_y10_unweightedgpa", "studentid", "numerical", "gpa_years")
    add("ChangeInUnweightedGPA", "unweighted_gpa_diff", "studentid", "numerical", "gpa_years")
    add("HighSchoolMostRecentlyAttended", "name", "studentid", "categorical", "recent_school", post="one_hot")
    for name, column in (("everSpecialEd", "ever_special_ed"), ("everFreeLunch", "ever_free_lunch"), ("isFirstGen", "is_first_gen")):
        add(name, column, "studentid", "boolean", "student_attributes", post="null_dummy")

    add("CollegeName", "college_name", "collegeid", "categorical", "college_attributes", post="one_hot")
    add("AlumsEverAttendedSpecificCollege", "alum_count", "collegeid", "numerical", "college_alumni", True, "fill_zero")
    for name, column, kind in (
        ("isPrivate", "isprivate", "boolean"),
        ("isForProfit", "isforprofit", "boolean"),
        ("is4year", "is4year", "boolean"),
        ("sixYearGraduationRate", "graduationrate_6yr", "numerical"),
        ("sixYearMinorityGraduationRate", "graduationrate_minority_6yr", "numerical"),
        ("sixYearTransferRate", "transferrate_6yr", "numerical"),
        ("sixYearMinorityTransferRate", "transferrate_minority_6yr", "numerical"),
        ("historicallyBlackCollege", "historicallyblack", "boolean"),
        ("barronsSelectivity", "barrons_rating", "categorical"),
        ("distanceFromChicago", "dist_from_chicago", "numerical"),
        ("percentAccepted", "perc_accepted", "numerical"),
        ("percentEnroll", "perc_accepted_enroll", "numerical"),
        ("percentFemale", "perc_female", "numerical"),
        ("percentAfricanAmerican", "perc_african_american", "numerical"),
        ("percentHispanic", "perc_hispanic", "numerical"),
        ("percentInState", "percentinstate", "numerical"),
        ("percentPellGrant", "percentpellgrant", "numerical"),
        ("avgNetPrice", "avgnetprice", "numerical"),
        ("netPrice0_30", "netprice0_30", "numerical"),
        ("netPrice30_48", "netprice30_48", "numerical"),
        ("netPrice48_75", "netprice48_75", "numerical"),
        ("locale", "locale", "categorical"),
        ("sizeRange", "size_range", "categorical"),
    ):
        add(name, column, "collegeid", kind, "college_attributes", post="one_hot" if kind == "categorical" else "null_dummy")

    for n, word in enumerate(("One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight"), start=1):
        add(f"Persist{word}Semester{'' if n == 1 else 's'}", label_name(n), "enrollid", "boolean", "survival")

    add("EnrollmentStartDate", "start_date", "enrollid", "date", "enrolment_attributes")
    add("SpringEnrollment", "is_spring", "enrollid", "boolean", "enrolment_attributes")
    add("NetworkPartnerA", "is_partner_a", "enrollid", "boolean", "enrolment_network")
    add("NetworkPartnerB", "is_partner_b", "enrollid", "boolean", "enrolment_network")

    for year in (12, 11, 10):
        add(f"numberAPsYear{year}", f"numberapsyear{year}", "studentid", "numerical", "advanced_courses", True)
    for year in (12, 11, 10):
        add(f"numberHonsYear{year}", f"numberhonsyear{year}", "studentid", "numerical", "advanced_courses", True)
    for stat in ("max", "min", "avg"):
        for year in (12, 11, 10):
            add(f"{stat}RankYear{year}", f"{stat}rankyear{year}", "studentid", "numerical", "course_ranks", True)

    add("highestCompositeACT", "max_composite_act_score", "studentid", "numerical", "best_act", True, "null_dummy")
    add("totalNumberofContacts", "num_contacts", "studentid", "numerical", "contact_counts", True, "fill_zero")
    add("numberContactsInitiatedByStudent", "student_initiated_contacts", "studentid", "numerical", "contact_counts", True, "fill_zero")
    add("numberUnsuccessfulContacts", "total_unsuccessful_contacts", "studentid", "numerical", "contact_counts", True, "fill_zero")
    add("mediumOfLastSuccessfulContact", "last_contact_medium", "studentid", "categorical", "last_contact", True, "one_hot")
    add("numberOfCounselors", "number_counselors", "studentid", "numerical", "contact_counts", True)
    add("ContactMediumPercentages", CONTACT_MEDIA, "studentid", "numerical", "contact_shares", True, "fill_zero")

    add("degreeSubject", "degree_subject", "enrollid", "categorical", "enrolment_attributes", True, "one_hot")
    add("Major", "major", "enrollid", "categorical", "enrolment_attributes", True, "one_hot")
    add("DegreeType", "degree_type", "enrollid", "categorical", "enrolment_attributes", False, "one_hot")
    add("IsFirstEnrollment", "is_first_enrollment", "enrollid", "boolean", "first_enrolment")

    add("YearlyAvgAttendance", "YearlyAvgAttendance", "studentid", "numerical", "attendance_yearly", True, "fill_zero")
    add("TotalAttendance", tuple(f"HSTotal_{t}" for t in ATTENDANCE_TYPES), "studentid", "numerical", "attendance_totals", True, "fill_zero")
    for column in _AVERAGES:
        if column != "YearlyAvgAttendance":
            add(column, column, "studentid", "numerical", "attendance_averages", False, "fill_zero")
    return {f.name: f for f in out}


CATALOGUE: dict[str, Feature] = _catalogue()


def target(name: str) -> LabelSpec:
    """The label spec behind a Persist... feature name."""
    column = CATALOGUE[name].columns[0]
    return LabelSpec(int(column.split("_")[1]))


def windowed_aggregates(facts: DataFrame, key: str, date_col: str, windows, measures: Mapping[str, Callable], id_name: str = "window_id") -> DataFrame:
    """Point-in-time aggregates for many windows from one scan and one shuffle.

    ``measures`` maps an output name to ``fn(inside) -> aggregate Column`` where
    ``inside`` is the predicate "before the split of this window".  The windows
    are a short configuration list, so each becomes one conditional aggregate
    per measure and the result is turned into rows afterwards.  A key without a
    fact before the split has no row for that window.
    """
    aggs, packed = [], []
    for w in windows:
        inside = X.half_open(date_col, None, w.split)
        aggs.append(F.count_if(inside).alias(f"__rows_{w.window_id}"))
        fields = [F.lit(w.window_id).alias(id_name), F.col(f"__rows_{w.window_id}").alias("__rows")]
        for name, fn in measures.items():
            column = f"__{name}_{w.window_id}"
            aggs.append(fn(inside).alias(column))
            fields.append(F.col(column).alias(name))
        packed.append(F.struct(*fields))
    wide = facts.groupBy(key).agg(*aggs)
    cells = wide.select(key, F.explode(F.array(*packed)).alias("__w")).select(key, "__w.*")
    return cells.filter("__rows > 0").drop("__rows")
