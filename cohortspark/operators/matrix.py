"""Point-in-time training matrices."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import features as FT
from cohortspark.operators.features import CATALOGUE, FAMILIES, Bounds, Options, Tables
from cohortspark.operators.joins import left_joins
from cohortspark.operators.labels import HALF_YEARS, LabelSpec, label_name, labelled
from cohortspark.operators.post import PostPlan, learn
from cohortspark.session import stored

IDS = ("enrollid", "studentid", "collegeid")


@dataclass(frozen=True)
class Restriction:
    """A predicate on an enrolment-level feature; default "is true"."""

    feature: str
    predicate: Column | None = None
    text: str = "= true"

    def condition(self) -> Column:
        column = F.col(CATALOGUE[self.feature].columns[0])
        return self.predicate if self.predicate is not None else column == F.lit(True)


@dataclass(frozen=True)
class MatrixSpec:
    """Target, features, sample restrictions and the three dates of one experiment."""

    target: LabelSpec
    features: Sequence[str]
    train_start: date
    split: date
    test_end: date | None = None
    restrictions: Sequence[Restriction] = ()
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        if self.train_start is None or self.split is None:
            raise ValueError("a matrix needs a train_start and a split date")
        for r in self.restrictions:
            if CATALOGUE[r.feature].key != "enrollid":
                raise ValueError("restrictions apply to enrolment-level features")

    def target_bounds(self, part: str) -> tuple[date | None, date | None]:
        """Train ``[train_start, split)``, test ``[split, test_end)``."""
        if part == "train":
            return self.train_start, self.split
        if part == "test":
            return self.split, self.test_end
        raise ValueError("part must be 'train' or 'test'")


def feature_columns(names: Sequence[str]) -> list[str]:
    return [c for n in names for c in CATALOGUE[n].columns]


def postprocess_steps(names: Sequence[str]) -> dict[str, str]:
    """Output column -> step, in feature order."""
    return {c: CATALOGUE[n].post for n in names for c in CATALOGUE[n].columns if CATALOGUE[n].post}


#: Families that are expressions over the enrolment row itself: no join at all.
ROW_LOCAL = ("enrolment_attributes", "survival")
#: Families that only need the student's own row next to the enrolment row.
STUDENT_LOCAL = ("student_attributes", "enrolment_age", "enrolment_network")


def _by_family(names: Sequence[str]) -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = defaultdict(list)
    for name in dict.fromkeys(names):
        feature = CATALOGUE[name]
        grouped[feature.family] += [c for c in feature.columns if c not in grouped[feature.family]]
    return grouped


def _add_row_local(rows: DataFrame, family: str, wanted: Sequence[str], bounds: Bounds) -> DataFrame:
    if family == "survival":
        return labelled(rows, [n for n in HALF_YEARS if label_name(n) in wanted])
    fresh = {c: e for c, e in FT.enrolment_columns(bounds, wanted).items() if c not in rows.columns or c in ("degree_subject", "major")}
    return rows.withColumns(fresh) if fresh else rows


def restricted(rows: DataFrame, tables: Tables, restrictions: Sequence[Restriction], options: Options) -> DataFrame:
    """Keep enrolment rows whose unbounded restrictors hold.

    ``rows`` comes from the enrolments table, whose id is its primary key, so a
    restrictor computed from the same row is a plain filter; any other
    restrictor is a semi join on the enrolment id.
    """
    columns = rows.columns
    for family, wanted in _by_family([r.feature for r in restrictions]).items():
        conditions = [r.condition() for r in restrictions if CATALOGUE[r.feature].family == family]
        local = family in ROW_LOCAL
        source = _add_row_local(rows, family, wanted, Bounds()) if local else FAMILIES[family](tables, Bounds(), wanted, options)
        for condition in conditions:
            source = source.filter(condition)
        rows = source.select(*columns) if local else rows.join(source.select("enrollid"), "enrollid", "left_semi")
    return rows


def add_features(spine: DataFrame, tables: Tables, names: Sequence[str], bounds: Bounds, options: Options) -> DataFrame:
    """Attach every wanted feature column, one join per family.

    ``spine`` still carries the enrolment columns.  Enrolment-level features are
    expressions over that row, after the student's row or first start date is
    joined where needed, so nothing is ever joined on the enrolment id; what
    remains are joins by student, then by college, which share a partitioning.
    Bounded facts lie before the split in train and test alike (M02).
    """
    families = _by_family(names)
    student, college = [], []
    for family, wanted in families.items():
        if family in ROW_LOCAL:
            spine = _add_row_local(spine, family, wanted, bounds)
    if any(f in families for f in STUDENT_LOCAL):
        needed = list(families.get("student_attributes", ()))
        needed += ["date_of_birth"] if "enrolment_age" in families else []
        needed += ["network"] if "enrolment_network" in families else []
        student.append(tables["students"].select("studentid", *needed))
    if "first_enrolment" in families:
        student.append(FT.first_starts(tables))
    for family, wanted in families.items():
        if family not in ROW_LOCAL + STUDENT_LOCAL + ("first_enrolment",):
            key = next(f.key for f in CATALOGUE.values() if f.family == family)
            (student if key == "studentid" else college).append(FAMILIES[family](tables, bounds, wanted, options))
    joined = left_joins(spine, [("studentid", f) for f in student] + [("collegeid", f) for f in college])
    extra = {}
    if "enrolment_age" in families:
        extra["age_at_enrollment"] = FT.age_column()
    if "enrolment_network" in families:
        extra |= FT.network_columns(families["enrolment_network"], options)
    if "first_enrolment" in families:
        extra["is_first_enrollment"] = FT.first_column()
    return joined.withColumns(extra) if extra else joined


def assemble(tables: Tables, spec: MatrixSpec, part: str = "train") -> DataFrame:
    """Label spine, restrictions, then one left join per feature family.

    Keys and target come first, feature columns follow in the order asked for.
    """
    lower, upper = spec.target_bounds(part)
    rows = restricted(tables["enrollments"], tables, spec.restrictions, spec.options)
    carried = [c for c in rows.columns if c not in IDS]
    spine = spec.target.spine(rows, lower, upper, keep=carried)
    joined = add_features(spine, tables, spec.features, Bounds(None, spec.split), spec.options)
    return joined.select(*IDS, spec.target.column, *[f"`{c}`" for c in feature_columns(spec.features)])


def subset(matrix: DataFrame, spec: MatrixSpec, features: Sequence[str], row_key: str | None = None) -> DataFrame:
    """Chosen features plus the target; keys are never predictors.

    ``row_key`` names a column that carries the enrolment id, so that rows which
    are equal otherwise stay apart.
    """
    key = [] if row_key is None else [F.col("enrollid").alias(row_key)]
    return matrix.select(*[f"`{c}`" for c in feature_columns(features)], spec.target.column, *key)


def _written(train: DataFrame, test: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Both parts from one job, in which features they share are made once; parts of different columns from a job each."""
    kind = lambda df: [(f.name, f.dataType) for f in df.schema.fields]
    if test is None or kind(train) != kind(test):
        return stored(train, "train"), None if test is None else stored(test, "test")
    tagged = (df.withColumn("__test", F.lit(i)) for i, df in enumerate((train, test)))
    both = stored(DataFrame.union(*tagged), "parts")
    return tuple(both.filter(F.col("__test") == i).drop("__test") for i in (0, 1))


def postprocess(train: DataFrame, test: DataFrame | None, features: Sequence[str]) -> tuple[DataFrame, DataFrame | None, PostPlan]:
    """Encode both parts with what the training rows teach.

    Both parts are read several times, to learn and to apply, so they are written once to the shared folder.
    """
    train, test = _written(train, test)
    plan = learn(train, postprocess_steps(features), test)
    return plan.apply(train), None if test is None else plan.apply(test), plan


def analysis_frame(tables: Tables, spec: MatrixSpec, target_name: str = "persist") -> tuple[DataFrame, Mapping[str, list[str]]]:
    """Postprocessed training rows without keys, and feature column -> result columns."""
    matrix, _ = _written(assemble(tables, replace(spec, test_end=None), "train"), None)
    plan = learn(matrix, postprocess_steps(spec.features))
    frame = plan.apply(matrix).withColumnRenamed(spec.target.column, target_name)
    mapping = {c: plan.outputs(c) for c in feature_columns(spec.features)}
    return frame, mapping
