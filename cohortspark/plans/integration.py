"""Load manifests and integrated tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from cohortspark.contracts import CONTRACTS
from cohortspark.operators.joins import IdLookup, PartnerSource, assign_ids, integrate
from cohortspark.operators.labels import label_table
from cohortspark.plans import profile_a as PA
from cohortspark.plans import profile_b as PB
from cohortspark.sources.writers import create_namespaces, write_table

NAMESPACES = ("lookup", "partner_a", "partner_b", "common")


@dataclass(frozen=True)
class LoadJob:
    """One clean table: named raw inputs, the cleaner, the contract it must meet."""

    table: str
    inputs: Mapping[str, str]
    cleaner: Callable[..., DataFrame]
    uses: Sequence[str] = ()


#: Cleaner argument -> raw input name; ``uses`` are settings passed through.
MANIFEST_A = (
    LoadJob("studentid", {"contacts": "students"}, PA.studentid),
    LoadJob("collegeid", {"colleges": "college_database"}, PA.collegeid, ("blocked",)),
    LoadJob("students", {"students": "students"}, PA.students),
    LoadJob("acttests", {"tests": "tests"}, PA.acttests),
    LoadJob("aptests", {"tests": "ap_tests"}, PA.aptests, ("subjects",)),
    LoadJob("attendance", {"attendance": "attendance"}, PA.attendance),
    LoadJob("contacts", {"contacts": "contact_notes", "alumni": "alumni"}, PA.contacts, ("as_of", "placeholders", "shared_schools")),
    LoadJob("enrollments", {"enrollment": "enrolments"}, PA.enrollments, ("degrees", "majors", "as_of")),
    LoadJob("colleges", {"colleges": "college_database", "extra_college_features": "extra_college_features"}, PA.colleges, ("blocked",)),
    LoadJob("schools", {"accounts": "accounts", "alumni": "alumni", "founding_years": "founding_years"}, PA.schools),
    LoadJob("schoolid", {"accounts": "accounts", "alumni": "students", "powerschool_ids": "school_codes"}, PA.schoolid),
    LoadJob("gpa_by_year", {"courses": "courses"}, PA.gpa_by_year),
    LoadJob("gpa_cumulative", {"alumni": "alumni", "accounts": "accounts"}, PA.gpa_cumulative),
    LoadJob("courses", {"courses": "courses"}, PA.courses),
    LoadJob("hs_enrollment", {"contact": "students", "accounts": "accounts"}, PA.hs_enrollment),
)

#: S03.
MANIFEST_B = (
    LoadJob("studentid", {"students": "students"}, PB.studentid),
    LoadJob("schoolid", {"schools": "schools"}, PB.schoolid),
    LoadJob("students", {"students": "students"}, PB.students),
    LoadJob("schools", {"schools": "schools"}, PB.schools, ("own_organization",)),
    LoadJob("enrollments", {"enrollments": "enrolments"}, PB.enrollments, ("majors",)),
    LoadJob("contacts", {"contacts": "contacts"}, PB.contacts),
    LoadJob("acttests", {"tests": "tests"}, PB.acttests),
    LoadJob("courses", {"courses": "courses"}, PB.courses),
    LoadJob("attendance", {"attendance": "attendance"}, PB.attendance),
    LoadJob("gpa_by_year", {"gpa": "yearly_gpa"}, PB.gpa_by_year),
    LoadJob("gpa_cumulative", {"gpa": "yearly_gpa"}, PB.gpa_cumulative),
    LoadJob("hs_enrollment", {"enrollments": "enrolments"}, PB.hs_enrollment),
)


def run_manifest(manifest: Sequence[LoadJob], raw: Mapping[str, DataFrame], settings: Mapping | None = None, skip: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every clean table of a partner as a lazy frame under its contract.

    A job whose input is missing is an error unless ``skip`` names its table.
    """
    settings = settings or {}
    out = {}
    for job in manifest:
        if job.table in skip:
            continue
        missing = sorted(set(job.inputs.values()) - set(raw))
        if missing:
            raise ValueError(f"{job.table}: missing input {', '.join(missing)}; pass it or skip the table")
        args = {arg: raw[name] for arg, name in job.inputs.items()}
        args |= {name: settings[name] for name in job.uses if name in settings}
        out[job.table] = CONTRACTS[job.table].conform(job.cleaner(**args))
    return out


def missing_tables(manifest: Sequence[LoadJob], raw: Mapping[str, DataFrame]) -> list[str]:
    """The tables whose inputs are not all in ``raw``; for a caller that means to skip them."""
    return [job.table for job in manifest if not set(job.inputs.values()) <= set(raw)]


@dataclass(frozen=True)
class Side:
    """How one partner's rows of an integrated table find their ids."""

    lookups: Sequence[tuple[str, str, str, str]] = ()
    empty: Sequence[str] = ()


_A, _B = "a", "b"
# table -> partner -> (id table, partner column, id column, join)
RESOLUTION: dict[str, dict[str, Side]] = {
    "students": {_A: Side([("studentid", "a_sf_id", "a_sf_id", "left")]), _B: Side([("studentid", "b_sf_id", "b_sf_id", "left")])},
    "enrollments": {
        _A: Side([("studentid", "a_student_sf_id", "a_sf_id", "left"), ("collegeid", "a_college_sf_id", "a_sf_college_id", "left")]),
        _B: Side([("studentid", "b_sf_id", "b_sf_id", "left"), ("collegeid", "ipedsid", "ipedsid", "left")]),
    },
    "acttests": {_A: Side([("studentid", "cps_id", "cps_id", "inner")]), _B: Side([("studentid", "b_sf_id", "b_sf_id", "inner")])},
    "aptests": {_A: Side([("studentid", "a_powerschool_id", "cps_id", "inner")])},
    "gpa_cumulative": {
        _A: Side([("studentid", "a_student_sf_id", "a_sf_id", "left"), ("schoolid", "a_sf_school_id", "a_sf_school_id", "left")]),
        _B: Side([("studentid", "b_sf_id", "b_sf_id", "left"), ("schoolid", "b_sf_school_id", "b_sf_school_id", "left")]),
    },
    "gpa_by_year": {
        _A: Side([("studentid", "cps_id", "cps_id", "left"), ("schoolid", "a_powerschool_school_id", "a_powerschool_id", "left")]),
        _B: Side([("studentid", "b_sf_id", "b_sf_id", "left"), ("schoolid", "b_sf_school_id", "b_sf_school_id", "left")]),
    },
    "attendance": {
        _A: Side([("studentid", "student_cps_id", "cps_id", "left"), ("schoolid", "school_a_powerschoolid", "a_powerschool_id", "left")]),
        _B: Side([("studentid", "b_sf_id", "b_sf_id", "left")], empty=["schoolid"]),
    },
    "hs_enrollment": {
        _A: Side([("studentid", "a_sf_id", "a_sf_id", "left"), ("schoolid", "a_sf_school_id", "a_sf_school_id", "left")]),
        _B: Side([("studentid", "b_sf_id", "b_sf_id", "left"), ("schoolid", "b_sf_school_id", "b_sf_school_id", "left")]),
    },
    "colleges": {_A: Side([("collegeid", "a_sf_college_id", "a_sf_college_id", "left")])},
    "schools": {_A: Side([("schoolid", "a_sf_school_id", "a_sf_school_id", "left")]), _B: Side([("schoolid", "b_sf_school_id", "b_sf_school_id", "left")])},
    "contacts": {_A: Side([("studentid", "a_sf_id", "a_sf_id", "inner")]), _B: Side([("studentid", "b_sf_id", "b_sf_id", "inner")])},
    "courses": {
        _A: Side([("studentid", "cps_id", "cps_id", "left"), ("schoolid", "a_powerschool_school_id", "a_powerschool_id", "left")]),
        _B: Side([("studentid", "b_sf_id", "b_sf_id", "left"), ("schoolid", "b_sf_school_id", "b_sf_school_id", "left")]),
    },
}


def integrate_ids(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The three id tables; a job for each.  Write them once before facts are resolved against them."""
    out = {}
    for table in ("studentid", "schoolid", "collegeid"):
        frames = [p[table] for p in (a, b) if table in p]
        if frames:
            out[table] = assign_ids(frames, table, once=True)
    return out


def integrate_table(
    table: str, a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], ids: Mapping[str, DataFrame], names: Mapping[str, str] | None = None
) -> DataFrame:
    """One integrated table over both partners.

    ``names`` gives a column per id table that comes with the ids found there, after the contract's columns.
    The other tables are lazy frames; of the enrolments a job writes the rows that get ids.
    """
    names = names or {}
    contract = CONTRACTS[table]
    parts = []
    for letter, partner in ((_A, a), (_B, b)):
        side = RESOLUTION[table].get(letter)
        if side is None or table not in partner:
            continue
        # an id table no partner delivered resolves to unknown ids
        lookups = [IdLookup(ids[t], on, id_col, t, how, [names[t]] if t in names else []) for t, on, id_col, how in side.lookups if t in ids]
        unknown = [t for t, *_ in side.lookups if t not in ids]
        parts.append(PartnerSource(contract.conform(partner[table]), lookups, [*side.empty, *unknown]))
    id_columns = [c for c in contract.id_columns() if c != "enrollid"]
    out = integrate(parts, id_columns, contract.data_columns())
    if table == "enrollments":
        natural = out.columns
        out = assign_ids([out], "enrollid", along=list(names.values()), once=True).select("enrollid", *natural)
    return out


def integrate_all(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], ids: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """I04-I16 as frames (:func:`integrate_table`); the label table follows from the enrolments."""
    out = {t: integrate_table(t, a, b, ids) for t in RESOLUTION if t in a or t in b}
    if "enrollments" in out:
        out["enrollment_dummies"] = label_table(out["enrollments"])
    return out


def build_warehouse(
    spark: SparkSession,
    raw_a: Mapping[str, DataFrame],
    raw_b: Mapping[str, DataFrame],
    settings: Mapping,
    as_of: date,
    overwrite: bool = True,
    namespaces: Sequence[str] = NAMESPACES,
    skip_a: Sequence[str] = (),
    skip_b: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The whole load: partner tables, id tables, integrated tables, each written once.

    Tables are read back after writing, so that ids are resolved against fixed
    id tables and labels against fixed enrolment ids.
    """
    create_namespaces(spark, namespaces)
    _, ns_a, ns_b, common = namespaces
    mode = "replace" if overwrite else "fail"

    def keep(df: DataFrame, name: str) -> DataFrame:
        write_table(df, name, mode)
        return spark.table(name)

    clean = []
    for ns, manifest, raw, skip in ((ns_a, MANIFEST_A, raw_a, skip_a), (ns_b, MANIFEST_B, raw_b, skip_b)):
        tables = run_manifest(manifest, raw, {"as_of": as_of, **settings}, skip)
        clean.append({t: keep(df, f"{ns}.{t}") for t, df in tables.items()})
    a, b = clean
    out = {t: keep(df, f"{common}.{t}") for t, df in integrate_ids(a, b).items()}
    ids = dict(out)
    for table in RESOLUTION:
        if table in a or table in b:
            out[table] = keep(integrate_table(table, a, b, ids), f"{common}.{table}")
    if "enrollments" in out:
        out["enrollment_dummies"] = keep(label_table(out["enrollments"]), f"{common}.enrollment_dummies")
    return out
