"""Joins, aggregates, ranks and data-quality queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cohortspark.functions import cleaning as X
from cohortspark.operators import aggregates as A
from cohortspark.operators import features as FT
from cohortspark.operators import joins as J
from cohortspark.operators import quality as Q
from cohortspark.operators.ranks import percent_rank_by
from cohortspark.sources.writers import add_columns, join_to_ids
from queries.base import AS_OF, SPLIT, oracle, query, raw, tables, view

# --- joins ------------------------------------------------------------------------

_PARTNERS_SQL = """
pa AS (SELECT 'A' || c_custkey AS a_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'P' || c_custkey END AS shared_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
pb AS (SELECT 'B' || c_custkey AS b_id, 'Q' || c_custkey AS shared_id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))"""


def _partner_ids(spark, sf):
    c = raw(spark, sf, "customer")
    in_a = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    key = F.col("c_custkey").cast("string")
    a = c.filter(in_a).select(
        F.concat(F.lit("A"), key).alias("a_id"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("P"), key)).alias("shared_id")
    )
    b = c.filter(~in_a).select(F.concat(F.lit("B"), key).alias("b_id"), F.concat(F.lit("Q"), key).alias("shared_id"))
    return a, b


@query(
    "assign_ids",
    f"""WITH {_PARTNERS_SQL},
u AS (SELECT a_id, NULL AS b_id, shared_id FROM pa UNION SELECT NULL, b_id, shared_id FROM pb)
SELECT *, count(*) OVER () AS n, CAST(1 AS BIGINT) AS lowest, count(*) OVER () AS highest, count(*) OVER () AS n_distinct FROM u""",
)
def assign_ids(spark, sf):
    """Dense surrogate ids; the oracle sees the natural keys and that ids are 1..n."""
    a, b = _partner_ids(spark, sf)
    ids = J.assign_ids([a, b], "studentid")
    stats = ids.agg(
        F.count(F.lit(1)).alias("n"), F.min("studentid").alias("lowest"), F.max("studentid").alias("highest"), F.count_distinct("studentid").alias("n_distinct")
    )
    s = F.struct("n", "lowest", "highest", "n_distinct")
    return ids.select("a_id", "b_id", "shared_id", stats.select(s.alias("s")).scalar().alias("s")).select("a_id", "b_id", "shared_id", "s.*")


@query(
    "resolve_ids",
    f"""WITH {_PARTNERS_SQL},
facts AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)
SELECT DISTINCT o_orderkey, o_totalprice, coalesce(pa.a_id, pb.b_id) AS natural_id FROM facts
LEFT JOIN pa ON pa.a_id = 'A' || facts.k LEFT JOIN pb ON pb.b_id = 'B' || facts.k""",
)
def resolve_ids(spark, sf):
    """Two partners' facts to surrogate ids; null keys never match."""
    a, b = _partner_ids(spark, sf)
    ids = J.assign_ids([a, b], "studentid")
    o = raw(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")))
    segment = raw(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    o = o.join(segment, "k", "left")
    in_b = F.coalesce(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit(False))
    of = lambda rows, p: rows.select("o_orderkey", "o_totalprice", F.concat(F.lit(p), F.col("k").cast("string")).alias("ext"))
    facts = J.integrate(
        [
            J.PartnerSource(of(o.filter(~in_b), "A"), [J.IdLookup(ids, "ext", "a_id", "studentid")]),
            J.PartnerSource(of(o.filter(in_b), "B"), [J.IdLookup(ids, "ext", "b_id", "studentid")]),
        ],
        ["studentid"],
        ["o_orderkey", "o_totalprice"],
    )
    natural = ids.select("studentid", F.coalesce("a_id", "b_id").alias("natural_id"))
    return facts.join(natural, "studentid", "left").select("o_orderkey", "o_totalprice", "natural_id")


@query(
    "resolve_ids_inner",
    f"""WITH {_PARTNERS_SQL} SELECT DISTINCT o_orderkey, pa.a_id FROM orders JOIN pa ON pa.shared_id = 'P' || o_custkey""",
)
def resolve_ids_inner(spark, sf):
    """Inner resolution drops facts of unknown owners."""
    a, b = _partner_ids(spark, sf)
    ids = J.assign_ids([a, b], "studentid")
    o = raw(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("ext"))
    facts = J.integrate([J.PartnerSource(o, [J.IdLookup(ids, "ext", "shared_id", "studentid", "inner")])], ["studentid"], ["o_orderkey"])
    return facts.join(ids.select("studentid", "a_id"), "studentid").select("o_orderkey", "a_id")


@query(
    "right_join_ids",
    "SELECT c.c_custkey AS id, t.total FROM (SELECT o_custkey, count(*) AS total FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000 GROUP BY 1) t RIGHT JOIN customer c ON t.o_custkey = c.c_custkey",
)
def right_join_ids(spark, sf):
    """Every id row, with loaded data where it matches."""
    temp = raw(spark, sf, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 300000").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("total")
    )
    return join_to_ids(temp, raw(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id").select("id", "total")


@query(
    "update_from",
    """SELECT c_custkey, c_nationkey, CASE WHEN t.k IS NOT NULL THEN t.seg ELSE c_mktsegment END AS c_mktsegment, t.n AS n_orders
FROM customer LEFT JOIN (SELECT o_custkey AS k, CASE WHEN count(*) > 12 THEN NULL ELSE 'ACTIVE' END AS seg, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 8) t ON k = c_custkey""",
)
def update_from(spark, sf):
    """Update and add columns by key; unmatched rows keep their value."""
    n = F.count(F.lit(1))
    updates = raw(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n.alias("n_orders")).filter("n_orders > 8").withColumn(
        "c_mktsegment", F.when(F.col("n_orders") <= 12, "ACTIVE")
    )
    target = raw(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return add_columns(target, updates, "c_custkey", ["c_mktsegment", "n_orders"])


@query(
    "membership_semi",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
def membership_semi(spark, sf):
    """Membership filter as a left semi join."""
    rich = raw(spark, sf, "customer").filter("c_acctbal > 5000")
    return J.members(raw(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", rich, "c_custkey")


@query(
    "restrict_semi",
    oracle("enrolment", "SELECT enrollid, status FROM enrolment WHERE enrollid IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 150) AND degree_type = '1-URGENT'"),
)
def restrict_semi(spark, sf):
    """Restrictor predicates as semi joins, default and free form."""
    big = raw(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("enrollid")).agg((F.sum("l_quantity") > 150).alias("big"))
    e = view(spark, sf, "enrolment")
    out = J.restrict(e.select("enrollid", "status"), big, "enrollid")
    return J.restrict(out, e.select("enrollid", "degree_type"), "enrollid", F.col("degree_type") == "1-URGENT")


@query(
    "fk_violations",
    """SELECT 'lineitem' AS "table", 'parent: references' AS rule, concat_ws('|', l_orderkey, l_linenumber) AS key, CAST(l_partkey AS VARCHAR) AS value
FROM lineitem WHERE l_linenumber <> 2 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)""",
)
def fk_violations(spark, sf):
    """Q09: references without a parent row; null references are exempt."""
    li = raw(spark, sf, "lineitem").withColumn("parent", F.when(F.col("l_linenumber") != 2, F.col("l_partkey")))
    return Q.fk_violations(li, "lineitem", ["l_orderkey", "l_linenumber"], "parent", raw(spark, sf, "part").filter("p_size < 45"), "p_partkey")


_ROW_RULES = (
    ("l_returnflag: length = 1", "length(l_returnflag) = 1", "l_returnflag"),
    ("l_returnflag: allowed values", "l_returnflag IN ('A', 'N')", "l_returnflag"),
    ("l_quantity: range 1..48", "l_quantity >= 1 AND l_quantity <= 48", "q"),
    ("l_quantity: multiple of 5", "CAST(l_quantity AS INT) % 5 = 0 OR l_linenumber <> 7", "q"),
    ("l_shipdate: after 1995-02-01", "l_shipdate > DATE '1995-02-01'", "d"),
    ("l_shipdate: not after today + 1", f"l_shipdate <= DATE '{AS_OF}' + 1", "d"),
    ("l_shipdate: before today + 3 months", f"l_shipdate < DATE '{AS_OF}' + INTERVAL 3 MONTH", "d"),
    ("l_shipdate: year < now + 0", f"year(l_shipdate) < {AS_OF.year}", "y"),
    ("l_linestatus: matches ^f$", "regexp_matches(l_linestatus, '(?i)^f$')", "l_linestatus"),
    ("maybe: not null", "maybe IS NOT NULL", "maybe"),
    ("l_discount: discount under tax rule", "l_discount <= l_tax + 0.09", "disc"),
)


@query(
    "expectation_violations",
    """WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate,
  CASE WHEN l_linenumber <> 6 THEN l_returnflag END AS maybe FROM lineitem),
txt AS (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, CAST(l_shipdate AS VARCHAR) AS d, CAST(year(l_shipdate) AS VARCHAR) AS y, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) AS disc FROM li)
"""
    + " UNION ALL ".join(
        f"""SELECT 'lineitem' AS "table", '{r}' AS rule, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, {v} AS value FROM txt WHERE NOT ({c.replace("'", "'")})"""
        for r, c, v in _ROW_RULES
    )
    + """ UNION ALL SELECT 'lineitem', 'l_orderkey, l_linenumber: unique', concat_ws('|', l_orderkey, l_linenumber), CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'lineitem', 'maybe: primary key', coalesce(maybe, ''), CAST(count(*) AS VARCHAR) FROM li GROUP BY maybe""",
)
def expectation_violations(spark, sf):
    """Q01-Q08, Q10: row rules in one scan, unique and primary keys by counting."""
    li = raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_returnflag", "l_linestatus",
        F.col("l_quantity").cast("int").alias("l_quantity"), F.col("l_shipdate").cast("date").alias("l_shipdate"),
        F.round(F.col("l_discount") * 100).cast("int").alias("l_discount"),
        F.when(F.col("l_linenumber") != 6, F.col("l_returnflag")).alias("maybe"),
    )
    year = F.year("l_shipdate")
    rows = li.withColumn("ship_year", year)
    checks = [
        Q.has_length("l_returnflag", 1),
        Q.one_of("l_returnflag", ["A", "N"]),
        Q.in_range("l_quantity", 1, 48),
        Q.Check("l_quantity", "multiple of 5", lambda d: Q.multiple_of("l_quantity", 5).condition(d) | (F.col("l_linenumber") != 7)),
        Q.after("l_shipdate", date(1995, 2, 1)),
        Q.not_after_today("l_shipdate", 1),
        Q.before_months_ahead("l_shipdate", 3),
        Q.year_before("ship_year"),
        Q.matches("l_linestatus", "^f$"),
        Q.not_null("maybe"),
        Q.satisfies("l_discount", "discount under tax rule", "l_discount / 100 <= l_tax + 0.09"),
    ]
    broken = Q.row_violations(rows, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], checks, AS_OF)
    broken = broken.withColumn("rule", F.replace("rule", F.lit("ship_year:"), F.lit("l_shipdate:")))
    return Q.all_violations(
        [broken, Q.unique_violations(li, "lineitem", ["l_orderkey", "l_linenumber"]), Q.unique_violations(li, "lineitem", ["maybe"], primary=True)]
    )


# --- aggregates -------------------------------------------------------------------

@query(
    "mode_repair",
    oracle(
        "contact",
        """WITH c AS (SELECT event_id, studentid AS owner, CASE WHEN studentid % 10 = 9 THEN NULL ELSE 'school' || studentid % 10 END AS grp,
  CASE WHEN event_id % 3 = 0 THEN 'batch' ELSE counselor_id END AS item FROM contact),
real AS (SELECT * FROM c WHERE item <> 'batch'),
gm AS (SELECT grp, item AS m FROM (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, item) AS rn FROM real WHERE grp IS NOT NULL GROUP BY grp, item) WHERE rn = 1),
om AS (SELECT owner, item AS m FROM (SELECT owner, item, row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, item) AS rn FROM real GROUP BY owner, item) WHERE rn = 1)
SELECT event_id, CASE WHEN grp IS NULL THEN NULL WHEN grp NOT IN ('school1', 'school2') THEN gm.m
  WHEN item = 'batch' THEN coalesce(om.m, gm.m) ELSE item END AS fixed FROM c LEFT JOIN gm USING (grp) LEFT JOIN om USING (owner)""",
    ),
)
def mode_repair(spark, sf):
    """Overwrite placeholder ids by group and owner modes."""
    c = view(spark, sf, "contact").select(
        "event_id", F.col("studentid").alias("owner"),
        F.when(F.col("studentid") % 10 != 9, F.concat(F.lit("school"), (F.col("studentid") % 10).cast("string"))).alias("grp"),
        F.when(F.col("event_id") % 3 == 0, "batch").otherwise(F.col("counselor_id")).alias("item"),
    )
    return A.repair_by_mode(c, "owner", "grp", "item", ["batch"], ["school1", "school2"], "fixed").select("event_id", "fixed")


@query(
    "single_valued_groups",
    "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1",
)
def single_valued_groups(spark, sf):
    """Groups with exactly one distinct value."""
    return A.single_valued_groups(raw(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@query(
    "weighted_ratio",
    oracle(
        "course",
        """WITH c AS (SELECT studentid, year_taken, percent_grade / 25 AS points, credit_hours AS h, CASE WHEN was_ap THEN 1.0 ELSE 0 END + CASE WHEN was_honors THEN 0.5 ELSE 0 END AS bonus, course_number % 10 AS school FROM course)
SELECT studentid, year_taken, round(sum(points * h) / sum(h), 9) AS unweighted, round(sum((points + bonus) * h) / sum(h), 9) AS weighted,
  round(sum(points * h) / sum(CASE WHEN points IS NOT NULL THEN h END), 9) AS graded_only,
  (SELECT school FROM c d WHERE d.studentid = c.studentid AND d.year_taken = c.year_taken GROUP BY school ORDER BY count(*) DESC, school LIMIT 1) AS school
FROM c GROUP BY studentid, year_taken HAVING count(points) > 0""",
    ),
)
def weighted_ratio(spark, sf):
    """Weighted averages with bonuses and the most common attribute."""
    c = view(spark, sf, "course").withColumn("points", F.col("percent_grade") / 25).withColumn("school", F.col("course_number") % 10)
    bonus = F.when(F.col("was_ap"), 1.0).otherwise(0.0) + F.when(F.col("was_honors"), 0.5).otherwise(0.0)
    hours = F.col("credit_hours")
    group = ["studentid", "year_taken"]
    ratios = c.groupBy(*group).agg(
        F.round(A.weighted_ratio(F.col("points"), hours), 9).alias("unweighted"),
        F.round(A.weighted_ratio(F.col("points") + bonus, hours), 9).alias("weighted"),
        F.round(A.weighted_ratio(F.col("points"), hours, exclude_unknown=True), 9).alias("graded_only"),
        F.count("points").alias("graded"),
    ).filter("graded > 0").drop("graded")
    return ratios.join(A.mode_by(c, group, "school", "school"), group)


_GPA_COLUMNS = (
    "year12_unweightedgpa", "year11_unweightedgpa", "year10_unweightedgpa", "year9_unweightedgpa",
    "avg_y11_y12_unweightedgpa", "avg_y9_y10_unweightedgpa", "unweighted_gpa_diff",
)


@query(
    "guarded_average",
    oracle(
        "school_term person",
        """WITH g AS (SELECT t.studentid, unweighted_gpa AS v, high_school_class - school_year AS gap FROM school_term t LEFT JOIN person p USING (studentid)),
a AS (SELECT studentid, """
        + ", ".join(f"CASE WHEN count(v) FILTER (gap = {k}) = 1 THEN avg(v) FILTER (gap = {k}) END AS year{12 - k}_unweightedgpa" for k in range(4))
        + """, CASE WHEN count(v) FILTER (gap <= 1) = 2 THEN avg(v) FILTER (gap <= 1) END AS avg_y11_y12_unweightedgpa,
  CASE WHEN count(v) FILTER (gap > 1 AND gap < 4) = 2 THEN avg(v) FILTER (gap > 1 AND gap < 4) END AS avg_y9_y10_unweightedgpa FROM g GROUP BY 1)
SELECT studentid, """
        + ", ".join(f"round({c}, 10) AS {c}" for c in _GPA_COLUMNS[:-1])
        + ", round(avg_y11_y12_unweightedgpa - avg_y9_y10_unweightedgpa, 10) AS unweighted_gpa_diff FROM a",
    ),
)
def guarded_average(spark, sf):
    """Averages guarded by an exact count, and their difference, in one aggregate."""
    out = FT.gpa_years(tables(spark, sf), FT.Bounds(), _GPA_COLUMNS, FT.Options())
    return out.select("studentid", *[F.round(c, 10).alias(c) for c in _GPA_COLUMNS])


_AVG = tuple(c for c in FT._AVERAGES if c != "YearlyAvgAttendance")
_TYPES = {"Tardy": "'tardy'", "Suspended": "'suspended'", "Excused": "'excused'", "Unexcused": "'unexcused'", "EarlyDismissal": "'early_dismissal'", "Away": "'tardy', 'unexcused', 'early_dismissal'"}


@query(
    "nested_average",
    oracle(
        "attendance person",
        """WITH cells AS (SELECT a.studentid, attendance_type AS t, high_school_class - school_year AS gap, count(*) AS n FROM attendance a JOIN person p USING (studentid)
  WHERE attendance_type IS NOT NULL AND high_school_class - school_year BETWEEN 0 AND 6 GROUP BY ALL)
SELECT studentid, """
        + ", ".join(
            f'round(avg(n) FILTER (t IN ({_TYPES[c[5:]]}) AND gap {"<= 3" if c[3:5] == "HS" else ">= 4"}), 10) AS "{c}"' for c in _AVG
        )
        + " FROM cells GROUP BY 1",
    ),
)
def nested_average(spark, sf):
    """Twelve means of per-year counts from one two-stage aggregation."""
    out = FT.attendance_averages(tables(spark, sf), FT.Bounds(), _AVG, FT.Options())
    return out.select("studentid", *[F.round(c, 10).alias(c) for c in _AVG])


@query(
    "yearly_average_bounded",
    oracle(
        "attendance person",
        f"""WITH cells AS (SELECT a.studentid, attendance_type, high_school_class - school_year AS gap, count(*) AS n FROM attendance a JOIN person p USING (studentid)
  WHERE attendance_type IS NOT NULL AND high_school_class - school_year BETWEEN 0 AND 3 AND attendance_date < DATE '1999-03-01' GROUP BY ALL)
SELECT studentid, round(avg(n), 10) AS "YearlyAvgAttendance" FROM cells GROUP BY 1""",
    ),
)
def yearly_average_bounded(spark, sf):
    """the generic yearly average, bounded by date."""
    out = FT.attendance_averages(tables(spark, sf), FT.Bounds(None, date(1999, 3, 1)), ["YearlyAvgAttendance"], FT.Options())
    return out.select("studentid", F.round("YearlyAvgAttendance", 10).alias("YearlyAvgAttendance")).filter("YearlyAvgAttendance IS NOT NULL")


@query(
    "pivot_totals",
    oracle(
        "attendance person",
        f"""SELECT a.studentid, """
        + ", ".join(f"count(*) FILTER (attendance_type = '{t}') AS \"HSTotal_{t}\"" for t in FT.ATTENDANCE_TYPES)
        + f""" FROM attendance a JOIN person p USING (studentid) WHERE attendance_type IS NOT NULL AND high_school_class - school_year BETWEEN 0 AND 3
  AND attendance_date < DATE '{SPLIT}' GROUP BY 1""",
    ),
)
def pivot_totals(spark, sf):
    """Totals per type as columns, zero filled, static schema."""
    wanted = [f"HSTotal_{t}" for t in FT.ATTENDANCE_TYPES]
    return FT.attendance_totals(tables(spark, sf), FT.Bounds(None, SPLIT), wanted, FT.Options())


_MEDIA = ("click", "purchase", "signup", "view")


@query(
    "percent_share",
    oracle(
        "contact",
        "SELECT studentid, " + ", ".join(f"round(100.0 * count(*) FILTER (contact_medium = '{m}') / count(*), 10) AS \"{m}\"" for m in _MEDIA) + " FROM contact WHERE contact_medium IS NOT NULL GROUP BY 1",
    ),
)
def percent_share(spark, sf):
    """Share of contacts per medium."""
    out = A.pivot_shares(view(spark, sf, "contact"), "studentid", "contact_medium", _MEDIA)
    return out.select("studentid", *[F.round(m, 10).alias(m) for m in _MEDIA])


@query(
    "contact_counts",
    oracle(
        "contact",
        """SELECT studentid, count(*) AS num_contacts, nullif(count(*) FILTER (initiated_by_student), 0) AS student_initiated_contacts,
  nullif(count(*) FILTER (was_successful = FALSE), 0) AS total_unsuccessful_contacts, count(DISTINCT counselor_id) AS number_counselors
FROM contact WHERE contact_date < DATE '2024-01-20' GROUP BY 1""",
    ),
)
def contact_counts(spark, sf):
    """Contact counts and distinct counsellors from one scan."""
    wanted = ["num_contacts", "student_initiated_contacts", "total_unsuccessful_contacts", "number_counselors"]
    return FT.contact_counts(tables(spark, sf), FT.Bounds(None, date(2024, 1, 20)), wanted, FT.Options())


@query(
    "ap_honours_family",
    oracle(
        "course",
        "SELECT studentid, "
        + ", ".join(f"CAST(sum(CASE WHEN high_school_class - year_taken = {k} THEN CAST(was_{c} AS INT) END) AS BIGINT) AS number{n}year{12 - k}" for k in range(3) for c, n in (("ap", "aps"), ("honors", "hons")))
        + f" FROM course WHERE grade_available < DATE '{SPLIT}' AND high_school_class - year_taken BETWEEN 0 AND 2 GROUP BY 1",
    ),
)
def ap_honours_family(spark, sf):
    """Six conditional sums of flags over one scan."""
    wanted = [f"number{n}year{12 - k}" for k in range(3) for n in ("aps", "hons")]
    return FT.advanced_courses(tables(spark, sf), FT.Bounds(None, SPLIT), wanted, FT.Options())


_RANKS = tuple(f"{s}rankyear{y}" for s in ("max", "min", "avg") for y in (12, 11, 10))


def _rank_sql(source: str, tail: str) -> str:
    return oracle(
        "course",
        f"""WITH r AS (SELECT *, high_school_class - year_taken AS gap, percent_rank() OVER (PARTITION BY course_number ORDER BY percent_grade ASC NULLS LAST) AS pr FROM {source})
SELECT studentid, """
        + ", ".join(f"round({s}(pr) FILTER (gap = {12 - y}), 10) AS {s}rankyear{y}" for s in ("max", "min", "avg") for y in (12, 11, 10))
        + f" FROM r WHERE semester_taken <> 3 AND gap BETWEEN 0 AND 2 {tail} GROUP BY 1",
    )


@query("rank_family", _rank_sql("course", f"AND grade_available < DATE '{SPLIT}'"))
def rank_family(spark, sf):
    """Nine aggregates over one percent rank per course, nulls last."""
    out = FT.course_ranks(tables(spark, sf), FT.Bounds(None, SPLIT), _RANKS, FT.Options())
    return out.select("studentid", *[F.round(c, 10).alias(c) for c in _RANKS])


@query("rank_family_point_in_time", _rank_sql(f"(SELECT * FROM course WHERE grade_available < DATE '{SPLIT}')", ""))
def rank_family_point_in_time(spark, sf):
    """W01 with the option to rank only what was known at the split."""
    out = FT.course_ranks(tables(spark, sf), FT.Bounds(None, SPLIT), _RANKS, FT.Options(rank_point_in_time=True))
    return out.select("studentid", *[F.round(c, 10).alias(c) for c in _RANKS])


@query("rank_family_plain", _rank_sql("course", f"AND grade_available < DATE '{SPLIT}'"))
def rank_family_plain(spark, sf):
    """W01, F60-F68 over range partitions of (course, grade): same result."""
    options = FT.Options(rank_slices=None)
    out = FT.course_ranks(tables(spark, sf), FT.Bounds(None, SPLIT), _RANKS, options)
    return out.select("studentid", *[F.round(c, 10).alias(c) for c in _RANKS])


@query(
    "percent_rank_sliced",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(percent_rank() OVER (PARTITION BY l_returnflag ORDER BY price ASC NULLS LAST), 9) AS pr
FROM (SELECT *, CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS price FROM lineitem)""",
)
def percent_rank_sliced(spark, sf):
    """W01 on three huge groups with near-unique values: ordered totals by range partitions."""
    li = raw(spark, sf, "lineitem").withColumn("price", F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")))
    out = percent_rank_by(li, ["l_returnflag"], "price", "pr")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round("pr", 9).alias("pr"))


@query(
    "latest_per_key",
    oracle(
        "enrolment",
        """SELECT studentid, enrollid, status FROM enrolment QUALIFY row_number() OVER (PARTITION BY studentid ORDER BY end_date DESC NULLS FIRST, enrollid DESC) = 1""",
    ),
)
def latest_per_key(spark, sf):
    """Latest row per key where a missing date wins."""
    return A.latest_by_key(view(spark, sf, "enrolment"), ["studentid"], "end_date", ["enrollid"], ["enrollid", "status"])


@query(
    "last_contact_medium",
    oracle(
        "contact",
        """SELECT studentid, CASE contact_medium WHEN 'click' THEN 'Call' WHEN 'purchase' THEN 'In Person' WHEN 'signup' THEN 'Email' WHEN 'view' THEN 'Text' END AS last_contact_medium
FROM contact WHERE was_successful AND contact_date < DATE '2024-01-25'
QUALIFY row_number() OVER (PARTITION BY studentid ORDER BY contact_date DESC, CASE contact_medium WHEN 'click' THEN 'Call' WHEN 'purchase' THEN 'In Person' WHEN 'signup' THEN 'Email' WHEN 'view' THEN 'Text' END DESC NULLS LAST) = 1""",
    ),
)
def last_contact_medium(spark, sf):
    """Medium of the last successful contact before a date."""
    return FT.last_contact(tables(spark, sf), FT.Bounds(None, date(2024, 1, 25)), ["last_contact_medium"], FT.Options())


@query(
    "recent_school",
    oracle("person", "SELECT studentid, school AS name FROM person"),
)
def recent_school(spark, sf):
    """Name of the school attended last."""
    return FT.recent_school(tables(spark, sf), FT.Bounds(), ["name"], FT.Options())


@query(
    "best_score",
    oracle("test_score", f"SELECT studentid, max(score_composite) AS max_composite_act_score FROM test_score WHERE test_level = 'ACT' AND date < DATE '{SPLIT}' GROUP BY 1"),
)
def best_score(spark, sf):
    """Best score of one test level before a date."""
    return FT.best_act(tables(spark, sf), FT.Bounds(None, SPLIT), ["max_composite_act_score"], FT.Options())


@query(
    "group_mean_first",
    oracle(
        "course",
        """SELECT studentid, round(avg(percent_grade), 10) AS percent_grade, round(avg(credit_hours), 10) AS credit_hours,
  arg_min(course_number, (grade_available, course_number)) AS course_number FROM course GROUP BY 1""",
    ),
)
def group_mean_first(spark, sf):
    """Group means plus the first other attribute by a stated order."""
    out = A.group_mean_first(view(spark, sf, "course"), "studentid", ["percent_grade", "credit_hours"], "course_number", ["grade_available", "course_number"])
    return out.select("studentid", F.round("percent_grade", 10).alias("percent_grade"), F.round("credit_hours", 10).alias("credit_hours"), "course_number")


@query(
    "first_enrolment",
    oracle(
        "enrolment",
        """WITH f AS (SELECT studentid, min(start_date) AS d FROM enrolment WHERE status <> 'Did not matriculate' GROUP BY 1)
SELECT enrollid, CASE WHEN f.d < start_date THEN FALSE ELSE TRUE END AS is_first_enrollment FROM enrolment LEFT JOIN f USING (studentid)""",
    ),
)
def first_enrolment(spark, sf):
    """First enrolment that really started."""
    return FT.first_enrolment(tables(spark, sf), FT.Bounds(), ["is_first_enrollment"], FT.Options())


@query(
    "group_minimum",
    oracle("enrolment", "SELECT enrollid, min(CASE WHEN status <> 'Graduated' THEN start_date END) OVER (PARTITION BY studentid) AS first_start FROM enrolment"),
)
def group_minimum(spark, sf):
    """Group minimum attached to each row by aggregate and join."""
    e = view(spark, sf, "enrolment").select("enrollid", "studentid", "status", "start_date")
    return J.with_group_minimum(e, "studentid", F.when(F.col("status") != "Graduated", F.col("start_date")), "first_start").select("enrollid", "first_start")


@query(
    "age_at_event",
    oracle("enrolment person", "SELECT enrollid, CAST(date_part('year', age(CAST(start_date AS TIMESTAMP), CAST(date_of_birth AS TIMESTAMP))) AS INT) AS age_at_enrollment FROM enrolment LEFT JOIN person USING (studentid)"),
)
def age_at_event(spark, sf):
    """Completed years at the start of an enrolment."""
    return FT.enrolment_age(tables(spark, sf), FT.Bounds(), ["age_at_enrollment"], FT.Options())


_STUDENT = ("is_female", "ethnicity", "ever_special_ed", "ever_free_lunch", "is_first_gen", "cumulative_unweighted_gpa", "high_school_class")
_COLLEGE = tuple(c for f in FT.CATALOGUE.values() if f.family == "college_attributes" for c in f.columns)


@query(
    "student_features",
    oracle("person", f"SELECT studentid, {', '.join(_STUDENT)} FROM person"),
)
def student_features(spark, sf):
    """Student attributes."""
    t, b, o = tables(spark, sf), FT.Bounds(), FT.Options()
    parts = [FT.final_gpa(t, b, ["cumulative_unweighted_gpa"], o), FT.school_class(t, b, [], o)]
    return J.left_joins(FT.student_attributes(t, b, _STUDENT[:5], o), [("studentid", p) for p in parts])


@query(
    "college_features",
    oracle("provider", f"SELECT collegeid, {', '.join('name AS college_name' if c == 'college_name' else c for c in _COLLEGE)} FROM provider"),
)
def college_features(spark, sf):
    """College attributes."""
    return FT.college_attributes(tables(spark, sf), FT.Bounds(), _COLLEGE, FT.Options())


@query(
    "enrolment_features",
    oracle(
        "enrolment person",
        f"""SELECT enrollid, start_date, month(start_date) IN (12, 1, 2, 3, 4) AS is_spring, degree_type,
  CASE WHEN start_date < DATE '{SPLIT}' THEN degree_subject END AS degree_subject, CASE WHEN start_date < DATE '{SPLIT}' THEN major END AS major,
  network IN ('AFRICA') AS is_partner_a, network IN ('ASIA') AS is_partner_b FROM enrolment LEFT JOIN person USING (studentid)""",
    ),
)
def enrolment_features(spark, sf):
    """Enrolment attributes, bounded subject and major, network flags."""
    t, b = tables(spark, sf), FT.Bounds(None, SPLIT)
    o = FT.Options(networks={"is_partner_a": "AFRICA", "is_partner_b": "ASIA"})
    own = FT.enrolment_attributes(t, b, ["start_date", "is_spring", "degree_type", "degree_subject", "major"], o)
    return own.join(FT.enrolment_network(t, b, ["is_partner_a", "is_partner_b"], o), "enrollid", "left")


@query(
    "provider_alumni",
    oracle("enrolment", f"SELECT collegeid, count(*) AS alum_count FROM enrolment WHERE status NOT IN ('Matriculating', 'Did not matriculate') AND start_date < DATE '{SPLIT}' GROUP BY 1"),
)
def provider_alumni(spark, sf):
    """started enrolments per college before a date."""
    return FT.college_alumni(tables(spark, sf), FT.Bounds(None, SPLIT), ["alum_count"], FT.Options())


@query(
    "crosstab_flags",
    oracle(
        "enrolment",
        """WITH f AS (SELECT studentid, min(start_date) AS d FROM enrolment WHERE status <> 'Did not matriculate' GROUP BY 1),
x AS (SELECT month(start_date) IN (12, 1, 2, 3, 4) AS is_spring, NOT coalesce(f.d < start_date, FALSE) AS first FROM enrolment LEFT JOIN f USING (studentid) WHERE degree_type = '2-HIGH')
SELECT is_spring, count(*) FILTER (first) AS is_first_enrollment_true, count(*) FILTER (NOT first) AS is_first_enrollment_false FROM x GROUP BY 1""",
    ),
)
def crosstab_flags(spark, sf):
    """Winter start against first enrolment, for one degree type."""
    t, b, o = tables(spark, sf), FT.Bounds(), FT.Options()
    e = t["enrollments"].filter(F.col("degree_type") == "2-HIGH").select("enrollid", X.winter_start("start_date").alias("is_spring"))
    both = e.join(FT.first_enrolment(t, b, ["is_first_enrollment"], o), "enrollid")
    return A.crosstab_counts(both, "is_spring", "is_first_enrollment", [True, False])


@query("value_counts", oracle("enrolment", "SELECT status, count(*) AS n FROM enrolment GROUP BY 1"))
def value_counts(spark, sf):
    """A21."""
    return A.value_counts(view(spark, sf, "enrolment"), "status")
