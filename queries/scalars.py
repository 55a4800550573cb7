"""Cleaning expressions, row filters and mapping sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import cleaning as X
from cohortspark.operators import rows as R
from cohortspark.sources.readers import lookup_table, mapping_frame, translate_text
from queries.base import AS_OF, SPLIT, TRAIN_START, oracle, query, raw, view


@query(
    "recode_passthrough",
    """SELECT c_custkey AS customer_key,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS segment,
  CASE c_name WHEN 'Customer#000000001' THEN 'First' ELSE c_name END AS name FROM customer""",
)
def recode_passthrough(spark, sf):
    """Dictionary recode with pass-through and a null target."""
    c = raw(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_key"),
        X.recode("c_mktsegment", {"BUILDING": "Construction", "HOUSEHOLD": None}).alias("segment"),
        X.recode("c_name", {"Customer#000000001": "First"}).alias("name"),
    )


@query(
    "translate_free_text",
    """WITH m AS (SELECT upper(p_name) AS raw_value, max(p_partkey) AS last_key FROM part
  WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1),
std AS (SELECT m.raw_value, CASE WHEN p.p_size % 5 = 0 THEN NULL ELSE upper(split_part(p.p_name, ' ', 2)) END AS standard
  FROM m JOIN part p ON p.p_partkey = m.last_key),
txt AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE '  ' || p_name || '  x' END AS padded,
    CASE WHEN p_size = 7 THEN NULL ELSE '  ' || replace(p_name, ' ', '   ') END AS t FROM part)
SELECT t.p_partkey, CASE WHEN t.t IS NULL THEN NULL WHEN s.raw_value IS NULL THEN 'OTHER' ELSE s.standard END AS clean,
  CASE WHEN t.padded IS NULL THEN NULL ELSE 'OTHER' END AS unknown
FROM txt t LEFT JOIN std s ON s.raw_value = upper(trim(regexp_replace(t.t, '\\s+', ' ', 'g')))""",
)
def translate_free_text(spark, sf):
    """Free text through a mapping with duplicate keys, empty targets and unknown text."""
    part = raw(spark, sf, "part")
    source = part.filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(
        F.col("p_partkey").alias("line"),
        F.col("p_name").alias("text"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.split("p_name", " ")[1]).alias("standard"),
    )
    mapping = mapping_frame(source, "text", "standard")
    known = F.col("p_size") != 7
    texts = part.select(
        "p_partkey",
        F.when(known, F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")))).alias("t"),
        F.when(known, F.concat(F.lit("  "), "p_name", F.lit("  x"))).alias("padded"),
    )
    out = translate_text(translate_text(texts, "t", mapping, "clean"), "padded", mapping, "unknown")
    return out.select("p_partkey", "clean", "unknown")


@query(
    "lookup_values",
    "SELECT DISTINCT nullif(p_type, 'ECONOMY') AS name FROM part WHERE nullif(p_type, 'ECONOMY') IS NOT NULL",
)
def lookup_values(spark, sf):
    """Sorted lookup table of distinct standard values."""
    source = raw(spark, sf, "part").select(F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_type")).alias("v"))
    return lookup_table(source, "v")


@query(
    "classify_substring",
    """SELECT p_partkey,
  CASE WHEN contains(p_type, 'PROMO') THEN 'promo' WHEN contains(p_type, 'PRO') THEN 'pro' WHEN contains(p_type, 'STAND') OR contains(p_type, 'SMALL') THEN 'plain' END AS kind,
  CASE WHEN contains(p_name, 'red') THEN TRUE WHEN contains(p_name, 'blue') THEN FALSE END AS is_red,
  CASE WHEN p_brand IS NULL THEN NULL ELSE p_brand NOT IN ('Brand#1', 'Brand#2') END AS brand_ok,
  CASE WHEN p_name = 'small ring' THEN 'ring' ELSE lower(p_type) END AS level,
  CASE p_size % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS gender FROM part""",
)
def classify_substring(spark, sf):
    """Ordered substring classes and code flags."""
    p = raw(spark, sf, "part")
    code = F.element_at(F.array(F.lit("F"), F.lit("Female"), F.lit("M"), F.lit("x")), F.col("p_size") % 4 + 1)
    return p.select(
        "p_partkey",
        X.classify("p_type", [("PROMO", "promo"), ("PRO", "pro"), (("STAND", "SMALL"), "plain")]).alias("kind"),
        X.classify("p_name", [("red", True), ("blue", False)]).alias("is_red"),
        X.status_flag("p_brand", ["Brand#1", "Brand#2"]).alias("brand_ok"),
        F.when(F.col("p_name") == "small ring", "ring").otherwise(F.lower("p_type")).alias("level"),
        X.gender_flag(code).alias("gender"),
    )


@query(
    "date_sanitise",
    f"""SELECT o_orderkey, CASE WHEN d > DATE '1996-02-29' THEN d END AS floored,
  CASE WHEN d <= DATE '{AS_OF}' - 365 THEN d END AS capped,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE d END AS parsed,
  CASE WHEN o_orderstatus = 'F' THEN year(d) - 1 END AS class_year
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def date_sanitise(spark, sf):
    """Date floors, caps, parsing of text in two formats, class year."""
    from datetime import date

    d = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 10 == 0, "not a date").when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "M/d/yyyy")).otherwise(d.cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "Graduated").otherwise("Attending")
    return raw(spark, sf, "orders").select(
        "o_orderkey",
        X.null_before(d, date(1996, 2, 29)).alias("floored"),
        X.null_after(d, date.fromordinal(AS_OF.toordinal() - 365)).alias("capped"),
        X.parse_date(text).alias("parsed"),
        X.class_year(status, d).alias("class_year"),
    )


@query(
    "epoch_to_date",
    """SELECT event_id, CAST(ts AS DATE) AS d, CASE WHEN month(s) BETWEEN 2 AND 6 THEN 'Spring' WHEN month(s) >= 9 THEN 'Fall' END AS term,
  month(s) IN (12, 1, 2, 3, 4) AS winter,
  CASE event_type WHEN 'click' THEN 'Fall' WHEN 'view' THEN 'Spring' ELSE '' END AS phase
FROM (SELECT *, CAST(ts AS DATE) + CAST(event_id % 366 AS INT) AS s FROM events)""",
)
def epoch_to_date(spark, sf):
    """Unix seconds to date, term of month, winter flag, phase."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    shifted = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 366).cast("int"))
    phase = F.when(F.col("event_type") == "click", "Pre").when(F.col("event_type") == "view", "Post").otherwise("Mid")
    return raw(spark, sf, "events").select(
        "event_id",
        X.epoch_date(seconds).alias("d"),
        X.term_of_month(shifted).alias("term"),
        X.winter_start(shifted).alias("winter"),
        X.term_of_phase(phase).alias("phase"),
    )


_LETTERS = ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F", "P", "X")


@query(
    "numeric_clean",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CAST(l_quantity AS BIGINT) AS whole, CASE WHEN l_tax * 100 = floor(l_tax * 100) THEN CAST(l_tax * 100 AS BIGINT) END AS tax_whole,
  CASE WHEN l_extendedprice <= 50000 THEN l_extendedprice END AS price,
  CASE WHEN l_linenumber = 3 THEN NULL WHEN l_quantity > 40 THEN 40.0 ELSE l_quantity END AS clamped,
  nullif(l_discount, 0) AS discount, coalesce(nullif(l_returnflag, 'N'), 'missing') AS flag,
  CASE WHEN l_returnflag = 'A' THEN TRUE ELSE FALSE END AS is_a, CAST(l_linestatus = 'O' AS INT) AS open_int,
  CASE WHEN l_linenumber % 2 = 0 THEN TRUE END AS text_flag,
  CASE l_partkey % 15 WHEN 0 THEN 4.3 WHEN 1 THEN 4.0 WHEN 2 THEN 3.7 WHEN 3 THEN 3.3 WHEN 4 THEN 3.0 WHEN 5 THEN 2.7 WHEN 6 THEN 2.3
    WHEN 7 THEN 2.0 WHEN 8 THEN 1.7 WHEN 9 THEN 1.3 WHEN 10 THEN 1.0 WHEN 11 THEN 0.7 WHEN 12 THEN 0.0 END::DOUBLE AS points
FROM lineitem""",
)
def numeric_clean(spark, sf):
    """Numbers, clamps, defaults, flags and grade points."""
    li = raw(spark, sf, "lineitem")
    letter = F.element_at(F.array(*[F.lit(x) for x in _LETTERS]), (F.col("l_partkey") % 15 + 1).cast("int"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        X.whole_number("l_quantity").alias("whole"),
        X.whole_number(F.col("l_tax") * 100).alias("tax_whole"),
        X.number_or_null(F.col("l_extendedprice").cast("string"), "double", 50000).alias("price"),
        X.clamp_max(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")), 40.0).alias("clamped"),
        X.zero_to_null("l_discount").alias("discount"),
        X.null_to(F.nullif("l_returnflag", F.lit("N")), "missing").alias("flag"),
        X.code_flag(F.nullif("l_returnflag", F.lit("N")), "A").alias("is_a"),
        (F.col("l_linestatus") == "O").cast("int").alias("open_int"),
        X.as_flag(F.when(F.col("l_linenumber") % 2 == 0, "true").otherwise("maybe")).alias("text_flag"),
        X.letter_points(letter).alias("points"),
    )


@query(
    "text_clean",
    """SELECT page_id, url,
  nullif(regexp_extract(z, '^([0-9]{5})(?:[^0-9]|$)', 1), '') AS lead_zip,
  CASE WHEN length(n) < 5 THEN lpad(n, 5, '0') ELSE n END AS padded,
  CASE WHEN length(n) < 5 THEN '0' || n ELSE n END AS padded_one,
  CASE WHEN CAST(substring(n, 1, 5) AS INT) BETWEEN 501 AND 99950 THEN substring(n, 1, 5) END AS valid,
  CASE WHEN regexp_matches(g, '^[PAaBbCcDdFfIiWw][+-]?$') THEN g END AS grade,
  replace(replace(replace(url, '/', ''), '.', ''), '?', '') AS stripped, replace(url, 'http', '') AS no_scheme,
  list_contains(string_split(codes, ';'), 'ref=x') AS has_ref, coalesce(codes = 'page=2', FALSE) AS only_page
FROM (SELECT page_id, url, CAST((page_id * 7919) % 100000 AS VARCHAR) AS n,
  CAST((page_id * 7919) % 200000 AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '-12' ELSE '' END AS z,
  substring(upper(url), CAST(10 + page_id % 20 AS INT), 1) || CASE WHEN page_id % 3 = 0 THEN '+' ELSE '' END AS g,
  CASE WHEN contains(url, '?') THEN replace(split_part(url, '?', 2), '&', ';') END AS codes FROM pages)""",
)
def text_clean(spark, sf):
    """Postal codes, grades, character removal and code lists from urls."""
    p = raw(spark, sf, "pages")
    n = (F.col("page_id") * 7919 % 100000).cast("string")
    z = F.concat((F.col("page_id") * 7919 % 200000).cast("string"), F.when(F.col("page_id") % 2 == 0, "-12").otherwise(""))
    g = F.concat(F.upper("url").substr((10 + F.col("page_id") % 20).cast("int"), F.lit(1)), F.when(F.col("page_id") % 3 == 0, "+").otherwise(""))
    codes = F.when(F.contains("url", F.lit("?")), F.replace(F.split_part("url", F.lit("?"), F.lit(2)), F.lit("&"), F.lit(";")))
    return p.select(
        "page_id", "url",
        X.extract_or_null(z, X.LEADING_ZIP).alias("lead_zip"),
        X.pad_zip(n).alias("padded"),
        X.pad_zip(n, "one").alias("padded_one"),
        X.valid_zip(n).alias("valid"),
        X.matching_or_null(g).alias("grade"),
        X.strip_chars("url", "/.?").alias("stripped"),
        X.strip_text("url", "http").alias("no_scheme"),
        X.has_code(codes, "ref=x").alias("has_ref"),
        X.code_flag(codes, "page=2").alias("only_page"),
    )


@query(
    "term_dates",
    oracle(
        "course",
        """SELECT studentid, course_number, line, grade_available,
  CASE semester_taken WHEN 1 THEN make_date(CAST(year_taken - 1 AS INT), 12, 31) WHEN 2 THEN make_date(CAST(year_taken AS INT), 6, 15) ELSE make_date(CAST(year_taken AS INT), 8, 19) END AS term_end,
  CAST(date_part('year', age(CAST(grade_available AS TIMESTAMP), TIMESTAMP '1980-02-29')) AS INT) AS age,
  CASE WHEN was_ap THEN 'CERTIFICATE' WHEN line = 1 THEN 'BACHELOR SCIENCE' WHEN line = 2 THEN 'BACHELOR ARTS' END AS subject,
  was_honors OR line = 1 AS in_set,
  NOT coalesce(CASE WHEN line <> 4 THEN DATE '1998-06-01' END < grade_available, FALSE) AS is_first
FROM course""",
    ),
)
def term_dates(spark, sf):
    """Term ends, completed years, degree subjects, membership, first flags."""
    c = view(spark, sf, "course")
    code = F.element_at(F.array(F.lit("S1"), F.lit("Q3"), F.lit("s3")), F.col("semester_taken"))
    degree = F.when(F.col("was_ap"), "Certificate").otherwise("Bachelors")
    subject = F.when(F.col("line") == 1, "Life Sciences").when(F.col("line") == 2, "Social Sciences").otherwise("Other")
    group = F.when(F.col("was_honors"), "h").when(F.col("line") == 1, "one").otherwise("none")
    first = F.when(F.col("line") != 4, F.lit("1998-06-01").cast("date"))
    return c.select(
        "studentid", "course_number", "line", "grade_available",
        X.term_end(X.term_number(code), "year_taken").alias("term_end"),
        X.completed_years("grade_available", F.lit("1980-02-29").cast("date")).alias("age"),
        X.degree_subject(degree, subject, {"Life Sciences": "SCIENCE", "Social Sciences": "ARTS"}).alias("subject"),
        X.member(group, ["h", "one"]).alias("in_set"),
        X.not_before(first, "grade_available").alias("is_first"),
    )


@query(
    "not_in_keep_null",
    oracle(
        "contact",
        """SELECT studentid, contact_medium, max(counselor_id) AS counselor_id, count(*) AS n FROM contact
WHERE (contact_medium NOT IN ('click', 'view') OR contact_medium IS NULL) AND was_successful IS NOT NULL AND initiated_by_student = FALSE
GROUP BY ALL""",
    ),
)
def not_in_keep_null(spark, sf):
    """NOT IN that keeps null, equality filter, mandatory columns."""
    rows = view(spark, sf, "contact").filter(X.not_in_or_null("contact_medium", ["click", "view"]) & (F.col("initiated_by_student") == F.lit(False)))
    return R.mandatory(rows, ["was_successful"]).groupBy("studentid", "contact_medium").agg(
        F.max("counselor_id").alias("counselor_id"), F.count(F.lit(1)).alias("n")
    )


@query(
    "distinct_by_key",
    oracle(
        "contact",
        """SELECT studentid, contact_medium, event_id, counselor_id FROM contact
QUALIFY row_number() OVER (PARTITION BY studentid, contact_medium ORDER BY counselor_id, event_id) = 1""",
    ),
)
def distinct_by_key(spark, sf):
    """First row per key under a stated order, as an aggregate."""
    rows = view(spark, sf, "contact").select("studentid", "contact_medium", "event_id", "counselor_id")
    return R.distinct_by(rows, ["studentid", "contact_medium"], ["counselor_id", "event_id"])


@query(
    "mandatory_counts",
    oracle("contact", "SELECT count(*) AS rows_before, count(*) FILTER (contact_medium IS NOT NULL AND was_successful IS NOT NULL) AS rows_after FROM contact"),
)
def mandatory_counts(spark, sf):
    """Rows before and after the mandatory filter, in one pass."""
    return R.mandatory_counts(view(spark, sf, "contact"), ["contact_medium", "was_successful"])


@query(
    "null_report",
    oracle(
        "enrolment",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) / count(*), 3) * 100 AS percent FROM enrolment"""
            for c in ("enrollid", "collegeid", "end_date", "degree_subject", "major")
        ),
    ),
)
def null_report(spark, sf):
    """Null counts and percentages of all columns in one pass."""
    return R.null_report(view(spark, sf, "enrolment"), ["enrollid", "collegeid", "end_date", "degree_subject", "major"])


@query(
    "drop_empty_columns",
    "SELECT c_custkey, c_mktsegment, c_name AS renamed FROM customer",
)
def drop_empty_columns(spark, sf):
    """Typed empty columns added, names lowered, empty columns dropped again."""
    c = raw(spark, sf, "customer").select(F.col("c_custkey").alias("C_CUSTKEY"), F.col("c_mktsegment").alias("C_MKTSEGMENT"), F.col("c_name").alias("Renamed"))
    return R.drop_empty_columns(R.lower_names(R.add_empty_columns(c, {"zip": "string", "size": "int"})))


@query(
    "bounded_filter",
    f"""SELECT o_orderkey, 1998 + CAST(o_custkey % 4 AS BIGINT) - year(o_orderdate) AS gap FROM orders
WHERE o_orderdate >= DATE '{TRAIN_START}' AND o_orderdate < DATE '{SPLIT}'
  AND 1998 + o_custkey % 4 - year(o_orderdate) > 0 AND 1998 + o_custkey % 4 - year(o_orderdate) < 3
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def bounded_filter(spark, sf):
    """Half-open date bound, relative years, blocked ids by anti join."""
    o = raw(spark, sf, "orders").withColumn("gap", X.years_before(1998 + F.col("o_custkey") % 4, F.year("o_orderdate")))
    blocked = raw(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    inside = X.half_open("o_orderdate", TRAIN_START, SPLIT) & (F.col("gap") > 0) & (F.col("gap") < 3)
    return R.exclude_ids(o.filter(inside), "o_custkey", blocked).select("o_orderkey", "gap")


@query(
    "drop_flagged_rows",
    oracle("provider", "SELECT collegeid, avgnetprice, CAST(is4year AS INT) AS is4year FROM provider WHERE avgnetprice IS NOT NULL AND is4year IS NOT NULL"),
)
def drop_flagged_rows(spark, sf):
    """Rows coded as missing are dropped together with their indicators."""
    from cohortspark.operators.post import null_dummy

    p = view(spark, sf, "provider").select("collegeid", "avgnetprice", F.col("is4year").cast("int").alias("is4year"))
    return R.drop_flagged(null_dummy(null_dummy(p, "avgnetprice"), "is4year"))
