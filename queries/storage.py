"""Queries that write, overwrite, append and read back: CSV files, catalog tables, paths."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortspark.functions import cleaning as X
from cohortspark.operators import features as FT
from cohortspark.session import shared_folder, stored
from cohortspark.sources import readers, writers
from queries.base import oracle, query, raw, tables


def _scratch(spark, name: str) -> str:
    """A new folder name in the shared folder of the application; its files go when the application ends."""
    path = f"{shared_folder(spark)}/cohort-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


_ORDER_CSV = "o_orderkey BIGINT, o_custkey BIGINT, price DOUBLE, ordered DATE, note STRING"


@query(
    "csv_scan",
    """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS ordered, o_totalprice, o_orderpriority || ', ' || o_orderstatus AS note,
  CASE WHEN o_orderkey % 2 = 0 THEN 'lf' ELSE 'cr' END AS input FROM orders)
SELECT input, o_orderkey, o_custkey, o_totalprice AS price, ordered, note, CAST(NULL AS VARCHAR) AS raw FROM o WHERE o_orderkey % 97 <> 0
UNION ALL SELECT input, o_orderkey, o_custkey, NULL, ordered, note,
  o_orderkey || ',' || o_custkey || ',n/a,' || strftime(ordered, '%Y-%m-%d') || ',"' || note || '"' FROM o WHERE o_orderkey % 97 = 0""",
)
def csv_scan(spark, sf):
    """Named header CSVs with LF and CR line ends, declared types, quoted commas; rows that do not fit keep their text."""
    rows = raw(spark, sf, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey"),
        F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.col("o_orderdate").cast("date").alias("ordered"), F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("note"),
    )
    inputs = {}
    for name, rest, line_end in (("lf", 0, "\n"), ("cr", 1, "\r")):
        path = _scratch(spark, f"orders-{name}")
        rows.filter(F.col("o_orderkey") % 2 == rest).write.option("header", True).option("lineSep", line_end).csv(path)
        inputs[name] = (path, _ORDER_CSV)
    parts = []
    for name, df in readers.read_named(spark, inputs).items():
        good, bad = readers.split_corrupt(df)
        for part, text in ((good, F.lit(None).cast("string")), (bad, F.col(readers.CORRUPT))):
            parts.append(part.select(F.lit(name).alias("input"), "o_orderkey", "o_custkey", "price", "ordered", "note", text.alias("raw")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@query(
    "csv_quarantine_counts",
    """SELECT o_orderstatus AS status, count(*) FILTER (o_orderkey % 97 <> 0) AS fit, count(*) FILTER (o_orderkey % 97 = 0) AS quarantined
FROM orders GROUP BY 1""",
)
def csv_quarantine_counts(spark, sf):
    """A row is judged by all its columns, also when a query reads few of them."""
    path = _scratch(spark, "status")
    price = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    raw(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), price.alias("price")).write.option("header", True).csv(path)
    good, bad = readers.split_corrupt(readers.read_csv(spark, path, "status STRING, price DOUBLE"))
    counted = good.select("status", F.lit(1).alias("fit"), F.lit(0).alias("bad")).unionAll(bad.select("status", F.lit(0), F.lit(1)))
    return counted.groupBy("status").agg(F.sum("fit").alias("fit"), F.sum("bad").alias("quarantined"))


def _clean_customers(customers, nations):
    """Segment codes recoded, the nation by name, columns in no particular order."""
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        X.recode("c_mktsegment", {"BUILDING": "Construction", "HOUSEHOLD": None}).alias("segment"),
        F.col("c_acctbal").alias("balance"), F.col("n_name").alias("nation"), F.col("c_custkey").alias("studentid"), F.lit("unused").alias("extra"),
    )


@query(
    "table_lifecycle",
    """WITH clean AS (SELECT c_custkey, n_name AS nation, c_acctbal AS balance,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey),
people AS (SELECT * FROM clean WHERE c_custkey % 3 <> 0 UNION ALL SELECT * FROM clean WHERE c_custkey % 3 = 0)
SELECT nation, count(*) AS people, count(segment) AS with_segment, CAST(sum(CAST(round(balance * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(max(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END) AS BIGINT) AS last_appended,
  'studentid,nation,segment,balance' AS columns, FALSE AS existed, TRUE AS exists_then, TRUE AS refused, TRUE AS kept_when_refused, FALSE AS exists_after_drop
FROM people GROUP BY nation""",
)
def table_lifecycle(spark, sf):
    """A namespace of its own; create, refuse, append, overwrite, populate from a query, read by name, by path and by query, list, drop."""
    space = f"cohort_{uuid.uuid4().hex}"
    people, summary, path = f"{space}.people", f"{space}.per_nation", _scratch(spark, "per-nation")
    customers, nations = raw(spark, sf, "customer"), raw(spark, sf, "nation")
    contract = ["studentid", "nation", "segment", "balance"]
    writers.create_namespaces(spark, [space, space])
    try:
        existed = writers.table_exists(spark, people)
        first, rest = customers.filter("c_custkey % 3 <> 0"), customers.filter("c_custkey % 3 = 0")
        writers.clean_and_write({"customers": rest, "nations": nations}, _clean_customers, people, contract)
        writers.clean_and_write({"customers": first, "nations": nations}, _clean_customers, people, contract, overwrite=True)
        there, columns = writers.table_exists(spark, people), ",".join(writers.column_names(spark, people))
        before = readers.read_table(spark, people).count()
        try:
            writers.clean_and_write({"customers": rest, "nations": nations}, _clean_customers, people, contract)
            refused = False
        except AnalysisException:
            refused = True
        kept = readers.read_table(spark, people).count() == before
        writers.write_table(_clean_customers(rest, nations).select(*contract), people, "append")
        cents = "CAST(sum(CAST(round(balance * 100) AS BIGINT)) AS BIGINT)"
        for rows in ("studentid < 0", "TRUE"):  # the second run takes the place of the first
            text = f"""SELECT nation, count(*) AS people, count(segment) AS with_segment, {cents} AS cents,
                max(CASE WHEN studentid % 3 = 0 THEN studentid END) AS last_appended FROM {people} WHERE {rows} GROUP BY nation"""
            writers.create_from_query(spark, summary, text, overwrite=True)
        writers.write_table(readers.read_table(spark, summary), path)
        done = stored(readers.read_query(spark, "SELECT s.* FROM {s} s JOIN {by_path} p ON s.nation = p.nation AND s.people = p.people", s=readers.read_table(spark, summary), by_path=readers.read_table(spark, path)), "lifecycle")
        writers.drop_table(spark, people)
        writers.drop_table(spark, people)
        after = writers.table_exists(spark, people)
    finally:
        spark.sql(f"DROP SCHEMA IF EXISTS `{space}` CASCADE")
    seen = {"columns": columns, "existed": existed, "exists_then": there, "refused": refused, "kept_when_refused": kept, "exists_after_drop": after}
    return done.select("*", *[F.lit(v).alias(c) for c, v in seen.items()])


@query(
    "recent_school_history",
    """SELECT o_custkey AS studentid, max(n_name) AS name FROM (
  SELECT o_custkey, o_orderkey % 31 AS schoolid FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE date_trunc('month', o_orderdate) END DESC NULLS FIRST, o_orderkey % 31 DESC) = 1
) LEFT JOIN nation ON n_nationkey = schoolid GROUP BY 1""",
)
def recent_school_history(spark, sf):
    """Several school rows per student, with open ends, equal ends and schools without a name."""
    t = dict(tables(spark, sf))
    end = F.when(F.col("o_orderkey") % 41 != 0, F.date_trunc("month", "o_orderdate").cast("date")).alias("end_date")
    t["hs_enrollment"] = raw(spark, sf, "orders").select(F.col("o_custkey").alias("studentid"), (F.col("o_orderkey") % 31).alias("schoolid"), end)
    return FT.recent_school(t, FT.Bounds(), ["name"], FT.Options())


_NAMES = {"Call": "click", "In Person": "purchase", "Email": "signup", "Text": "view"}


@query(
    "contact_media_shares",
    oracle(
        "contact",
        "SELECT studentid, "
        + ", ".join(f"round(100.0 * count(*) FILTER (contact_medium = '{_NAMES.get(m, '-')}') / count(*), 10) AS \"{m}\"" for m in FT.CONTACT_MEDIA)
        + " FROM contact WHERE contact_medium IS NOT NULL AND contact_date < DATE '2024-01-20' GROUP BY 1",
    ),
)
def contact_media_shares(spark, sf):
    """One share per medium of the catalogue's list, contacts before the split only."""
    out = FT.contact_shares(tables(spark, sf), FT.Bounds(None, date(2024, 1, 20)), list(FT.CONTACT_MEDIA), FT.Options())
    return out.select("studentid", *[F.round(F.col(f"`{m}`"), 10).alias(m) for m in FT.CONTACT_MEDIA])
