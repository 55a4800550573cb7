"""Contract violations of large tables: what is made per row, looked up and computed twice."""

from __future__ import annotations

from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from cohortspark.operators import joins as J
from cohortspark.operators import quality as Q


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_told_without_a_list_per_row(spark):
    df = spark.createDataFrame([(1, "A", 5, 1), (2, "Z", None, 2), (3, None, 50, None), (3, None, 50, None), (None, "Q", -1, 3)], "id int, c string, v int, w int")
    checks = [Q.one_of("c", ["A"]), Q.in_range("v", 0, 10), Q.not_null("c"), Q.satisfies("w", "small", "w < 3 AND v > 0")]
    out = Q.row_violations(df, "t", ["id", "w"], checks, date(2020, 1, 1))
    got = Counter((r.table, r.rule, r.key, r.value) for r in out.collect())
    assert got == {
        ("t", "c: allowed values", "2|2", "Z"): 1, ("t", "v: range 0..10", "3", "50"): 2, ("t", "c: not null", "3", None): 2,
        ("t", "c: allowed values", "3", "Q"): 1, ("t", "v: range 0..10", "3", "-1"): 1, ("t", "w: small", "3", "3"): 1,
    }
    counts = out.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))
    # neither filtered lists nor, where rules are counted, texts of keys and values
    assert "lambda" not in _plan(counts) and "concat_ws" not in _plan(counts)


def test_probe_looks_up_values_not_rows(spark):
    a = spark.createDataFrame([(1, 10, 7), (2, 11, 7), (2, 11, 7), (3, None, 8), (None, 10, None)], "id int, p int, q int")
    b = spark.createDataFrame([("x", "11"), ("y", "12"), ("z", None), ("x", "11")], "id string, r string")
    parent = spark.createDataFrame([(10,), (12,), (12,), (None,)], "pid int")
    refs = [Q.references(a, "a", ["id"], ["p", "q"]), Q.references(b, "b", ["id"], ["r"])]
    out = Q.probe(refs, parent, "pid")
    got = Counter((r.table, r.rule, r.key, r.value) for r in out.collect())
    assert got == {
        ("a", "p: references", "2", "11"): 2, ("a", "q: references", "1", "7"): 1, ("a", "q: references", "2", "7"): 2,
        ("a", "q: references", "3", "8"): 1, ("b", "r: references", "x", "11"): 2,
    }
    # rows are held against the few unknown values, not against the parent
    assert "LeftSemi" in _plan(out) and "LeftAnti" not in _plan(out)
    assert Q.probe(refs, parent.limit(0), "pid").count() == 11


def test_rows_that_get_ids_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(1000, numPartitions=4).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    once = J.assign_ids([rows.mapInArrow(count, "k long, v long")], "i", once=True)
    got = sorted(map(tuple, once.collect()))
    assert seen.value == 1000
    assert got == sorted(map(tuple, J.assign_ids([rows], "i").collect())) and [r[0] for r in got] == list(range(1, 1001))
