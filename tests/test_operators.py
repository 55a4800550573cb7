"""Literal edge cases of aggregates, ranks, joins, quality rules, postprocessing."""

from datetime import date

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortspark.operators import aggregates as A
from cohortspark.operators import joins as J
from cohortspark.operators import post as P
from cohortspark.operators import quality as Q
from cohortspark.operators import rows as R
from cohortspark.sources.writers import add_columns
from cohortspark.operators.ranks import ordered_totals, percent_rank_by, ranged

D = date.fromisoformat


def test_percent_rank_puts_null_last(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 2.0), ("c", None), ("d", 5.0), (None, 1.0), (None, 3.0)], "g string, v double")
    got = {(r.g, r.v): r.percent_rank for r in percent_rank_by(df, ["g"], "v").collect()}
    assert got == {("c", 1.0): 0.0, ("c", 2.0): 0.5, ("c", None): 1.0, ("d", 5.0): 0.0, (None, 1.0): 0.0, (None, 3.0): 1.0}


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_ordered_totals_equal_one_window(spark, parts):
    df = spark.range(5000).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).alias("v")
    )
    plain = lambda cells, group: cells.withColumns(
        {
            "n_before": F.coalesce(F.sum("n").over(W.partitionBy(*group, F.lit(1)).orderBy(F.col("v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "n_total": F.sum("n").over(W.partitionBy(*group, F.lit(1))),
        }
    )
    key = lambda d: sorted((str(r.g), r.v is None, r.v or 0, r.n, r.n_before, r.n_total) for r in d.collect())
    cells = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    assert key(ordered_totals(cells, ["g"], "v", ["n"], parts=parts)) == key(plain(cells, ["g"]))
    whole = df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0))
    assert key(ordered_totals(whole, [], "v", ["n"], parts=parts)) == key(plain(whole, []))


def test_a_hot_group_fills_all_range_partitions(spark):
    """One group with nearly all cells is spread evenly, whatever its values."""
    cells = spark.range(40_000).select(F.lit("hot").alias("g"), F.exp(F.col("id") / 1000).alias("v")).union(spark.sql("SELECT 'other', 1D"))
    sizes = [r["count"] for r in ranged(cells, ["g"], ["v"], 8).groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8


def test_caller_slices(spark):
    cells = spark.range(200).select(F.lit(1).alias("g"), (F.col("id") / 2).alias("v"), F.lit(1).alias("n"))
    got = ordered_totals(cells, ["g"], "v", ["n"], F.floor(F.col("v") / 10))
    assert got.filter(F.col("n_before") != F.col("v") * 2).count() == 0


def test_latest_prefers_null_date(spark):
    df = spark.createDataFrame([("k", D("2010-01-01"), "old"), ("k", None, "open"), ("m", D("2010-01-01"), "a"), ("m", D("2010-01-01"), "b")], "k string, d date, v string")
    pick = lambda nulls: {r.k: r.v for r in A.latest_by_key(df, ["k"], "d", ["v"], ["v"], nulls).collect()}
    assert pick("first") == {"k": "open", "m": "b"}
    assert pick("last") == {"k": "old", "m": "b"}


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "b"), ("h", "b"), ("h", "a"), ("n", None)], "g string, v string")
    assert {r.g: r["mode"] for r in A.mode_by(df, ["g"], "v").collect()} == {"g": "a", "h": "b"}


def test_guarded_average(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (2, 0, 3.0), (2, 0, 2.0), (3, 0, None), (4, 1, 3.0)], "s int, gap int, v double")
    got = {r.s: r.a for r in df.groupBy("s").agg(A.only_if_count(F.col("v"), F.col("gap") == 0, 1).alias("a")).collect()}
    assert got == {1: 3.0, 2: None, 3: None, 4: None}


def test_weighted_ratio_keeps_hours_of_ungraded_rows(spark):
    df = spark.createDataFrame([(4.0, 1.0), (None, 1.0)], "p double, h double")
    row = df.agg(A.weighted_ratio(F.col("p"), F.col("h")).alias("a"), A.weighted_ratio(F.col("p"), F.col("h"), True).alias("b")).first()
    assert (row.a, row.b) == (2.0, 4.0)


def test_contact_share_ignores_null(spark):
    df = spark.createDataFrame([(1, "Call")] * 3 + [(1, "Email")] + [(1, None)] * 2 + [(2, None)], "s int, m string")
    rows = A.pivot_shares(df, "s", "m", ["Call", "Email"]).collect()
    assert [(r.s, r.Call, r.Email) for r in rows] == [(1, 75.0, 25.0)]


def test_counts_that_find_nothing_are_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (2, None)], "s int, f boolean")
    got = {r.s: (r.n, r.t) for r in df.groupBy("s").agg(A.count_where(F.col("f")).alias("n"), A.sum_flag(F.col("f")).alias("t")).collect()}
    assert got == {1: (1, 1), 2: (None, 0)}


def test_nested_average_counts_existing_cells_only(spark):
    df = spark.createDataFrame([(1, 0, "t"), (1, 0, "t"), (1, 1, "t"), (1, 1, "u"), (2, 5, "t")], "s int, y int, t string")
    wanted = {"t03": (F.col("t") == "t") & F.col("y").isin(0, 1), "all": F.lit(True)}
    got = {r.s: (r.t03, r["all"]) for r in A.nested_average(df, "s", ["y", "t"], wanted).collect()}
    assert got == {1: (1.5, 4 / 3), 2: (None, 1.0)}


def test_repair_by_mode(spark):
    rows = [
        (1, "o1", "one", "x"), (2, "o1", "one", "y"), (3, "o2", "one", "x"), (4, "o3", None, "x"),
        (5, "o4", "many", "z"), (6, "o4", "many", "BATCH"), (7, "o5", "many", "BATCH"), (8, "o6", "many", None),
    ]
    df = spark.createDataFrame(rows, "i int, o string, g string, c string")
    got = {r.i: r.out for r in A.repair_by_mode(df, "o", "g", "c", ["BATCH"], ["many"], "out").collect()}
    assert got == {1: "x", 2: "x", 3: "x", 4: None, 5: "z", 6: "z", 7: "z", 8: None}


def test_ids_are_dense_and_repeatable(spark):
    a = spark.createDataFrame([(f"a{i}", None) for i in range(50)] + [("a1", None)], "x string, y string")
    b = spark.createDataFrame([(f"b{i}",) for i in range(30)], "y string")
    ids = J.assign_ids([a, b], "id", buckets=7)
    first = sorted((r.id, r.x, r.y) for r in ids.collect())
    again = sorted((r.id, r.x, r.y) for r in J.assign_ids([b, a.repartition(5)], "id", buckets=7).select("id", "x", "y").collect())
    assert [i for i, *_ in first] == list(range(1, 81))
    assert {(x, y) for _, x, y in first} == {(x, y) for _, x, y in again}


def test_null_key_never_matches(spark):
    ids = spark.createDataFrame([(1, "a"), (2, None)], "id long, ext string")
    df = spark.createDataFrame([(10, "a"), (11, None), (12, "zz")], "v int, k string")
    assert sorted((r.v, r.id) for r in J.resolve_id(df, ids, "k", "ext", "id").collect()) == [(10, 1), (11, None), (12, None)]
    assert [(r.v, r.id) for r in J.resolve_id(df, ids, "k", "ext", "id", "inner").collect()] == [(10, 1)]


def test_distinct_union_removes_duplicates_inside_a_partner(spark):
    ids = spark.createDataFrame([(1, "a")], "sid long, ext string")
    part = J.PartnerSource(spark.createDataFrame([("a", 5), ("a", 5)], "k string, v int"), [J.IdLookup(ids, "k", "ext", "sid")])
    assert [tuple(r) for r in J.integrate([part], ["sid"], ["v"]).collect()] == [(1, 5)]


def test_check_passes_on_null_and_reports_key(spark):
    df = spark.createDataFrame([(1, "A", 5), (2, "Z", None), (3, None, 50)], "id int, c string, v int")
    got = {(r.key, r.rule, r.value) for r in Q.row_violations(df, "t", ["id"], [Q.one_of("c", ["A"]), Q.in_range("v", 0, 10), Q.not_null("c")], D("2020-01-01")).collect()}
    assert got == {("2", "c: allowed values", "Z"), ("3", "v: range 0..10", "50"), ("3", "c: not null", None)}


def test_unique_exempts_null_but_primary_does_not(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert [r.key for r in Q.unique_violations(df, "t", ["k"]).collect()] == ["1"]
    assert sorted(r.key for r in Q.unique_violations(df, "t", ["k"], True).collect()) == ["", "1"]


def test_foreign_key_and_fan_out(spark):
    df = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, p int")
    parent = spark.createDataFrame([(10,), (12,)], "pid int")
    assert [r.key for r in Q.fk_violations(df, "t", ["id"], "p", parent, "pid").collect()] == ["2"]
    assert Q.fan_out(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").collect()[0].rows == 2


def test_contract_rules(spark):
    from cohortspark.contracts import CONTRACTS

    act = spark.createDataFrame(
        [(1, D("2010-01-01"), "ACT", "Fall", 21, 20, 21, 22, 22, None, False), (2, D("2030-01-01"), "SAT", "Fall", 30, 20, 20, 20, 20, 40, None)],
        CONTRACTS["acttests"].common_schema(),
    )
    got = {r.rule.split(":")[0] for r in CONTRACTS["acttests"].violations(act, ["studentid"], D("2015-01-01")).collect()}
    assert got == {"date", "test_level", "score_composite", "score_writing", "onlyhighestavailable"}
    assert len(CONTRACTS) == 20


def test_one_hot_and_null_dummy_are_learned_from_train(spark):
    train = spark.createDataFrame([("a", 1.0, True), ("b", None, None), (None, 2.0, False)], "k string, v double, f boolean")
    test = spark.createDataFrame([("a", None, None), ("z", 3.0, True)], "k string, v double, f boolean")
    plan = P.learn(train, {"k": P.ONE_HOT, "v": P.NULL_DUMMY, "f": P.NULL_DUMMY}, test)
    assert plan.apply(train).columns == ["k_a", "v", "v_isnull", "f", "f_isnull"]
    assert [tuple(r) for r in plan.apply(test).collect()] == [(1, 0.0, 1, False, 1), (0, 3.0, 0, True, 0)]
    assert plan.outputs("k") == ["k_a"] and plan.outputs("v") == ["v_isnull", "v"]
    assert P.null_dummy(train.na.drop(), "v").columns == ["k", "v", "f"]


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (10.0,)], "v double")
    assert sorted(r.v for r in P.fill_median(df, ["v"]).collect()) == [1.0, 3.0, 3.0, 10.0]


def test_null_policy(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert R.apply_null_policy(df, "lax").count() == 1
    with pytest.raises(R.NullRowsError):
        R.apply_null_policy(df, "strict")
    with pytest.raises(ValueError):
        R.apply_null_policy(df, "other")


def test_blocked_ids_keep_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in R.exclude_ids(df, "k", ["a"]).collect()] == ["b", None]
    blocked = spark.createDataFrame([("a",)], "x string")
    assert {r.k for r in R.exclude_ids(df, "k", blocked).collect()} == {"b", None}


def test_one_hot_of_any_width(spark, monkeypatch):
    train = spark.range(30_000).select(F.concat(F.lit("c"), F.col("id") % 20_000).alias("a b"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"), F.col("id"))
    test = spark.createDataFrame([("c7", 1, 1), ("new", None, 2), (None, 2, 3)], "`a b` string, k long, id long")
    coded, held, widths = P.sparse_one_hot(train, ["a b", "k"], test)
    assert widths == [20_000, 3]
    rows = coded.select("id", "k", "one_hot").limit(200).collect()
    assert all(r.one_hot.size == 20_003 and r.one_hot.numNonzeros() == (1 if r.k is None else 2) for r in rows)
    assert {r.id: r.one_hot.numNonzeros() for r in held.collect()} == {1: 2, 2: 0, 3: 1}
    at = P.category_positions(train, "a b")
    same = P.category_positions(train.repartition(3).orderBy("id"), "a b")
    stats = at.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(stats) == (0, 19_999, 20_000) and at.exceptAll(same).count() == 0
    with pytest.raises(ValueError, match="sparse_one_hot"):
        P.learn(train, {"a b": P.ONE_HOT})
    model = LogisticRegression(featuresCol="one_hot", labelCol="y", maxIter=3).fit(coded.withColumn("y", (F.col("k") == 1).cast("double")).na.fill(0.0, ["y"]))
    assert model.numFeatures == 20_003


def test_repeated_updates_do_not_multiply_rows(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "c", 0)], "id int, v string, w int")
    updates = spark.createDataFrame([(2, 5), (2, 7), (3, 9)], "id int, w int")
    assert sorted(map(tuple, add_columns(target, updates, "id", ["w"]).collect())) == [(1, "a", 0), (2, "b", 7), (2, "c", 7)]


def test_integrate_shuffles_rows_of_unknown_or_shared_ids_only(spark):
    """Own, shared and unknown ids, copies inside and across partners: the distinct union, whatever way rows take."""
    import itertools

    ids = spark.createDataFrame([(1, "p", None), (2, "q", None), (3, "r", "x"), (4, None, "y"), (5, None, "z")], "studentid long, a_id string, b_id string")
    a = spark.createDataFrame([*itertools.product(("p", "q", "r", "none", "no", None), (7, 8, None))] * 2, "ak string, v int")
    b = spark.createDataFrame([*itertools.product(("x", "y", "z", "none", None), (7, 9, None))] * 3, "bk string, v int")
    for how in ("left", "inner"):
        parts = [J.PartnerSource(a, [J.IdLookup(ids, "ak", "a_id", "studentid", how)]), J.PartnerSource(b, [J.IdLookup(ids, "bk", "b_id", "studentid", how)])]
        got = [tuple(r) for r in J.integrate(parts, ["studentid"], ["v"]).collect()]
        at = {**{k: n for n, k, _ in ids.collect() if k}, **{k: n for n, _, k in ids.collect() if k}}
        want = {(at.get(k), v) for k, v in [*a.collect(), *b.collect()] if how == "left" or k in at}
        assert len(got) == len(set(got)) and set(got) == want
    assert {r.studentid: r["__own"] for r in J._reached_once(parts, "studentid").collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_integrate_aggregates_all_rows_of_a_key_once(spark):
    """Rows of unknown or shared ids are told apart before an aggregate, so that all rows are held in one reading only."""
    ids = spark.createDataFrame([(1, "p", None), (2, "q", None), (3, "r", "x"), (4, None, "y")], "studentid long, a_id string, b_id string")
    a = spark.createDataFrame([("p", 1), ("p", 1), ("r", 1), ("r", 1), ("none", 1), (None, 1), (None, None)] * 2, "ak string, v int")
    b = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("none", 1), (None, 3)] * 2, "bk string, v int")
    known = {(1, 1), (3, 1), (3, 2), (4, 1)}
    for how, want in (("left", known | {(None, 1), (None, None), (None, 3)}), ("inner", known)):
        parts = [J.PartnerSource(a, [J.IdLookup(ids, "ak", "a_id", "studentid", how)]), J.PartnerSource(b, [J.IdLookup(ids, "bk", "b_id", "studentid", how)])]
        out = J.integrate(parts, ["studentid"], ["v"])
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) == want and len(rows) == len(want)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [__key#") == len(parts)


def test_integrated_rows_bring_the_names_of_their_ids(spark):
    """Names come where ids are found, also with shared and unknown ids; no join follows the distinct union."""
    from queries.catalogue import QUERIES

    ids = spark.createDataFrame([(1, "p", None, "P"), (2, "q", None, None), (3, "r", "x", "R"), (4, None, "y", "Y")], "studentid long, a_id string, b_id string, name string")
    a = spark.createDataFrame([(k, v) for k in ("p", "q", "r", "none", None) for v in (7, None)] * 2, "ak string, v int")
    b = spark.createDataFrame([(k, v) for k in ("x", "y", "none", None) for v in (7, 9)] * 2, "bk string, v int")
    parts = [J.PartnerSource(a, [J.IdLookup(ids, "ak", "a_id", "studentid", names=["name"])]), J.PartnerSource(b, [J.IdLookup(ids, "bk", "b_id", "studentid", names=["name"])])]
    rows = [tuple(r) for r in J.integrate(parts, ["studentid"], ["v"]).select("studentid", "v", "name").collect()]
    plain = [tuple(r) for r in J.integrate([J.PartnerSource(p.frame, [J.IdLookup(ids, lk.on, lk.id_col, "studentid") for lk in p.lookups]) for p in parts], ["studentid"], ["v"]).collect()]
    names = {1: "P", 3: "R", 4: "Y"}
    assert set(rows) == {(i, v, names.get(i)) for i, v in plain} and len(rows) == len(set(rows)) == len(plain)
    for table in ("courses", "acttests", "attendance"):
        node = QUERIES[f"integrated_{table}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        while node.children().size() == 1:
            node = node.children().head()
        assert node.nodeName() == "Union"


def test_a_task_reads_a_bounded_share_of_a_file(spark, tmp_path):
    """Not the 128 MB of Spark where the session names no size; a size that it names stays."""
    from cohortspark import session

    key = "spark.sql.files.maxPartitionBytes"
    other = spark.newSession()
    session.tune(other)
    assert other.conf.get(key) == session.READ_SIZE
    spark.range(0, 24_000_000, 1, 1).select(F.xxhash64("id").alias("h")).write.option("parquet.block.size", 8 << 20).parquet(str(tmp_path / "t"))
    # 190 MB, as if for one core
    other.conf.set("spark.sql.files.minPartitionNum", "1")
    assert other.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions() >= 5
    named = spark.newSession()
    named.conf.set(key, "16m")
    assert session.tune(named).conf.get(key) == "16m"


def test_first_partitions_and_freed_shuffles(spark):
    """A task's share does not follow the session's number of partitions; a stored table's shuffles are gone."""
    from cohortspark import session

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert int(session.tune(spark).conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == session.FIRST_PARTITIONS > 3
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        assert int(session.tune(spark).conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        session.tune(spark)
    held = spark.conf.get(session._CLEANUP)
    kept = session.stored(spark.range(50).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert kept.count() == 7 and spark.conf.get(session._CLEANUP) == held


def test_postprocess_reads_the_parts_once(spark):
    """Train and test are made once, however many jobs learn from them; parts of other columns are encoded too."""
    from cohortspark.operators.matrix import postprocess

    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    ddl = "enrollid long, ethnicity string, avgnetprice double"
    train = spark.createDataFrame([(1, "x", None), (2, "y", 2.0), (2, "y", 2.0), (3, None, 4.0)], ddl).mapInArrow(seen, ddl)
    test = spark.createDataFrame([(4, "y", None), (5, "z", 1.0), (5, "z", 1.0)], ddl).mapInArrow(seen, ddl)
    a, b, _ = postprocess(train, test, ["StudentEthnicity", "avgNetPrice"])
    assert sorted(map(tuple, a.collect())) == [(1, 0, 0.0, 1), (2, 1, 2.0, 0), (2, 1, 2.0, 0), (3, 0, 4.0, 0)]
    assert sorted(map(tuple, b.collect())) == [(4, 1, 0.0, 1), (5, 0, 1.0, 0), (5, 0, 1.0, 0)]
    assert reads.value == 7
    other = postprocess(train, test.withColumn("more", F.lit(1)), ["StudentEthnicity", "avgNetPrice"])[1]
    assert other.columns == [*b.columns, "more"] and other.count() == 3


def test_advisory_size_unless_the_session_names_one(spark):
    """What a task reads, and so what it holds, is halved; a session's own size stays."""
    from cohortspark import session

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        spark.conf.unset(key)
        assert session.tune(spark).conf.get(key) == session.ADVISORY_SIZE == "32m"
        spark.conf.set(key, "8m")
        assert session.tune(spark).conf.get(key) == "8m"
    finally:
        spark.conf.unset(key)
        session.tune(spark)
