"""Mixing: targets against resharing in rounds, the query against SQL and its laws."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixing
from tests import compare as c


def reshared(sizes, most=3):
    """Targets by resharing the excess in rounds, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(most * sizes[s])
        left, free = left - sum(target[s] for s in over), [s for s in free if s not in over]
    return target


def test_targets_against_rounds(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 30):
        sizes = {(f"s{i:02}" if i else None): rng.choice((0, 1, 10, 500, 10**rng.randrange(12))) for i in range(n)}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == {s: pytest.approx(t, rel=1e-12) for s, t in reshared(sizes).items()}


def check(rows, sources):
    """rows: (doc_id, size, source_size, target, taken) in step with ``sources``."""
    total, taken = Counter(), Counter()
    for r, s in zip(rows, sources):
        assert 0 <= r[4] <= 3 * r[1]
        total[s] += r[1]
        taken[s] += r[4]
    want = reshared(dict(total))
    for r, s in zip(rows, sources):
        assert r[2] == total[s] and r[3] == pytest.approx(want[s])
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.5


def test_query_against_sql(spark, monkeypatch):
    monkeypatch.setitem(c.QUERIES, "op13", mixing.op13_weighted_mix)
    monkeypatch.setitem(c.ORACLES, "op13", mixing.ORACLE)
    for sf in ("0.001", "0.01"):
        assert c.compare(spark, "op13", f"/root/testdata/sf{sf}") is None


def test_laws_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    rows = [tuple(r) for r in mixing.mix(docs).drop("source", "epochs").collect()]
    check(rows, [source[r[0]] for r in rows])
    again = mixing.mix(docs.repartition(13)).drop("source", "epochs").collect()
    assert Counter(map(tuple, again)) == Counter(rows)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.select("doc_id", "text").collect()}
    assert all(r[1] == words[r[0]] for r in rows)


def test_better_documents_come_first(spark):
    """Half of a source is taken; documents of ten times the quality are taken far more often."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("q"))
    small = docs.filter("doc_id < 1500").withColumn("source", F.lit("t"))
    rows = mixing.mix(docs.union(small), quality=F.col("q")).filter("source = 's'").withColumn("good", F.col("doc_id") % 2 == 0)
    share = {r.good: r.a for r in rows.groupBy("good").agg((F.sum("taken") / F.sum("size")).alias("a")).collect()}
    assert share[True] > 2 * share[False] > 0


def test_odd_documents(spark, odd_docs, no_docs):
    """Repeated rows of one source in a third of the table, null sources and ids, sizes of 0, names that clash."""
    more = spark.createDataFrame([(9, "one two", "hot")] * 40 + [(20 + i, "w " * (i % 5), ["a", "b", "", None][i % 4]) for i in range(60)], "doc_id long, text string, source string")
    docs = odd_docs.withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).unionByName(more, allowMissingColumns=True).repartition(4)
    rows = mixing.mix(docs).collect()
    check([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows], [r.source for r in rows])
    assert len(rows) == docs.count()
    assert mixing.mix(no_docs).collect() == []
    empty = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in empty) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
