"""Resharding and packing."""

import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortspark.llm.packing import length_cell, op4_length_buckets, optimal_boundaries, pack, word_counts
from cohortspark.llm.shards import min_cost_flow, op3_min_cost_resharding, plan_moves, reshard, rewrite_affected


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_feasible_and_cheapest(seed):
    rnd = random.Random(seed)
    n, m = rnd.randint(1, 3), rnd.randint(1, 3)
    supply = [rnd.randint(0, 4) for _ in range(n)]
    capacity = [-(-sum(supply) // m) + rnd.randint(0, 1) for _ in range(m)]
    cost = [[rnd.randint(0, 5) for _ in range(m)] for _ in range(n)]
    flow = min_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
    ways = [[w for w in itertools.product(range(s + 1), repeat=m) if sum(w) == s] for s in supply]
    best = min(
        sum(c * x for r, w in zip(cost, pick) for c, x in zip(r, w))
        for pick in itertools.product(*ways)
        if all(sum(w[j] for w in pick) <= capacity[j] for j in range(m))
    )
    assert sum(c * x for r, w in zip(cost, flow) for c, x in zip(r, w)) == best


def test_too_little_room():
    with pytest.raises(ValueError):
        min_cost_flow([5], [2, 2], [[0, 1]])


def test_moves_leave_home_what_fits():
    moves = plan_moves({0: 100, 1: 20}, 3)
    assert sum(b - a for i, a, b, j in moves if i != j) == 120 - 40 - 20


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_reshard_cases(odd_docs, no_docs, tmp_path, block_bytes):
    placed = reshard(odd_docs, F.pmod(F.col("doc_id"), F.lit(3)), shards=4, block_bytes=block_bytes)
    rows = rewrite_affected(placed, str(tmp_path / "new")).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert reshard(no_docs, F.lit(0)).collect() == []


def test_reshard_query(spark, texts):
    rows = op3_min_cost_resharding(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.text_crc32) for r in rows) == Counter((i, zlib.crc32((t or "").encode())) for i, t in texts.items())
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 2 * max(r.size for r in rows)


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_against_every_choice(seed):
    rnd = random.Random(seed)
    lengths = sorted(rnd.sample(range(60), rnd.randint(1, 9)))
    cells = [(x, c := rnd.randint(1, 9), x * c) for x in lengths]
    k = rnd.randint(1, 4)
    padding = lambda tops: sum(c * (min(t for t in tops if t >= x) - x) for x, c, _ in cells)
    best = min(padding([*pick, lengths[-1]]) for size in range(min(k, len(lengths))) for pick in itertools.combinations(lengths[:-1], size))
    got = optimal_boundaries(cells, k)
    assert len(got) <= k and padding(got) == best


def test_cells_keep_the_order_of_lengths(spark):
    rows = spark.range(0, 200_000, 37).select(F.col("id"), length_cell(F.col("id")).alias("cell")).orderBy("id").collect()
    cells = [r.cell for r in rows]
    assert cells == sorted(cells) and max(cells) < 4096 + 512 * 8 and all(r.cell == r.id for r in rows if r.id <= 4096)


def check_batches(rows, budget):
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, _), members in batches.items():
        assert len({r.pad_to for r in members}) == 1 and all(r.n_tokens <= r.pad_to for r in members)
        assert len(members) == 1 or len(members) * members[0].pad_to <= budget
        assert sorted(r.slot for r in members) == list(range(len(members)))
    for bucket in {r.bucket for r in rows}:
        ids = sorted(b for k, b in batches if k == bucket)
        assert ids == list(range(len(ids)))


def test_pack_cases(odd_docs, no_docs):
    counts = word_counts(odd_docs, "doc_id", "text")
    want = Counter((r.doc_id, len((r.text or "").encode().split())) for r in odd_docs.collect())
    rows = pack(counts, budget=300, buckets=4, block_rows=3).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    check_batches(rows, 300)
    assert pack(word_counts(no_docs, "doc_id", "text")).collect() == []


def test_pack_query(spark, texts):
    rows = op4_length_buckets(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len((t or "").encode().split())) for i, t in texts.items())
    check_batches(rows, 16384)
    cells = Counter(r.n_tokens for r in rows)
    tops = sorted({r.pad_to for r in rows})
    best = optimal_boundaries([(x, c, x * c) for x, c in sorted(cells.items())], 8)
    assert tops == best
