"""Centroid clustering against plain integer k-means."""

import hashlib
import math
from collections import Counter

import numpy as np

from cohortspark.llm import centroids as ct

LONG = (1 << 63) - 1


def brute(rows, k=8, rounds=10, size=64):
    ok = [(i, x) for i, x in rows if x is not None and len(x) == size and all(a is not None and math.isfinite(a) for a in x)]
    exact = [(i, [math.floor(a * 1024) if abs(a) < 2**53 else int(a) * 1024 for a in x], x) for i, x in ok]
    name = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    cs = [v for _, v, _ in sorted(exact, key=lambda r: (name(r[0]), r[2]))[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign(v):
        return min((dist(v, c), i) for i, c in enumerate(cs))

    for _ in range(rounds):
        at = [assign(v)[1] for _, v, _ in exact]
        for i in range(len(cs)):
            mine = [v for (_, v, _), a in zip(exact, at) if a == i]
            if mine:
                cs[i] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *assign(v)) for i, v, _ in exact]
    part = Counter()
    for _, d, c in last:
        part[c] += min(d, LONG)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    total = min(sum(part.values()), LONG)
    return Counter((i, c, min(d, LONG), min(part[c], LONG), total, sha[c]) for i, d, c in last)


def run(spark, rows, folder, kind="float"):
    df = spark.createDataFrame([(i, x, 1, "y") for i, x in rows], f"vec_id long, embedding array<{kind}>, cluster int, `x.y` string")
    df.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return Counter(map(tuple, ct.op12_pca_centroids(spark, str(folder)).collect()))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(map(tuple, ct.op12_pca_centroids(spark, sf).collect())) == brute(rows)


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    f32 = lambda a: [float(np.float32(x)) for x in a]
    base = f32(rng.normal(size=64))
    rows = [(i, f32(rng.normal(size=64))) for i in range(60)] + [(100 + i, base) for i in range(30)] + [(7, base), (7, base), (None, base)]
    rows += [(200, None), (201, []), (202, base[:63]), (203, [None] + base[1:]), (204, [float("nan")] + base[1:]), (205, [float("inf")] + base[1:])]
    assert run(spark, rows, tmp_path / "a") == brute(rows)
    assert run(spark, [(i, base) for i in range(12)], tmp_path / "b") == brute([(i, base) for i in range(12)])  # all ties
    assert run(spark, rows[:3], tmp_path / "c") == brute(rows[:3])
    assert run(spark, [], tmp_path / "d") == run(spark, [(1, None)], tmp_path / "e") == Counter()


def test_large_components(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in rng.normal(size=64) * 10.0 ** (i % 20)]) for i in range(30)] + [(99, [1e300] + [0.0] * 63)]
    assert run(spark, rows, tmp_path, "double") == brute(rows)


def test_bound_never_hides_the_nearest():
    rng = np.random.default_rng(2)
    v = ct.scaled((rng.normal(size=(3000, 64)) * np.r_[np.full(8, 3.0), np.full(56, 0.3)]).ravel(), 64)
    c = v[:8].tolist()
    mean = v.mean(0)
    _, axes = np.linalg.eigh(np.cov(v.T))
    for frame in (ct.Frame(mean, axes[:, ::-1][:, :8]), ct.Frame(np.zeros(64), np.eye(64)[:, :8])):
        at, d, counted = ct.nearest(v, *frame.project(v), c, frame)
        full = ((v[:, None, :] - np.array(c)) ** 2).sum(2)
        assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
    at, d, counted = ct.nearest(v, *ct.Frame(mean, axes[:, ::-1][:, :8]).project(v), c, ct.Frame(mean, axes[:, ::-1][:, :8]))
    assert counted < 0.5 * full.size  # more than half of the distances are never computed
