"""Exact integer k-means with PCA-rotated filtering (operator 12).

Each vector is stored with its first coordinates in a rotated frame (the leading
principal axes) and the norm of the rest.  For a centroid rotated alike,

    |leading difference|^2 + (difference of the residual norms)^2

never exceeds the squared distance.  A centroid whose bound, less a margin for
rounding, exceeds the distance to the most promising centroid is left out; the
others are compared in integers, so the filter saves work and decides nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import col, table, written

#: Leading rotated coordinates that are stored.
LEADING = 8
#: Components below this size are compared in 64-bit integers, larger ones in Python's.
SMALL = 1 << 27
LONG = (1 << 63) - 1
#: Partial sums of tasks meet in so many groups before the driver adds those up.
FAN = 32


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, bad), F.lit(False))


def scaled(flat: np.ndarray, size: int) -> np.ndarray:
    """floor(1024 x) as rows of whole numbers: int64, or Python integers where a component is large."""
    x = flat.astype(np.float64).reshape(-1, size)
    with np.errstate(over="ignore"):
        v = np.floor(x * 1024)
    if not v.size or np.abs(v).max() < SMALL:
        return v.astype(np.int64)
    whole = lambda a: int(a) * 1024 if abs(a) >= 2**53 else math.floor(a * 1024)  # beyond 2^53 every double is whole
    return np.array([[whole(a) for a in row] for row in x.tolist()], object)


@dataclass
class Frame:
    """Mean and leading principal axes; how well they fit steers only how much is filtered."""

    mean: np.ndarray
    axes: np.ndarray

    def project(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms; not-a-number for rows of large integers, which are never filtered."""
        if v.dtype == object:
            return np.full((len(v), self.axes.shape[1]), np.nan), np.full(len(v), np.nan)
        shifted = v - self.mean
        lead = shifted @ self.axes
        return lead, np.sqrt(np.maximum((shifted * shifted).sum(1) - (lead * lead).sum(1), 0))


def _batches(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def fit_frame(vectors: DataFrame, size: int, leading: int = LEADING) -> Frame:
    """Principal axes from the sums and products of all vectors without large components.

    A task gives one row of sums, ``FAN`` groups add those, and the driver gets
    ``FAN`` rows of size x size numbers.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, part = 0, np.zeros(size), np.zeros((size, size)), 0
        for b in batches:
            part, v = b.column("part")[0].as_py() if b.num_rows else part, scaled(_batches(b, "x"), size)
            if v.dtype != object and len(v):
                v = v.astype(np.float64)
                n, s, q = n + len(v), s + v.sum(0), q + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([part % FAN]), pa.array([np.r_[n, s, q.ravel()].tolist()])], names=["slot", "sums"])

    def add(t: pa.Table) -> pa.Table:
        got = np.array(t.column("sums").to_pylist()).sum(0)
        return pa.table({"sums": [got.tolist()]})

    rows = vectors.select("x", F.spark_partition_id().cast("long").alias("part")).mapInArrow(sums, "slot long, sums array<double>")
    got = [r["sums"] for r in rows.groupBy("slot").applyInArrow(add, "sums array<double>").collect()]
    total = np.array(got or [[0.0] * (1 + size + size * size)]).sum(0)
    n, s, q = total[0], total[1 : size + 1], total[size + 1 :].reshape(size, size)
    if n == 0:
        return Frame(np.zeros(size), np.eye(size)[:, :leading])
    mean = s / n
    _, axes = np.linalg.eigh(q / n - np.outer(mean, mean))
    return Frame(mean, axes[:, ::-1][:, :leading].copy())


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: list[list[int]], frame: Frame) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row, ties to the smaller number, and how many distances were computed."""
    large = v.dtype == object or any(abs(x) >= SMALL for c in centroids for x in c)
    c = np.array(centroids, object if large else np.int64)
    v = v.astype(object) if large else v
    if large:
        d = np.stack([((v - x) ** 2).sum(1) for x in c], 1)
        at = np.array([min(range(len(c)), key=lambda k: (row[k], k)) for row in d], np.int64)
        return at, d[np.arange(len(v)), at], d.size
    c_lead, c_rest = frame.project(c)
    bound = ((lead[:, None, :] - c_lead) ** 2).sum(2) + (rest[:, None] - c_rest) ** 2
    # rounding of the stored and computed coordinates is far below this share of the norms
    norms = ((lead * lead).sum(1) + rest * rest)[:, None] + (c_lead * c_lead).sum(1) + c_rest * c_rest
    bound = np.nan_to_num(bound - 1e-9 * norms - 1e-3, nan=-np.inf)
    at = bound.argmin(1)
    best, counted = np.empty(len(v), np.int64), len(v)
    exact = lambda rows, k: ((v[rows] - c[k]) ** 2).sum(1)
    for k in range(len(c)):
        rows = np.flatnonzero(at == k)
        best[rows] = exact(rows, k)
    first = at.copy()
    for k in range(len(c)):
        rows = np.flatnonzero((bound[:, k] <= best) & (first != k))
        d = exact(rows, k)
        counted += len(rows)
        won = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
        best[rows[won]], at[rows[won]] = d[won], k
    return at, best, counted


def _read(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return scaled(_batches(b, "x"), size), _batches(b, "lead").reshape(b.num_rows, -1), b.column("rest").to_numpy(zero_copy_only=False)


def new_centroids(stored: DataFrame, frame: Frame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every vector to its nearest centroid, then floor(sum / count) of each non-empty cluster."""
    k, size = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, part = [0] * k, [[0] * size for _ in range(k)], 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            v, lead, rest = _read(b, size)
            at, _, _ = nearest(v, lead, rest, centroids, frame)
            for i in range(k):
                mine = v[at == i]
                count[i] += len(mine)
                total[i] = [a + int(x) for a, x in zip(total[i], mine.sum(0))] if len(mine) else total[i]
        flat = [str(x) for x in [*count, *(x for t in total for x in t)]]
        yield pa.RecordBatch.from_arrays([pa.array([part % FAN]), pa.array([flat])], names=["slot", "sums"])

    def add(t: pa.Table) -> pa.Table:
        got = [sum(map(int, column)) for column in zip(*t.column("sums").to_pylist())]
        return pa.table({"sums": [[str(x) for x in got]]})

    rows = stored.select("x", "lead", "rest", F.spark_partition_id().cast("long").alias("part")).mapInArrow(sums, "slot long, sums array<string>")
    got = rows.groupBy("slot").applyInArrow(add, "sums array<string>").collect()
    flat = [sum(map(int, column)) for column in zip(*(r["sums"] for r in got))]
    mean = lambda i: [x // flat[i] for x in flat[k + i * size : k + (i + 1) * size]]
    return [mean(i) if flat[i] else c for i, c in enumerate(centroids)]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable vector, and the final centroids.

    The first centroids are the vectors with the smallest sha256 of ``seed:id``.
    Vectors with their rotated coordinates and the result are tables of the shared
    folder; a round sends k x size numbers down and ``FAN`` rows of as many up.
    """
    kept = vectors.filter(usable(col(vector_col), size)).select(col(id_col).alias("vec_id"), col(vector_col).alias("x"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    seeds = kept.orderBy(name.asc_nulls_last(), "x").limit(k).collect()
    frame = fit_frame(kept, size)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, rest = frame.project(scaled(_batches(b, "x"), size))
            leads = pa.ListArray.from_arrays(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32), lead.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, leads, pa.array(rest)], names=["vec_id", "x", "lead", "rest"])

    stored = written(kept.mapInArrow(project, f"vec_id {kinds['vec_id']}, x {kinds['x']}, lead array<double>, rest double"), "vectors")
    centroids = [list(map(int, scaled(np.array(r["x"], np.float64), size)[0])) for r in seeds]
    for _ in range(rounds if centroids else 0):
        centroids = new_centroids(stored, frame, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d, _ = nearest(*_read(b, size), centroids, frame)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array([min(int(x), LONG) for x in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = stored.mapInArrow(assign, f"vec_id {kinds['vec_id']}, cluster int, distance long")
    return (written(placed, "clusters") if centroids else placed), centroids


def op12_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the table ``embeddings``.

    Cases: null vectors and vectors of another length or with a null or not finite
    component are left out; a null id stays, ranks last for the first centroids;
    rows that share an id are vectors of their own, of equal hash in the order of
    their components; fewer than 8 vectors give as many centroids, equal ones leave
    the later cluster empty; distances and sums beyond a long are given as the
    largest long, although compared and added exactly; no vectors give no rows.
    """
    placed, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = [min(sums.get(i, 0), LONG) for i in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values or [None]]), F.col("cluster") + 1)
    return placed.select(
        "vec_id", "cluster", "distance", pick(inertia, "long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LONG)).cast("long").alias("inertia"), pick(shas, "string").alias("centroid_sha256"),
    )
