"""Folds and bootstrap intervals, repeatable by row content."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.operators.metrics import score_cells
from cohortspark.operators.ranks import ranged

# replicate weights are drawn for this many cells at a time inside a task
_CELL_CHUNK = 1024


def permutation_position(df: DataFrame, key: str, seed: int = 0, out: str = "position") -> DataFrame:
    """0-based position of each row in a pseudo-random permutation keyed by row id.

    The permutation orders rows by ``md5(seed:key)``.  The leading hex digits
    are a monotone bucket, so positions are a bucket offset plus a position
    inside the bucket: no global sort in one task.  65536 offsets at most.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    keyed = df.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, 4))
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(W.partitionBy(F.lit(1))).alias("__rows"),
    )
    inside = W.partitionBy("__bucket").orderBy("__digest", key)
    return (
        keyed.withColumn("__pos", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "__bucket")  # four hex digits: at most 65536 rows
        .withColumn(out, F.col("__offset") + F.col("__pos"))
        .drop("__digest", "__bucket", "__pos", "__offset")
    )


def k_folds(df: DataFrame, key: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Fold i holds positions ``floor(i*n/k)`` up to ``floor((i+1)*n/k)`` of the permutation."""
    placed = permutation_position(df, key, seed, "__position")
    fold = F.floor(((F.col("__position") + 1) * k - 1) / F.col("__rows")).cast("int")
    return placed.withColumn(out, fold).drop("__position", "__rows")


# Replicate weights are a function of (key, counter) in whole numbers, which any
# engine computes alike: two rounds x -> x^5 modulo a prime p, a permutation since 5
# and p - 1 share no factor, around a linear step with the key's second half.
PRIME, STEP, SPREAD = (1 << 31) - 1, 1_103_515_245, 69_621
#: Counts from which a Poisson weight is drawn from the normal approximation.
NORMAL_FROM = 64
#: Counters of one replicate: two for positives (or any value), two for negatives.
STREAMS = 4


def weight_key(seed: int, columns: Sequence[str | Column]) -> tuple[Column, Column]:
    """Two numbers below ``PRIME`` from the md5 of ``seed|column|...``; columns as text, null as ``~``."""
    text = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *text).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME
    return part(1), part(9)


def uniforms(k1: np.ndarray, k2: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """keys x counters of numbers between 0 and 1."""
    def mixed(x: np.ndarray) -> np.ndarray:
        y = x * x % PRIME
        return y * y % PRIME * x % PRIME

    x = (k1[:, None] + (counters + 1) * STEP) % PRIME
    return (mixed((mixed(x) * SPREAD + k2[:, None]) % PRIME) + 0.5) / PRIME


@lru_cache(maxsize=NORMAL_FROM)
def _thresholds(count: int) -> np.ndarray:
    """Cumulative Poisson probabilities with mean ``count``."""
    k = np.arange(int(count + 12 * math.sqrt(count) + 20) + 1)
    return np.cumsum(np.exp(k * math.log(count) - count - np.array([math.lgamma(i + 1) for i in k])))


def poisson_weights(k1: np.ndarray, k2: np.ndarray, counts: np.ndarray, replicates: int | np.ndarray, stream: int = 0) -> np.ndarray:
    """Poisson weights, cells x replicates; each depends only on its cell's key and count, and on the replicate's number.

    ``replicates`` is how many there are, or the numbers wanted.
    """
    numbers = np.arange(replicates) if np.isscalar(replicates) else replicates
    counters = numbers.astype(np.int64) * STREAMS + stream
    u = uniforms(k1, k2, counters)
    out = np.zeros(u.shape)
    for c in np.unique(counts[counts > 0]):
        rows = np.flatnonzero(counts == c)
        if c < NORMAL_FROM:
            out[rows] = np.searchsorted(_thresholds(int(c)), u[rows], side="right")
        else:
            v = uniforms(k1[rows], k2[rows], counters + 1)
            out[rows] = np.maximum(np.floor(c + np.sqrt(float(c)) * np.sqrt(-2 * np.log(u[rows])) * np.cos(2 * np.pi * v) + 0.5), 0)
    return out


def _interval(per_replicate: DataFrame, group: Sequence[str], value: str, alpha: float) -> DataFrame:
    """Order statistics ``stat[int(q*m)]`` over the m valid replicates of a group."""
    valid = per_replicate.filter(F.col(value).isNotNull())
    lists = valid.groupBy(*group).agg(F.sort_array(F.collect_list(value)).alias("__s"))
    at = lambda q: F.get("__s", F.floor(F.lit(q) * F.size("__s")).cast("int"))
    return lists.select(
        *group, at(alpha / 2).alias("lower"), at(1 - alpha / 2).alias("upper"), F.size("__s").alias("replicates")
    )


def bootstrap_auc(
    scored: DataFrame,
    label: str,
    score: str,
    group: Sequence[str] = (),
    n_boot: int = 1500,
    alpha: float = 0.05,
    seed: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Percentile interval of the ROC AUC per group.

    A resample gives every row a Poisson(1) weight; rows with the same score and
    class are one cell, whose weight is Poisson(count).  Cells lie in range
    partitions by (group, score); a task returns, for every replicate, the class
    weights of its part of a group and the wins inside it.  Parts then combine in
    value order.  No n x n_boot matrix exists anywhere.

    Replicates with one class only are left out of the order statistics.
    """
    k1, k2 = weight_key(seed, [*group, "score"])
    cells = score_cells(scored, group, label, score).withColumns({"__k1": k1, "__k2": k2})
    keyed = ranged(cells, group, ["score"], parts).drop("__k")
    fields = [keyed.schema[g] for g in group] + [
        T.StructField("__part", T.IntegerType()),
        T.StructField("rep", T.IntegerType()),
        T.StructField("p", T.DoubleType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("wins", T.DoubleType()),
    ]
    names = list(group)

    def replicate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        p_sum, n_sum, wins = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        for at in range(0, len(pdf), _CELL_CHUNK):
            part = pdf.iloc[at : at + _CELL_CHUNK]
            keys = part["__k1"].to_numpy(), part["__k2"].to_numpy()
            wp = poisson_weights(*keys, part["p"].to_numpy(), n_boot)
            wn = poisson_weights(*keys, part["n"].to_numpy(), n_boot, 2)
            below = n_sum + np.cumsum(wn, axis=0) - wn
            wins += (wp * (below + wn / 2)).sum(axis=0)
            p_sum += wp.sum(axis=0)
            n_sum += wn.sum(axis=0)
        out = {g: pdf[g].iloc[0] for g in names}
        out |= {"__part": int(pdf["__part"].iloc[0]), "rep": np.arange(n_boot, dtype="int32"), "p": p_sum, "n": n_sum, "wins": wins}
        return pd.DataFrame(out)

    per_part = keyed.groupBy(*group, "__part").applyInPandas(replicate, T.StructType(fields))
    order = W.partitionBy(*group, "rep").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    combined = per_part.withColumn("__below", F.coalesce(F.sum("n").over(order), F.lit(0.0)))
    total_p, total_n = F.sum("p"), F.sum("n")
    per_rep = combined.groupBy(*group, "rep").agg(
        F.when((total_p > 0) & (total_n > 0), F.sum(F.col("wins") + F.col("p") * F.col("__below")) / (total_p * total_n)).alias("auc")
    )
    return _interval(per_rep, group, "auc", alpha)


def bootstrap_mean(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    n_boot: int = 1500,
    alpha: float = 0.05,
    seed: int = 0,
    tasks: int = 64,
) -> DataFrame:
    """Mean per group with a percentile interval, on (group, value) cells.

    Cells are spread over ``tasks`` parts per group by hash, so a hot group is
    never one task; the parts add up.
    """
    k1, k2 = weight_key(seed, [*group, "v"])
    cells = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    keyed = cells.withColumns({"__k1": k1, "__k2": k2}).withColumn("__part", (F.col("__k1") % tasks).cast("int"))
    fields = [keyed.schema[g] for g in group] + [
        T.StructField("rep", T.IntegerType()), T.StructField("w", T.DoubleType()), T.StructField("wv", T.DoubleType())
    ]
    names = list(group)

    def replicate(pdf: pd.DataFrame) -> pd.DataFrame:
        w_sum, wv_sum = np.zeros(n_boot), np.zeros(n_boot)
        for at in range(0, len(pdf), _CELL_CHUNK):
            part = pdf.iloc[at : at + _CELL_CHUNK]
            w = poisson_weights(part["__k1"].to_numpy(), part["__k2"].to_numpy(), part["c"].to_numpy(), n_boot)
            w_sum += w.sum(axis=0)
            wv_sum += (w * part["v"].to_numpy()[:, None]).sum(axis=0)
        out = {g: pdf[g].iloc[0] for g in names}
        return pd.DataFrame(out | {"rep": np.arange(n_boot, dtype="int32"), "w": w_sum, "wv": wv_sum})

    sums = keyed.groupBy(*group, "__part").applyInPandas(replicate, T.StructType(fields))
    per_rep = sums.groupBy(*group, "rep").agg(F.when(F.sum("w") > 0, F.sum("wv") / F.sum("w")).alias("mean"))
    interval = _interval(per_rep, group, "mean", alpha)
    point = cells.groupBy(*group).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("rows"))
    right = interval.select(*[F.col(g).alias(f"__r_{g}") for g in group], "lower", "upper", "replicates")
    cond = F.lit(True)
    for g in group:
        cond = cond & point[g].eqNullSafe(right[f"__r_{g}"])
    return point.join(right, cond, "left").drop(*[f"__r_{g}" for g in group])


def replicate_weight(key: str, replicate: int, seed: int = 0) -> Column:
    """The same Poisson(1) weight of a row in one replicate, as a column."""
    k1, k2 = weight_key(seed, [key])
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # no copies of the value in the plan
    mixed = lambda x: once(x, lambda y: once(y * y % PRIME, lambda z: z * z % PRIME * y % PRIME))
    step = (F.lit(replicate * STREAMS + 1).cast("long") * STEP + k1) % PRIME
    u = (mixed((mixed(step) * SPREAD + k2) % PRIME) + 0.5) / PRIME
    below = F.array(*[F.lit(float(t)) for t in _thresholds(1)[:20]])
    return once(u, lambda v: F.size(F.filter(below, lambda t: t <= v))).cast("double")
