"""Joins: id assignment and resolution, membership, restriction, partner integration (J, U).

No join carries a broadcast hint on a side whose size is not bounded by a
parameter; Spark measures the other sides and adaptive execution switches to a
broadcast, or splits a skewed partition, at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortspark.session import stored

#: Hash buckets of surrogate ids.  The ids follow from it, so it is one value for every cluster.
ID_BUCKETS = 65_536


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct union by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).distinct()


def append_frames(frames: Sequence[DataFrame], distinct: bool = True) -> DataFrame:
    """Append frames of several windows and drop exact duplicates."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.distinct() if distinct else out


def assign_ids(frames: Sequence[DataFrame], id_name: str, buckets: int = ID_BUCKETS, along: Sequence[str] = (), once: bool = False) -> DataFrame:
    """Dense surrogate ids 1..n on the distinct union of external ids.

    Rows are hashed into ``buckets``; an id is the number of rows in earlier
    buckets plus the position inside the bucket.  The result depends on the content
    and on ``buckets`` only, not on the cluster, needs no global sort and no single-partition window over the rows:
    the running offset is taken over at most ``buckets`` counts.  Columns ``along`` follow
    from the others and count for nothing.  Sizes and positions both read the rows: with
    ``once`` a job writes these when this is called, and the frames are not computed twice.
    """
    ids = stored(union_distinct(frames), id_name) if once else union_distinct(frames)
    natural = [c for c in ids.columns if c not in along]
    keyed = ids.withColumn("__bucket", F.pmod(F.xxhash64(*natural), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    position = F.row_number().over(W.partitionBy("__bucket").orderBy(*natural))
    # offsets has at most ``buckets`` rows by construction
    return (
        keyed.withColumn("__pos", position)
        .join(F.broadcast(offsets), "__bucket")
        .select((F.col("__offset") + F.col("__pos")).alias(id_name), *ids.columns)
    )


def spread_null_key(key: Column, spread_on: Sequence[str]) -> Column:
    """Replace null join keys by values that match nothing and hash apart.

    Rows whose external id is unknown would otherwise all meet in one shuffle
    partition of an outer join.
    """
    salt = F.xxhash64(*spread_on).cast("string")
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), salt))


def resolve_id(df: DataFrame, ids: DataFrame, on: str, id_col: str, id_name: str, how: str = "left", keep: Sequence[str] = ()) -> DataFrame:
    """Add the surrogate id found through one external id; a null id never matches.

    ``keep`` names columns of ``ids`` to add too; with it the key stays as ``__key``.
    """
    key = ids.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("__key"), F.col(id_name), *keep
    )
    if how == "inner":
        left = df.filter(F.col(on).isNotNull()).withColumn("__key", F.col(on).cast("string"))
    else:
        left = df.withColumn("__key", spread_null_key(F.col(on), df.columns))
    return left.join(key, "__key", how).drop(*([] if keep else ["__key"]))


@dataclass(frozen=True)
class IdLookup:
    """How one partner column resolves to a surrogate id; ``names`` are columns of the id table that come with it."""

    ids: DataFrame
    on: str
    id_col: str
    id_name: str
    how: str = "left"
    names: Sequence[str] = ()


@dataclass(frozen=True)
class PartnerSource:
    """One partner's clean frame and its id lookups."""

    frame: DataFrame
    lookups: Sequence[IdLookup] = ()
    empty_ids: Sequence[str] = field(default_factory=tuple)


def _reached_once(parts: Sequence[PartnerSource], id_name: str) -> DataFrame | None:
    """``(id, __own)``: whether one key of one partner alone leads to the id; None where an id may come another way."""
    found = [[lk for lk in part.lookups if lk.id_name == id_name] for part in parts]
    for part, lks in zip(parts, found):
        if len(lks) > 1 or (not lks and id_name in part.frame.columns and id_name not in part.empty_ids):
            return None
    keys = [lk.ids.filter(F.col(lk.id_col).isNotNull()).select(id_name) for lks in found for lk in lks]
    if not keys:
        return None
    return reduce(lambda a, b: a.unionByName(b), keys).groupBy(id_name).agg((F.count(F.lit(1)) == 1).alias("__own"))


def integrate(parts: Sequence[PartnerSource], id_columns: Sequence[str], data_columns: Sequence[str]) -> DataFrame:
    """Resolve each partner's ids, line columns up by name, distinct union.

    The union also removes exact duplicate facts inside one partner.  Rows with an id
    of their own, which one key of one partner alone leads to, can equal only rows of
    that key; these meet where the key is joined, so only the others (unknown or shared
    ids) are shuffled once more to meet across keys and partners.  The ``names`` of a
    lookup, which follow from its id, come where the id is found, so that no second join
    over all rows has to fetch them.
    """
    once = _reached_once(parts, id_columns[0]) if id_columns else None
    names = list(dict.fromkeys(n for part in parts for lk in part.lookups for n in lk.names))
    out = [*id_columns, *data_columns, *names]
    own, other = [], []
    for part in parts:
        df, keyed = part.frame, False
        # the first id last, so that rows lie by its key
        for lk in sorted(part.lookups, key=lambda lk: lk.id_name == id_columns[0]) if once is not None else part.lookups:
            keyed = once is not None and lk.id_name == id_columns[0]
            ids = lk.ids.join(once, lk.id_name, "left") if keyed else lk.ids
            keep = [*lk.names, "__own"] if keyed else list(lk.names)
            df = resolve_id(df, ids, lk.on, lk.id_col, lk.id_name, lk.how, keep)
            df = df if keyed else df.drop("__key")
        for c in part.empty_ids:
            df = df.withColumn(c, F.lit(None).cast("bigint"))
        have = set(df.columns)
        wanted = [c for c in out if c in have]
        if keyed:
            # a filter on an aggregate's outcome stays above it, so that both readings share the shuffles of rows below
            rows = df.groupBy("__key", *wanted).agg(F.max("__own").alias("__own"))
            own.append(rows.filter("__own").select(*wanted))
            # the others are told apart before anything is aggregated: what a task holds or spills of all rows it does so once
            other.append(df.filter("__own IS NOT TRUE").select(*wanted))
        else:
            other.append(df.select(*wanted))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*own, union_distinct(other)])
    return united.select(*[c for c in out if c in united.columns])


def members(df: DataFrame, column: str, values: DataFrame, value_column: str) -> DataFrame:
    """Keep rows whose value occurs in another frame (left semi join)."""
    right = values.select(F.col(value_column).alias(column))
    return df.join(right, column, "left_semi")


def restrict(spine: DataFrame, restrictor: DataFrame, key: str, predicate: Column | None = None) -> DataFrame:
    """Keep spine rows whose restrictor row satisfies the predicate.

    The predicate defaults to "the flag is true"; a null flag fails.
    """
    if predicate is None:
        flag = [c for c in restrictor.columns if c != key][-1]
        predicate = F.col(flag) == F.lit(True)
    return spine.join(restrictor.filter(predicate).select(key), key, "left_semi")


def with_group_minimum(df: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """Attach the group minimum of an expression to each row.

    Aggregate first, then join: a hot group stays spread over map tasks, which
    a window over the group would not allow.
    """
    firsts = df.groupBy(group).agg(F.min(value).alias(name))
    return df.join(firsts, group, "left")


def left_joins(spine: DataFrame, parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Star join; each part is ``(key, frame)``."""
    return reduce(lambda acc, kp: acc.join(kp[1], kp[0], "left"), parts, spine)
