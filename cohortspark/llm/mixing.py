"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import SPACE_CLASS, SPACES, col, table, whole, written
from cohortspark.operators.ranks import ordered_totals

#: Weights of the sources in their order, repeating; and how often a document can be taken.
WEIGHTS, MOST = (1, 2, 3), 3
#: The least quality weight of a document.
LEAST_QUALITY = 0.05


def word_count(text: Column) -> Column:
    """Words between ASCII white space, of a text without nulls."""
    return F.char_length(F.translate(F.regexp_replace(text, f"[^{SPACE_CLASS}]+", "x"), SPACES, "")).cast("long")


def letter_share(text: Column) -> Column:
    """Share of the characters that are no ASCII digits, signs or controls; a plain measure of prose."""
    dense = F.char_length(F.translate(text, SPACES, ""))
    letters = F.char_length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]", ""))
    return letters / F.greatest(dense, F.lit(1))


def uniform(key: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of the md5 of a text."""
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, target) of (source, size) rows, one per source.

    Sources in the order of their names, null last, have the ``weights`` in turn and
    share the sum of all sizes by them.  A target stops at ``most`` times its
    source's size and the others share the excess: in the order of size over weight
    the sources that stop are a beginning, so running sums of sizes and weights tell
    which they are, exactly and without rounds.  Nothing goes to the driver.
    """
    every = 1
    for w in weights:
        every *= w
    ranked = ordered_totals(sizes.select("source", "size", F.lit(1).cast("long").alias("one")), [], "source", ["one"])
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("one_before") % len(weights)).cast("int") + 1)
    ranked = ranked.select("source", "size", w.alias("weight"))
    ratio = F.col("size").cast("decimal(38,0)") * (F.lit(every) / F.col("weight")).cast("decimal(38,0)")
    at = ordered_totals(ranked.withColumn("ratio", ratio.cast("decimal(38,0)")), [], ["ratio", "source"], ["size", "weight"])
    wide = lambda c: F.col(c).cast("decimal(24,0)")
    stops = most * wide("size") * (F.col("weight_total") - F.col("weight_before")).cast("decimal(13,0)") <= F.col("weight") * (wide("size_total") - most * wide("size_before"))
    at = at.withColumn("stops", stops)
    stopped = lambda c: F.coalesce(F.sum(F.when(F.col("stops"), F.col(c))), F.lit(0)).alias(c)
    at = at.withColumn("stopped", at.agg(F.struct(stopped("size"), stopped("weight")).alias("sums")).scalar())
    rest, share = F.col("size_total") - most * F.col("stopped.size"), F.col("weight_total") - F.col("stopped.weight")
    target = F.when(F.col("stops"), (most * F.col("size")).cast("double")).otherwise(F.col("weight").cast("double") * rest.cast("double") / share.cast("double"))
    return at.select("source", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    seed: int = 13,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of every document.

    A source's budget is its target in whole words.  As many complete epochs as fit
    take every document once each; of the rest, documents are taken in the order of
    the exponential keys ``-ln(u) / quality`` until the words before them fill the
    budget, and the one at the edge is cut to it.  ``quality`` is a positive column
    of ``docs`` (see :func:`letter_share` for the default); u comes from a hash of
    id and text, so reruns agree under any partitioning.

    Sizes and keys without texts are written once.  Range partitions by (source,
    key) spread a source of any size, and their running sums meet by one row per
    partition.
    """
    text = whole(text_col)
    u = uniform(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    worth = F.greatest(F.lit(LEAST_QUALITY), letter_share(text) if quality is None else quality.cast("double"))
    rows = docs.select(
        col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), word_count(text).alias("size"), (-F.log(u) / worth).alias("key")
    )
    rows = written(rows, "mix")
    # equal rows of one table keep apart by their place in it
    placed = ordered_totals(rows.withColumn("place", F.monotonically_increasing_id()), ["source"], ["key", "doc_id", "place"], ["size"])
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    targets = source_targets(sizes, weights, most).select(F.struct("source").alias("s"), "target")
    joined = placed.withColumn("s", F.struct("source")).join(targets, "s")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    total = F.col("size_total")
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * total - F.col("size_before")))
    return joined.select(
        "doc_id", "source", "size", total.alias("source_size"), "target", epochs.alias("epochs"), (epochs * F.col("size") + rest).cast("long").alias("taken")
    )


def op13_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the table ``documents``.

    Cases: a null or empty text has size 0 and is taken with 0 words; a null source
    is a source of its own, the last; an empty name is one too; null ids and rows
    that repeat an id are documents of their own, of which equal ones stand in any
    order; a source without words has target 0; no documents give no rows.
    """
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), z AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
      / greatest(0.05, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) / greatest(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')), 1)) AS key
  FROM d
), s AS (
  SELECT source, sum(size) AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM z GROUP BY source
), o AS (
  SELECT *, sum(size) OVER () AS t, sum(w) OVER () AS wt,
    coalesce(sum(size) OVER (ORDER BY size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
    coalesce(sum(w) OVER (ORDER BY size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM s
), c AS (
  SELECT *, 3 * size * (wt - wb) <= w * (t - 3 * sb) AS stops FROM o
), g AS (
  SELECT source, size, CASE WHEN stops THEN CAST(3 * size AS DOUBLE)
    ELSE CAST(w AS DOUBLE) * CAST(t - 3 * coalesce(sum(size) FILTER (stops) OVER (), 0) AS DOUBLE) / CAST(wt - coalesce(sum(w) FILTER (stops) OVER (), 0) AS DOUBLE) END AS target
  FROM c
), b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM g
), p AS (
  SELECT doc_id, z.size, b.size AS total, target, budget,
    coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source
), e AS (SELECT *, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS n FROM p)
SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, target,
  CAST(n * size + greatest(0, least(size, budget - n * total - before)) AS BIGINT) AS taken FROM e"""
