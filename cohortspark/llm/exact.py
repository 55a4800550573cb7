"""Exact dedup by skew-safe combining (operator 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import SPACES, col, table, whole, written


def normalised(name: str) -> Column:
    """The text with every run of ASCII white space replaced by one space.

    Plain replacements do it for single white space and pairs of it; the regular
    expression, many times slower, runs only on texts with longer runs.
    """
    text = whole(name)
    for other in SPACES[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    text = F.replace(text, F.lit("  "), F.lit(" "))
    # the one-element array binds the replaced text, which is else computed three times
    done = F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t))
    return done.getItem(0)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Three stages combine the rows, each comparing the whole content and not only
    its digest: inside the input partition (the map side of the first grouping),
    per (digest, salt), then per digest over the winners of all salts.  The salt
    is the input partition modulo ``salts``, so a group that holds a third of all
    rows reaches each task as one row per partition and the winners of one digest
    number ``salts`` at most.

    Members find their winner by digest.  If different texts share a digest, those
    digests alone are matched by digest and content.

    Cases: a null text counts as empty, and all empty texts form one group.  A
    null id never wins while the group has another id; a group of null ids has a
    null keep_id and none of its rows is kept by id, so all are kept.  Rows that
    repeat an id count one by one in group_size, and those that carry the winning
    id are all kept.  An empty table gives an empty result.  Other columns,
    whatever their names, are not read.
    """
    rows = docs.select(col(id_col).alias("id"), normalised(text_col).alias("body")).withColumn("digest", digest(F.col("body")))
    local = rows.groupBy("digest", (F.spark_partition_id() % salts).alias("salt"), "body").agg(
        F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")
    )
    classes = local.repartition("digest").groupBy("digest", "body").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"))
    winners = written(
        classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("lo").alias("lo"), F.sum("n").alias("n")), "exact-winners"
    )
    plain = winners.filter("texts = 1")
    shared = winners.filter("texts > 1").select("digest")
    hex_ = F.lower(F.hex("digest")) if digest is sha256 else F.sha2(F.col("body").cast("binary"), 256)
    members = rows.withColumn("hex", hex_)
    found = members.drop("body").join(plain.select("digest", "lo", "n"), "digest")
    if not shared.isEmpty():
        apart = classes.join(shared, "digest", "left_semi")
        found = found.unionByName(members.join(apart, ["digest", "body"]).drop("body"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("lo").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(F.col("id") == F.col("lo"), F.col("lo").isNull()).alias("kept"),
        F.col("hex").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
