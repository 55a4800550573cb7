"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a character class body and as a list of characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name; dots and backticks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(name: str) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests) a scratch folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The lineage ends there, so a lost executor costs a read, not a recomputation.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, groups: list[str], block: str, order: list[str], totals: dict[str, str]) -> DataFrame:
    """Running totals per group without a task per group.

    ``block`` cuts each group into pieces of moderate size.  Each entry of
    ``totals`` (new column -> expression) becomes the sum over all earlier rows
    of the group, ordered by block and then by ``order``: a small window over
    block sums gives the offset of the block, a window inside the block the rest.
    """
    at = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, block).agg(*[F.sum(F.expr(e)).alias(f"{n}__b") for n, e in totals.items()])
    offsets = sums.select(*groups, block, *[F.coalesce(F.sum(f"{n}__b").over(at), F.lit(0)).alias(f"{n}__o") for n in totals])
    inside = Window.partitionBy(*groups, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *[F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)).alias(f"{n}__i") for n, e in totals.items()])
    joined = rows.join(offsets, [*groups, block])
    return joined.select(*df.columns, *[(F.col(f"{n}__i") + F.col(f"{n}__o")).alias(n) for n in totals])
