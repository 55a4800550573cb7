"""Scans: header CSV with a declared schema, mapping files, tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.cleaning import standardise_text

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, keep_corrupt: bool = True) -> DataFrame:
    """Header CSV read with an explicit schema.

    Line ends may be LF, CRLF or CR.  Rows that do not fit the schema keep
    their raw text in ``_corrupt_record`` (see :func:`split_corrupt`).
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).csv(path)


def read_named(spark: SparkSession, inputs: Mapping[str, tuple[str, T.StructType | str]]) -> dict[str, DataFrame]:
    """Several named CSV inputs."""
    return {name: read_csv(spark, path, schema) for name, (path, schema) in inputs.items()}


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit their schema, and the quarantined rest.

    A scan judges a row by the columns it converts, so both sides ask for all of them
    (the comparison always holds), however few the query reads.
    """
    whole = F.hash(*[F.col(f"`{c}`") for c in df.columns if c != CORRUPT]) >= F.lit(-(1 << 31))
    good = df.filter(whole & F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.filter(whole & F.col(CORRUPT).isNotNull())


def mapping_frame(raw: DataFrame, raw_col: str, standard_col: str, order: Sequence[str] = ()) -> DataFrame:
    """Translation table ``(raw_value, standard_value)``.

    Both sides are upper-cased.  A raw value that occurs more than once keeps
    its last row by ``order`` (file order when the frame has a ``line`` column).
    An empty standard value counts as null.
    """
    order = list(order) or ["line"]
    cleaned = raw.select(
        F.upper(raw_col).alias("raw_value"),
        F.nullif(F.upper(standard_col), F.lit("")).alias("standard_value"),
        F.struct(*order).alias("pos"),
    ).filter(F.col("raw_value").isNotNull())
    # one aggregate with map-side combine; the struct wrapper keeps null targets
    last = cleaned.groupBy("raw_value").agg(F.max_by(F.struct("standard_value"), "pos").alias("hit"))
    return last.select("raw_value", F.col("hit.standard_value").alias("standard_value"))


def read_mapping(spark: SparkSession, path: str, raw_col: str, standard_col: str) -> DataFrame:
    """S04 on a file.  A mapping file is one small file, so it is one partition in file order."""
    raw = spark.read.option("header", True).csv(path)
    numbered = raw.withColumn("line", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return mapping_frame(numbered, raw_col, standard_col)


def lookup_table(raw: DataFrame, column: str) -> DataFrame:
    """Distinct non-null standard values, sorted, as a one-column ``name`` table."""
    value = F.nullif(F.col(column), F.lit("")).alias("name")
    return raw.select(value).distinct().na.drop().orderBy("name")


def translate_text(df: DataFrame, column: str, mapping: DataFrame, out: str, other: str = "OTHER") -> DataFrame:
    """Standardise free text, look it up, unknown text becomes ``other``.

    Null text stays null and a value mapped to null gives null.  The mapping
    side carries no hint: Spark broadcasts it when its measured size allows.
    """
    hits = mapping.select(
        F.col("raw_value").alias("__raw"), F.col("standard_value").alias("__std"), F.lit(True).alias("__hit")
    )
    keyed = df.withColumn("__text", standardise_text(column))
    return (
        keyed.join(hits, keyed["__text"] == hits["__raw"], "left")
        .withColumn(
            out,
            F.when(F.col("__hit"), F.col("__std")).when(F.col("__text").isNotNull(), F.lit(other)),
        )
        .drop("__text", "__raw", "__std", "__hit")
    )


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table, or a Parquet path when the name contains a slash."""
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def read_query(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A SQL query over the catalog and any frames passed by name."""
    return spark.sql(query, **tables) if tables else spark.sql(query)


def latest_by(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """Deterministic pick of one row per key under a stated total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
