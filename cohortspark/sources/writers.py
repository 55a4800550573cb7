"""Sinks and catalog helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def write_table(df: DataFrame, target: str, if_exists: str = "fail", partition_by: Sequence[str] = ()) -> None:
    """Write to a catalog table, or to Parquet when the target is a path."""
    writer = df.write.mode(_MODES[if_exists])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in target:
        writer.parquet(target)
    else:
        writer.format("parquet").saveAsTable(target)


def clean_and_write(
    raw: Mapping[str, DataFrame],
    cleaner: Callable[..., DataFrame],
    target: str,
    contract_columns: Sequence[str] | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Named raw frames -> cleaner -> contract columns -> table."""
    clean = cleaner(**raw)
    if contract_columns is not None:
        clean = clean.select(*[c for c in contract_columns if c in clean.columns])
    write_table(clean, target, "replace" if overwrite else "fail")
    return clean


def create_from_query(spark: SparkSession, target: str, query: str, overwrite: bool = False, **tables: DataFrame) -> None:
    """Materialise a query over tables already loaded."""
    df = spark.sql(query, **tables) if tables else spark.sql(query)
    write_table(df, target, "replace" if overwrite else "fail")


def create_namespaces(spark: SparkSession, names: Sequence[str]) -> None:
    """K05."""
    for name in names:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def table_exists(spark: SparkSession, name: str) -> bool:
    """K06."""
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """K06."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def column_names(spark: SparkSession, name: str) -> list[str]:
    """K06."""
    return spark.table(name).columns


def join_to_ids(temp: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Every id row, with the loaded data where it matches (right join)."""
    return temp.join(ids, on, "right")


def add_columns(target: DataFrame, updates: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Add or update columns by key; rows without an update keep their value.

    A matched update wins even when its value is null.  Each target row is updated
    at most once: of several updates of a key the one with the largest values counts,
    and the target keeps its rows.
    """
    fresh = updates.groupBy(on).agg(F.max(F.struct(*columns)).alias("__u"))
    fresh = fresh.select(on, *[F.col("__u")[c].alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = target.join(fresh, on, "left")
    out = []
    for c in target.columns:
        out.append(F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
    out += [F.col(f"__new_{c}").alias(c) for c in columns if c not in target.columns]
    return joined.select(*out)


CLASS_REPORT = T.StructType(
    [T.StructField("class", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1")], T.StructField("support", T.LongType())]
)
#: One row per experiment (K09); nested values hold the report parts.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("target", T.StringType()),
        T.StructField("restrictions", T.ArrayType(T.StringType())),
        T.StructField("train_start", T.DateType()),
        T.StructField("split_date", T.DateType()),
        T.StructField("test_end", T.DateType()),
        T.StructField("classifier", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("train_rows", T.LongType()),
        T.StructField("test_rows", T.LongType()),
        T.StructField("train_rows_dropped", T.LongType()),
        T.StructField("test_rows_dropped", T.LongType()),
        T.StructField("train_max_nulls", T.LongType()),
        T.StructField("test_max_nulls", T.LongType()),
        T.StructField("auc", T.DoubleType()),
        T.StructField("auc_train", T.DoubleType()),
        T.StructField("precision0_top10", T.DoubleType()),
        T.StructField("precision0_top25", T.DoubleType()),
        T.StructField("aupr0_test", T.DoubleType()),
        T.StructField("aupr0_train", T.DoubleType()),
        T.StructField("confusion", T.MapType(T.StringType(), T.LongType())),
        T.StructField("confusion_train", T.MapType(T.StringType(), T.LongType())),
        T.StructField("class_report", T.ArrayType(CLASS_REPORT)),
        T.StructField("coefficients", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("train_nulls", T.MapType(T.StringType(), T.LongType())),
        T.StructField("test_nulls", T.MapType(T.StringType(), T.LongType())),
    ]
)


def append_results(spark: SparkSession, rows: Sequence[Row | dict], path: str) -> None:
    """Append experiment rows; one row per experiment, so a driver-sized list."""
    dicts = [r.asDict(recursive=True) if isinstance(r, Row) else r for r in rows]
    full = [{f.name: d.get(f.name) for f in RESULT_SCHEMA.fields} for d in dicts]
    spark.createDataFrame(full, RESULT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def finished_runs(spark: SparkSession, path: str) -> set[str]:
    """Ids of the experiments already in the result table; none where there is no table yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return set()
    return {r["run_id"] for r in spark.read.schema(RESULT_SCHEMA).parquet(path).select("run_id").distinct().collect()}


def text_report(result: Mapping) -> str:
    """Plain-text report of one result row."""
    lines = []
    for field in RESULT_SCHEMA.fields:
        value = result.get(field.name)
        if value is not None:
            lines.append(f"{field.name:>20}: {value}")
    return "\n".join(lines)


def save_model(model: MLWritable, path: str) -> None:
    """Persist a fitted Spark ML model."""
    model.write().overwrite().save(path)
