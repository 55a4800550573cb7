"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings; all can be set on a session that already exists.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let the skew rule split a hot partition even when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the JVM does not compile methods beyond 8000 bytes; split the code instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: Shuffles begin with so many partitions at least, and adaptive execution merges small ones: what a task
#: sorts or hashes is bounded by the advisory size, not by the session's number of partitions.
FIRST_PARTITIONS = 480
#: The advisory size where the session names none: a task that joins and aggregates many tables holds several times what it reads.
ADVISORY_SIZE = "32m"
#: What a task reads of a file where the session names none: narrow rows of 128 MB are more than a task sorts for a shuffle in memory.
READ_SIZE = "32m"
_ADVISORY, _READ = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
_FIRST, _CLEANUP = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    spark.conf.set(_FIRST, str(max(FIRST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    for key, size in ((_ADVISORY, ADVISORY_SIZE), (_READ, READ_SIZE)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)
    return spark


def local_session(app: str = "cohortspark", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # recording a Python call site per Column makes wide plans slow to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests) a scratch folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; the files go when the application ends.

    What reads the result sees one and the same outcome of a range exchange, and a
    lost executor costs a read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cohort-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # what the write shuffled is not read again
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Truncate lineage through the reliable checkpoint folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
