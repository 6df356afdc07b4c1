"""Session settings, and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    # Dates carry their own offset; the session must not add a second one.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Splits the hot thread of a shuffled join over many tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows are whole message bodies: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # A speculative copy of an inference task would repeat its calls.
    "spark.speculation": "false",
    # Recording where in Python each column was made triples the time to build the larger expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "postbag", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators count on. ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="postbag-")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names.

    Only a local session may go without that setting; its tables then lie in a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/postbag/{kind}-{uuid.uuid4().hex}"


#: Whether shuffled rows are removed when the query that needed them ends; else when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame, kind: str, **settings: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. ``settings``, with ``__`` for dots, hold meanwhile.

    Cuts the lineage in a way that survives lost executors, fixes whatever is not repeatable in the plan
    (partition numbers, model answers) and gives the reader true sizes and prunable columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, kind)
    settings = {CLEANUP: "true", **{key.replace("__", "."): value for key, value in settings.items()}}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


#: Sizes from here on are Spark's way to say that it doesn't know.
UNKNOWN_BYTES = 1 << 60
#: What Spark calls a scan of files in a plan.
RELATION = "LogicalRelation"
#: Scanned bytes are compressed.
EXPANSION = 4


def input_bytes(df: DataFrame) -> int | None:
    """About how many bytes the inputs of ``df`` hold, by the sizes of their files; None if that isn't known.

    No job is run. Filters and joins aren't looked at: it is a bound, not a guess at what is left.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(size >= UNKNOWN_BYTES for size in sizes) else sum(sizes) * EXPANSION


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark; it appears at once or not at all."""
    system, place = _file_system(spark, path)
    system.mkdirs(place.getParent())
    system.createNewFile(place)


def remove_file(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, False)


def file_names(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names in a folder that begin with ``prefix``; none if there is no folder."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return [name for name in names if name.startswith(prefix)]


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input has fewer splits than the cluster has cores.

    Body cleaning is CPU-bound, and one big file with one row group is one task however many cores there
    are, and however many splits: all but one of them are empty then. So rows of files are dealt out even if there
    are enough splits, by their numbers, which needs no sort. Other inputs with enough splits pass through without a
    shuffle, and so does whatever has been shuffled already: its partitions are only known by running it.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    if not _from_files(df):
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(splits, "_row").drop("_row")


def _from_files(df: DataFrame) -> bool:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return any(leaves.apply(i).nodeName() == RELATION for i in range(leaves.size()))


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table as it was written, that gives the same rows whenever it is read."""
    return df._jdf.queryExecution().optimizedPlan().nodeName() == RELATION
