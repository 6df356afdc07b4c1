"""A message table kept by thread, so that looking up some threads reads some files.

Messages lie in folders by a hash of mailbox and thread, sorted inside. Whoever looks for threads reads the folders
their hashes name; in these, sorted thread ids let row groups be skipped. Messages without a thread are not in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.operators.threads import IN_THREAD, KEYS, with_thread_key
from postbag.schema import MESSAGE
from postbag.session import file_names

BUCKET = "thread_bucket"
BUCKETS = 1024


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ThreadArchive:
    """Where the table lies, and how many folders threads are dealt to. All writers and readers have to agree on that."""

    path: str
    buckets: int = BUCKETS

    def add(self, messages: DataFrame) -> None:
        """Add messages. A hot thread's folder has many files, which are written and read by many tasks."""
        keyed = with_thread_key(messages.filter(IN_THREAD)).withColumn(BUCKET, _bucket(self.buckets))
        ranged = keyed.repartitionByRange(BUCKET, *KEYS, "uid").sortWithinPartitions(BUCKET, *KEYS, "uid")
        ranged.select(*MESSAGE.names, BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def of(self, threads: DataFrame) -> DataFrame:
        """Messages that may belong to ``threads`` (mailbox, thread_key): those in the folders of their hashes."""
        spark = threads.sparkSession
        asked = {r["b"] for r in threads.select(_bucket(self.buckets).alias("b")).distinct().collect()}  # up to ``buckets``
        there = file_names(spark, self.path, f"{BUCKET}=")
        folders = sorted(f"{self.path.rstrip('/')}/{name}" for name in there if int(name.partition("=")[2]) in asked)
        if not folders:
            return spark.createDataFrame([], MESSAGE)
        schema = T.StructType([*MESSAGE.fields, T.StructField(BUCKET, T.IntegerType())])
        return spark.read.schema(schema).option("basePath", self.path).parquet(*folders).drop(BUCKET)

    def all(self, spark: SparkSession) -> DataFrame:
        if not file_names(spark, self.path, f"{BUCKET}="):
            return spark.createDataFrame([], MESSAGE)
        return spark.read.schema(MESSAGE).parquet(self.path).select(*MESSAGE.names)
