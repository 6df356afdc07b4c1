"""Answers as JSON lines: writing them, reading them back."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.functions.text import output_key
from postbag.functions.verdicts import is_empty_answer
from postbag.schema import BATCH_RECORD, RECORD
from postbag.session import create_file, file_names, path_exists, remove_file

RUN_NAME = re.compile(r"[A-Za-z0-9._-]+")
NO_MESSAGE_KEY = "batch.jsonl"


def default_output_dir(now: datetime | None = None) -> str:
    return f"output/{(now or datetime.now()).strftime('%y%m%d-%H%M%S')}"


def with_verdict(responses: DataFrame) -> DataFrame:
    """Mark answers that say nothing. Rows without an answer are neither empty nor useful (NULL)."""
    return responses.withColumn(
        "is_empty",
        F.when(F.col("response").isNotNull(), is_empty_answer(F.col("response.content"))),
    )


def first_key(emails: Column) -> Column:
    """File name of an item, after its first message."""
    first = emails[0]
    return F.when(
        F.size(emails) > 0, output_key(first["date_local"], first["sender"], first["subject"])
    ).otherwise(NO_MESSAGE_KEY)


def _shown(e: Column) -> Column:
    return F.struct(*[e[name].alias(name) for name in ("uid", "subject", "sender", "recipients", "date")])


def records(responses: DataFrame, batch: bool = False) -> DataFrame:
    """One record per useful answer, and the file name it belongs to.

    A record shows its message as ``email``, or with ``batch`` all messages of the batch as ``emails``.
    """
    useful = with_verdict(responses).filter("NOT is_empty")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    subject = (
        F.transform("emails", _shown).alias("emails") if batch else _shown(F.col("emails")[0]).alias("email")
    )
    return useful.select(
        first_key(F.col("emails")).alias("output_key"),
        subject,
        "response",
        stamp.alias("timestamp"),
    )


def _marker(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/_runs/{run_id}"


def write_records(
    found: DataFrame,
    output_dir: str | None = None,
    per_key_files: bool = False,
    dry_run: bool = False,
    run_id: str | None = None,
) -> str | None:
    """Write a run's records to a folder, beside those of other runs, and return it; a dry run writes nothing and
    returns None.

    A run has a partition of its own, ``run_id=...``, and is there for readers when its marker is. A run that is
    repeated with the same ``run_id``, because it broke or its driver was started again, takes back its marker and
    replaces what it wrote: no record comes twice, no half of a run is read. Without a name a run gets a new one.

    By default the executors write large files in which ``output_key`` is a field. ``per_key_files`` gives
    every key its own folder, as is handy for outputs a person reads.
    """
    if dry_run:
        return None
    spark, path, run_id = found.sparkSession, output_dir or default_output_dir(), run_id or uuid.uuid4().hex
    if not RUN_NAME.fullmatch(run_id):
        raise ValueError(f"a run's name has letters, digits, '.', '_' and '-' only: {run_id}")
    remove_file(spark, _marker(path, run_id))
    writer = found.write.mode("overwrite").option("ignoreNullFields", "false")
    if per_key_files:
        writer = writer.partitionBy("output_key")
    writer.json(f"{path.rstrip('/')}/run_id={run_id}")
    create_file(spark, _marker(path, run_id))
    return path


def run_ids(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that a folder has in full; one name a run, however many records it has."""
    return sorted(file_names(spark, f"{path.rstrip('/')}/_runs"))


def read_records(spark: SparkSession, path: str, batch: bool = False) -> DataFrame:
    """Records with their file name: those of all runs of a folder that were finished, or of a folder without runs."""
    shape = BATCH_RECORD if batch else RECORD
    schema = T.StructType([*shape.fields, T.StructField("output_key", T.StringType())])
    base = path.rstrip("/")
    reader = spark.read.schema(schema)
    if not path_exists(spark, f"{base}/_runs"):
        # Folders of runs without any marker are what broken runs left.
        return reader.json(path) if not file_names(spark, base, "run_id=") else spark.createDataFrame([], schema)
    folders = [f"{base}/run_id={run}" for run in run_ids(spark, base)]
    if not folders:
        return spark.createDataFrame([], schema)
    # Each run is a table of its own: with files by key, the key is in the folders' names.
    return reader.json(folders)
