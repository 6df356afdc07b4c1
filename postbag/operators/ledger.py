"""Model calls that are paid once: a ledger of answers that outlives the run that asked.

Every call has a key, made of the prompt, the messages and the text. Answers are written under their keys as soon as the
task that got them ends, not when the whole run does: a task is a bounded number of calls, and its files are moved to
their place by the task itself. A run that is repeated, or goes on after it broke, first takes out the calls that the
ledger has an answer for. Calls that failed are in the ledger too, but are asked again.
"""

from __future__ import annotations

import hashlib
import math
import time
import uuid
from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.operators.inference import ATTEMPTS, Completer, infer
from postbag.schema import RESPONSE
from postbag.session import is_written, path_exists, pin

#: Calls of one task, which are lost together if its executor is.
CALLS_PER_TASK = 50
#: Lets a task move its files to their place when it ends, so that they stay if the job fails later.
EARLY_COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")

LEDGER = T.StructType(
    [
        T.StructField("call_key", T.StringType()),
        T.StructField("response", RESPONSE),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("asked_at", T.TimestampType()),
    ]
)


def call_key(prompt: str) -> Column:
    """Digest of all that makes a call what it is: prompt, messages, place and text of the chunk."""
    messages = F.transform("emails", lambda e: F.struct(e["mailbox"].alias("mailbox"), e["uid"].alias("uid")))
    call = F.struct(F.lit(prompt).alias("prompt"), messages.alias("messages"), "chunk_ix", "chunk")
    return F.sha2(F.to_json(call).cast("binary"), 256)


def _folder(ledger: str, prompt: str) -> str:
    """Where a prompt's answers lie, so that the answers to others needn't be read."""
    digest = hashlib.sha256(prompt.encode()).hexdigest()
    return f"{ledger.rstrip('/')}/prompt={digest[:32]}"


def read_ledger(spark: SparkSession, ledger: str, prompt: str) -> DataFrame:
    """The last answer to each call or, if it has none, its last failure."""
    folder = _folder(ledger, prompt)
    if not path_exists(spark, folder):
        return spark.createDataFrame([], LEDGER)
    # Every run has a folder of its own: runs that share a ledger don't touch each other's files.
    entries = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(folder)
    newest = F.struct(F.col("response").isNotNull(), "asked_at")
    last = F.max_by(F.struct(*LEDGER.names[1:]), newest).alias("last")
    return entries.groupBy("call_key").agg(last).select("call_key", "last.*")


def ask_once(
    chunks: DataFrame,
    prompt: str,
    make_completer: Callable[[], Completer],
    ledger: str,
    attempts: int = ATTEMPTS,
    concurrency: int | None = None,
    profile: ResourceProfile | None = None,
    sleep: Callable[[float], None] = time.sleep,
    calls_per_task: int = CALLS_PER_TASK,
) -> DataFrame:
    """What ``infer`` returns, with answers from the ledger where it has them. The calls are made here and now.

    ``chunks`` is written once, unless it is a written table, so that keys stay what they are. Equal calls are made
    once. Texts move once, by their keys, to the tasks that ask; each has about ``calls_per_task`` calls. With
    ``concurrency`` the calls are made in waves of so many tasks. If the run breaks, answers of all tasks that had ended
    are in the ledger.
    """
    spark = chunks.sparkSession
    kept = chunks if is_written(chunks) else pin(chunks, "calls")
    keyed = kept.withColumn("call_key", F.when(F.col("chunk").isNotNull(), call_key(prompt)))
    wanted = keyed.filter("call_key IS NOT NULL").select("call_key", "chunk")
    # What has been answered by now: the folder of answers grows while the calls are made.
    answered = pin(read_ledger(spark, ledger, prompt).filter("response IS NOT NULL").select("call_key"), "answered")
    todo = wanted.select("call_key").distinct().join(answered, "call_key", "left_anti").count()
    tasks = math.ceil(todo / calls_per_task)
    waves = math.ceil(tasks / concurrency) if concurrency else 1
    calls = wanted.withColumn("done", F.lit(False)).unionByName(
        answered.select("call_key", F.lit(None).cast("string").alias("chunk"), F.lit(True).alias("done"))
    )
    for wave in range(waves if tasks else 0):
        part = calls.filter(F.pmod(F.xxhash64("call_key"), F.lit(waves)) == wave) if waves > 1 else calls
        once = part.repartition(concurrency or tasks, "call_key").groupBy("call_key").agg(
            F.first("chunk", ignorenulls=True).alias("chunk"), F.max("done").alias("done")
        )
        open_calls = once.filter("NOT done").select("call_key", "chunk")
        asked = infer(open_calls, prompt, make_completer, attempts, None, profile, sleep)
        entries = asked.withColumn("asked_at", F.current_timestamp()).select(*LEDGER.names)
        entries.write.option(*EARLY_COMMIT).parquet(f"{_folder(ledger, prompt)}/run={uuid.uuid4().hex}")
    last = read_ledger(spark, ledger, prompt).drop("asked_at")
    return keyed.join(last, "call_key", "left").select(
        *chunks.columns, "response", F.coalesce("attempts", F.lit(0)).alias("attempts"), "error"
    )
