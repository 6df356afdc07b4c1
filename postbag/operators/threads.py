"""From hits to whole threads, and threads as transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.functions.text import SEPARATOR
from postbag.operators.packing import with_packs
from postbag.session import pin

KEYS = ["mailbox", "thread_key"]
# Plain comparisons, so that scans of mailboxes without threads skip one side.
IN_THREAD = "thread_id <> ''"
ALONE = "thread_id IS NULL OR thread_id = ''"
# Thread keys up to this many bytes are sent to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
# Characters of one transcript part. Only threads longer than this have more than one part.
TRANSCRIPT_PART = 1_000_000


def thread_key(thread_id: Column, folder: Column, uid: Column) -> Column:
    """A message without a thread is a thread of its own."""
    alone = F.concat_ws("|", F.lit("m:"), F.coalesce(folder, F.lit("")), uid)
    return F.when(F.length(thread_id) > 0, F.concat(F.lit("t:"), thread_id)).otherwise(alone)


def with_thread_key(messages: DataFrame) -> DataFrame:
    return messages.withColumn(
        "thread_key", thread_key(F.col("thread_id"), F.col("folder"), F.col("uid"))
    )


def hit_threads(hits: DataFrame) -> DataFrame:
    """Written: the threads of the hits and how many hits each has; counted before it is shuffled."""
    counted = with_thread_key(hits).groupBy(*KEYS).agg(F.count("*").alias("copies"))
    return pin(counted, "threads")


def _sized(keys: DataFrame, limit: int) -> DataFrame:
    """``keys`` marked for broadcast if its measured size allows."""
    size = keys.agg(
        F.sum(F.octet_length("mailbox") + F.octet_length("thread_key") + 32).alias("bytes")
    ).first()["bytes"]
    return F.broadcast(keys) if (size or 0) <= limit else keys.hint("merge")


def expand_threads(
    hits: DataFrame,
    messages: DataFrame,
    dedup: bool = True,
    fallback: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    keys: DataFrame | None = None,
) -> DataFrame:
    """All messages of the threads that have a hit, whatever folder they lie in and whether they match.

    Each message comes once. Without ``dedup`` it has a column ``copies``: how many hits its thread has, that
    is, how often a search that expands hit by hit shows it. A count says the same as so many equal rows, and
    does not square a thread that holds much of the corpus.

    Hits that belong to no thread are passed on as they are; nothing is looked up for them. With ``fallback`` so
    are hits whose thread is not in ``messages``. ``keys`` are the hits' threads, if they have been counted already.

    The messages are read in place if the thread keys fit a broadcast. Otherwise both sides are shuffled by
    thread, and the hot thread's partition is split by adaptive execution: the key side is a plain scan, so
    nothing but the exchange lies between the scan and the join.
    """
    keys = hit_threads(hits.filter(IN_THREAD)) if keys is None else keys
    side = _sized(keys, broadcast_bytes)
    keyed = with_thread_key(messages.filter(IN_THREAD))
    if dedup:
        found = keyed.join(side.select(*KEYS), KEYS, "left_semi")
    else:
        found = keyed.join(side, KEYS, "inner")
    alone = with_thread_key(hits.filter(ALONE))
    if fallback:
        # Written once, so that the messages aren't read a second time to see which threads they know.
        found = pin(found, "expanded")
        known = found.select(*KEYS).distinct()
        lost = pin(keys.join(known, KEYS, "left_anti").select(*KEYS), "lost-threads")
        kept = with_thread_key(hits.filter(IN_THREAD)).join(_sized(lost, broadcast_bytes), KEYS, "left_semi")
        alone = alone.unionByName(kept)
    if not dedup:
        alone = alone.withColumn("copies", F.lit(1).cast("long"))
    return found.unionByName(alone)


def transcripts(blocks: DataFrame, part_size: int = TRANSCRIPT_PART) -> DataFrame:
    """Threads as one text each, oldest message first.

    Takes messages with ``thread_key``, ``date_us`` and ``content`` (their blocks). A thread longer than
    ``part_size`` characters comes as several rows, numbered by ``part``; joined with the separator they are
    the whole transcript. No task ever holds more of a thread than one range of it.
    """
    order = (*KEYS, "date_us", "uid", "folder")
    packed = with_packs(
        blocks.select(*order, "content"),
        order,
        F.length("content") + len(SEPARATOR),
        part_size,
        within=tuple(KEYS),
        sized=True,
    )
    member = F.struct("date_us", "uid", "folder", "content")
    return (
        packed.groupBy("slot", *KEYS, "pack")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .select(
            *KEYS,
            F.col("pack").alias("part"),
            F.size("members").cast("long").alias("messages"),
            F.array_join(F.col("members.content"), SEPARATOR).alias("transcript"),
        )
    )
