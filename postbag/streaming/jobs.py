"""The same transforms over files that keep arriving.

Search, cleaning, chunking, asking and writing look at one message at a time and run in a stream as they
are. What needs to see several messages (batches, threads) is done per micro-batch, threads with the help of a
message table that stays as it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from postbag.operators.cleaning import with_content
from postbag.operators.filters import resolve_folders, search
from postbag.operators.inference import Completer
from postbag.operators.ordering import ORDER, with_order
from postbag.operators.packing import (
    MEMBER_COLUMNS,
    batch_cost,
    batch_items,
    chunked,
    gathered,
    members,
    single_items,
    with_packs,
)
from postbag.operators.threads import IN_THREAD, expand_threads, hit_threads
from postbag.plans.ask import MAX_CONTEXT, AskOptions, asked, batch_budget, dealt, items
from postbag.schema import MESSAGE
from postbag.session import path_exists, pin, spread
from postbag.sources.archive import ThreadArchive
from postbag.sources.provider_json import CORRUPT, errors_of, from_json_rows, parsed_lines
from postbag.sources.records import records

# Contexts' worth of messages per micro-batch, and what a message is taken to weigh.
BUFFERED_CONTEXTS = 20
TOKENS_PER_MESSAGE = 500
SMALLEST_BUFFER = 10
# Tasks that a micro-batch's messages are dealt to, so that one with long messages holds up less.
TASKS_PER_CORE = 2


def buffer_size(max_context: int, contexts: int = BUFFERED_CONTEXTS) -> int:
    """Messages that wait at most: so many that they fill a number of contexts."""
    return max(SMALLEST_BUFFER, max_context * contexts // TOKENS_PER_MESSAGE)


MAX_FILES = buffer_size(MAX_CONTEXT)


def _reader(spark: SparkSession, max_files: int | None, max_bytes: str | None) -> DataStreamReader:
    """A reader whose micro-batches are bounded by files, or by bytes if given."""
    if max_bytes:
        return spark.readStream.option("maxBytesPerTrigger", max_bytes)
    return spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream


def message_stream(
    spark: SparkSession, path: str, max_files: int | None = MAX_FILES, max_bytes: str | None = None
) -> DataFrame:
    """Message tables as a stream."""
    reader = _reader(spark, max_files, max_bytes)
    return reader.schema(MESSAGE).parquet(path).filter("uid IS NOT NULL")


def provider_json_stream(
    spark: SparkSession,
    path: str,
    mailbox: str,
    max_files: int | None = MAX_FILES,
    max_bytes: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Messages of one mailbox as they land, and what cannot be read (mailbox, source, error), as two streams.

    A bad line ends nothing; with one stream per mailbox (``run_each``), neither does a mailbox that cannot be read.
    """
    parsed = parsed_lines(_reader(spark, max_files, max_bytes).text(path))
    good = parsed.filter(F.col(f"m.{CORRUPT}").isNull()).select("m.*")
    return from_json_rows(good, mailbox), errors_of(parsed, mailbox)


def _reject(options: AskOptions, *names: str) -> None:
    """A stream has no end to count to and no run to leave out: such options are errors, not ignored."""
    used = [name for name in ("max_emails", "dry_run", *names) if getattr(options, name)]
    if used:
        raise ValueError(f"a stream cannot do: {', '.join(used)}")


def ask_stream(messages: DataFrame, options: AskOptions, make_completer: Callable[[], Completer]) -> DataFrame:
    """Responses as a stream, one message per item.

    Without ``boxes`` all mailboxes of the stream count. ``thread`` shows each message with its headers; whole
    threads, batches, limits and dry runs are errors here.
    """
    _reject(options, "batch", "ledger")
    found = search(
        messages, options.criteria, options.boxes, resolve_folders(options.folders, options.in_sent)
    )
    cleaned = with_content(_spread_stream(found), options.languages, headers=options.thread)
    work = chunked(single_items(cleaned), options.max_context)
    return asked(work, options, make_completer)


def _spread_stream(found: DataFrame) -> DataFrame:
    """Deal messages out: a micro-batch of a few files would be cleaned and asked about in as few tasks."""
    cores = found.sparkSession.sparkContext.defaultParallelism
    return found.repartition(TASKS_PER_CORE * cores, "mailbox", "folder", "uid")


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Write what has arrived and stop. The checkpoint remembers what is done, also after a failure; call
    ``stop()`` on the query to end it earlier."""
    return (
        df.writeStream.format(fmt)
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def responses_path(path: str) -> str:
    """Where a stream that writes records to ``path`` keeps all responses, failures too: read them with
    ``spark.read.parquet`` for statistics, the error report and to ask again."""
    return f"{path.rstrip('/')}-responses"


def _write_micro_batch(responses: DataFrame, path: str, number: int | str, batch: bool) -> None:
    """Answers and failures of a micro-batch, then the records made of what was written: no call is made twice.

    Each micro-batch writes its own folders and replaces them when it is repeated, so nothing comes twice.
    """
    kept = f"{responses_path(path)}/micro_batch={number}"
    responses.write.mode("overwrite").parquet(kept)
    written = responses.sparkSession.read.schema(responses.schema).parquet(kept)
    (
        records(written, batch=batch)
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .json(f"{path}/micro_batch={number}")
    )


def write_records_stream(responses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Records of a stream of responses; all responses go to ``responses_path(path)``."""
    return (
        responses.writeStream.foreachBatch(lambda micro, number: _write_micro_batch(micro, path, number, False))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# Members of a batch that isn't full yet; ``arrival`` is the micro-batch that brought them.
OPEN = T.StructType(
    [
        T.StructField("arrival", T.LongType()),
        T.StructField("mailbox_ord", T.IntegerType()),
        T.StructField("folder_ord", T.IntegerType()),
        T.StructField("date_us", T.LongType()),
        *[field for field in MESSAGE.fields if field.name in MEMBER_COLUMNS],
        T.StructField("copies", T.LongType()),
        T.StructField("content", T.StringType()),
    ]
)
STATE = "number bigint, place bigint, since double"
ARRIVED = ("arrival", *ORDER)


def open_path(path: str) -> str:
    """Where a stream that writes records to ``path`` keeps the batch that isn't full yet."""
    return f"{path.rstrip('/')}-open"


@dataclass(frozen=True)
class _Left:
    """What earlier micro-batches leave to the next: members of the open batch, where it begins, since when it waits."""

    rows: DataFrame
    place: int
    since: float


def _left_by(spark: SparkSession, path: str, number: int) -> _Left | None:
    """State after micro-batch ``number``; that after its tail was asked about, if it was."""
    for folder in (f"{open_path(path)}/{number}-tail", f"{open_path(path)}/{number}"):
        if path_exists(spark, f"{folder}/state/_SUCCESS"):
            state = spark.read.schema(STATE).parquet(f"{folder}/state").first()
            return _Left(spark.read.schema(OPEN).parquet(f"{folder}/rows"), state["place"], state["since"])
    return None


def _leave(rows: DataFrame, path: str, name: str, number: int, place: int, since: float) -> None:
    """Members first, then the state: without its success marker there is none."""
    spark, folder = rows.sparkSession, f"{open_path(path)}/{name}"
    rows.select(*OPEN.names).coalesce(1).write.mode("overwrite").parquet(f"{folder}/rows")  # less than one batch
    spark.createDataFrame([(number, place, since)], STATE).write.mode("overwrite").parquet(f"{folder}/state")


def _to_next(place: int, budget: int) -> int:
    """Where the batch after the one that ``place`` lies in begins."""
    return (place // budget + 1) * budget


def _with_left(
    new: DataFrame, options: AskOptions, path: str, number: int, longest_wait: float | None
) -> DataFrame:
    """The batches that are full after micro-batch ``number``. What is left over waits in the shared folder.

    Messages count on from micro-batch to micro-batch, so batches are those of all messages in one row. The state of
    the micro-batch before is only read: one that is repeated starts from the same state and writes its own anew.
    """
    spark, (budget, fit) = new.sparkSession, batch_budget(options)
    rows = members(new).withColumn("arrival", F.lit(number).cast("long")).select(
        *[F.col(field.name).cast(field.dataType) for field in OPEN.fields]
    )
    left, now = _left_by(spark, path, number - 1), time.time()
    place, since, late = 0, now, None
    if left:
        place, since = left.place, left.since
        waiting = with_packs(left.rows, ARRIVED, batch_cost(fit), budget, start=place)
        if longest_wait is not None and now - since >= longest_wait and left.rows.take(1):
            # It has waited long enough: it goes as it is, and what has arrived begins a new one.
            late, place, since = gathered(waiting, budget, fit, ARRIVED), _to_next(place, budget), now
        else:
            rows = rows.unionByName(left.rows)
    packed = pin(with_packs(rows, ARRIVED, batch_cost(fit), budget, sized=fit, start=place), "packed")
    ends = packed.agg(F.max(F.col("place") + batch_cost(fit)).alias("end"), F.max("pack").alias("last")).first()
    closed, rest = packed, packed.limit(0)
    if ends["end"] is not None:
        place = ends["end"]
        if place // budget == ends["last"]:
            rest = packed.filter(F.col("pack") == ends["last"])
            first = rest.agg(F.min("place").alias("place"), F.min("arrival").alias("arrival")).first()
            place, since = first["place"], since if first["arrival"] < number else now
            closed = packed.filter(F.col("pack") < ends["last"])
    _leave(rest, path, str(number), number, place, since)
    full = gathered(closed, budget, fit, ARRIVED)
    return full if late is None else full.unionByName(late)


def finish_batches(
    spark: SparkSession, options: AskOptions, make_completer: Callable[[], Completer], path: str
) -> None:
    """Ask about the batch that isn't full, as no more messages will come (or come later, and begin a new one).

    May be repeated: what was asked about is marked, and a try that broke is made again in its own place.
    """
    if not path_exists(spark, open_path(path)):
        return
    number = spark.read.schema(STATE).parquet(f"{open_path(path)}/*/state").agg(F.max("number")).first()[0]
    if number is not None:
        _finish(spark, options, make_completer, path, number)


def _finish(
    spark: SparkSession, options: AskOptions, make_completer: Callable[[], Completer], path: str, number: int
) -> None:
    """Ask about what micro-batch ``number`` left, unless that is done."""
    if path_exists(spark, f"{open_path(path)}/{number}-tail/state/_SUCCESS"):
        return
    left, (budget, fit) = _left_by(spark, path, number), batch_budget(options)
    if left.rows.take(1):
        tail = gathered(with_packs(left.rows, ARRIVED, batch_cost(fit), budget, start=left.place), budget, fit, ARRIVED)
        work = chunked(batch_items(tail), options.max_context)
        _write_micro_batch(asked(work, options, make_completer), path, f"{number}-tail", True)
    place = _to_next(left.place, budget) if left.rows.take(1) else left.place
    _leave(left.rows.limit(0), path, f"{number}-tail", number, place, time.time())


def _expanded(found: DataFrame, archive: DataFrame | ThreadArchive) -> DataFrame:
    """Hits with their threads. Of an archive by thread only the folders of the hits' threads are read, once."""
    if not isinstance(archive, ThreadArchive):
        return expand_threads(found, archive, dedup=False, fallback=True)
    keys = hit_threads(found.filter(IN_THREAD))
    return expand_threads(found, archive.of(keys), dedup=False, fallback=True, keys=keys)


def write_asked_stream(
    messages: DataFrame,
    options: AskOptions,
    make_completer: Callable[[], Completer],
    path: str,
    checkpoint: str,
    archive: DataFrame | ThreadArchive | None = None,
    carry: bool = False,
    longest_wait: float | None = None,
) -> StreamingQuery:
    """Ask about batches or threads of what arrives.

    With ``carry`` a batch that a micro-batch doesn't fill waits for the next one, also over a restart; it goes as it
    is after ``longest_wait`` seconds, looked at when messages arrive, or by ``finish_batches``. Else every
    micro-batch ends with the batch it has. Threads are looked up in ``archive``, a
    message table or, to read little of it, one kept by thread, by default in the micro-batch itself; hits whose thread it does not know stay alone. All
    responses go to ``responses_path(path)``. Without ``boxes`` all mailboxes of the stream count.
    """
    _reject(options)
    if carry and not options.batch:
        raise ValueError("only batches can be carried on")
    spark = messages.sparkSession
    boxes = options.boxes or []
    folders = resolve_folders(options.folders, options.in_sent)

    def each(micro: DataFrame, number: int) -> None:
        found = search(micro, options.criteria, boxes, folders)
        if options.thread:
            found = _expanded(found, micro if archive is None else archive)
        in_order = with_order(found, boxes, folders)
        if carry:
            if path_exists(spark, f"{responses_path(path)}/micro_batch={number - 1}-tail"):
                _finish(spark, options, make_completer, path, number - 1)  # in case that a try broke
            cleaned = with_content(spread(in_order), options.languages, headers=options.thread)
            made = dealt(batch_items(_with_left(cleaned, options, path, number, longest_wait)), in_order)
        else:
            made = items(in_order, options)
        work = chunked(made, options.max_context)
        _write_micro_batch(asked(work, options, make_completer), path, number, options.batch)

    return (
        messages.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ask_arrived(
    messages: DataFrame, options: AskOptions, make_completer: Callable[[], Completer], path: str, checkpoint: str,
    archive: DataFrame | ThreadArchive | None = None,
) -> None:
    """Ask about all that has arrived, in batches that go on from micro-batch to micro-batch, the last one too."""
    write_asked_stream(messages, options, make_completer, path, checkpoint, archive, carry=True).awaitTermination()
    finish_batches(messages.sparkSession, options, make_completer, path)


def run_each(spark: SparkSession, starts: Mapping[str, Callable[[], StreamingQuery]]) -> DataFrame:
    """Run a stream for each mailbox, side by side, and return (mailbox, error) of those that could not go on.

    A mailbox that cannot be started or breaks ends no other one; its checkpoint stands where it broke.
    """
    queries, errors = {}, []
    for name, start in starts.items():
        try:
            queries[name] = start()
        except Exception as failure:
            errors.append((name, f"{type(failure).__name__}: {failure}"))
    for name, query in queries.items():
        try:
            query.awaitTermination()
        except Exception as failure:
            errors.append((name, f"{type(failure).__name__}: {failure}"))
    return spark.createDataFrame(errors, "mailbox string, error string")
