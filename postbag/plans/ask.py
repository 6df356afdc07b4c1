"""One run: search, expand, limit, clean, pack, chunk, ask, keep what says something, count."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.functions.chunks import chunk_size
from postbag.operators.cleaning import with_content
from postbag.operators.filters import (
    Criteria,
    Names,
    parse_day,
    resolve_folders,
    resolve_mailboxes,
    search,
    split_csv,
)
from postbag.operators.inference import ATTEMPTS, Completer, infer
from postbag.operators.ledger import ask_once
from postbag.operators.ordering import RANGE_BYTES, limit, with_order
from postbag.operators.packing import (
    DEFAULT_BATCH,
    batch_items,
    batches,
    chunked,
    fitted_batches,
    single_items,
)
from postbag.operators.reports import error_report, mailbox_counts, run_stats
from postbag.operators.threads import expand_threads
from postbag.session import input_bytes, pin, spread
from postbag.sources.records import default_output_dir, records, write_records

MAX_CONTEXT = 8192
FIT = "fit"


@dataclass(frozen=True)
class AskOptions:
    prompt: str
    search_query: str | None = None
    boxes: Names = None
    folders: Names = None
    in_sent: bool = False
    sender: Names = None
    recipient: Names = None
    subject: str | None = None
    date_from: str | date | datetime | None = None
    date_to: str | date | datetime | None = None
    where: str | Column | None = None
    thread: bool = False
    max_emails: int | None = None
    batch: bool = False
    batch_size: int | str | None = None  # a number, or "fit" to fill the context
    max_context: int = MAX_CONTEXT
    languages: tuple[str, ...] = ("en",)
    output_dir: str | None = None
    per_key_files: bool = False
    run_id: str | None = None  # names the run in its output folder: repeated, it replaces itself
    dry_run: bool = False
    attempts: int = ATTEMPTS
    concurrency: int | None = None
    profile: ResourceProfile | None = None
    ledger: str | None = None  # a folder that keeps answers beyond the run: no answered call is made again

    def __post_init__(self) -> None:
        for name in ("sender", "recipient", "boxes", "folders"):
            object.__setattr__(self, name, split_csv(getattr(self, name)))
        for name in ("date_from", "date_to"):
            object.__setattr__(self, name, parse_day(getattr(self, name)))

    @property
    def criteria(self) -> Criteria:
        return Criteria(
            query=self.search_query,
            sender=self.sender,
            recipient=self.recipient,
            subject=self.subject,
            date_from=self.date_from,
            date_to=self.date_to,
            where=self.where,
        )


@dataclass(frozen=True)
class AskResult:
    responses: DataFrame  # one row per chunk, written once
    records: DataFrame  # useful answers
    stats: DataFrame  # one row
    counts: DataFrame  # messages per mailbox and total
    errors: DataFrame  # last errors per mailbox
    path: str | None  # where the records were written
    elapsed_seconds: float  # from the start of the run until its records were written


def fetch(messages: DataFrame, options: AskOptions, known: Iterable[str] | None = None) -> DataFrame:
    """The messages of a run, with their fetch order. With threads each has its number of ``copies``."""
    boxes = resolve_mailboxes(options.boxes, known) if known else options.boxes or []
    folders = resolve_folders(options.folders, options.in_sent)
    found = search(messages, options.criteria, boxes, folders)
    copies = None
    if options.thread:
        # A thread never leaves its mailbox: others needn't be read.
        own = messages.filter(F.col("mailbox").isin(list(boxes))) if boxes else messages
        found, copies = expand_threads(found, own, dedup=False), "copies"
    return limit(with_order(found, boxes, folders), options.max_emails, copies)


def items(fetched: DataFrame, options: AskOptions) -> DataFrame:
    """What one question is asked about: a message, or a batch of them."""
    cleaned = with_content(spread(fetched), options.languages, headers=options.thread)
    if not options.batch:
        return single_items(cleaned)
    budget, fit = batch_budget(options)
    return dealt(batch_items(fitted_batches(cleaned, budget) if fit else batches(cleaned, budget)), fetched)


def dealt(made: DataFrame, fetched: DataFrame) -> DataFrame:
    """Batches over all cores: those made in fewer ranges than there are cores lie in as few tasks; the calls shouldn't."""
    cores, size = made.sparkSession.sparkContext.defaultParallelism, input_bytes(fetched)
    few = size is not None and size <= RANGE_BYTES * cores
    return made.repartition(cores) if few else made


def batch_budget(options: AskOptions) -> tuple[int, bool]:
    """What a batch holds: so many characters, to fill a context, or so many messages."""
    if options.batch_size == FIT:
        return chunk_size(options.max_context), True
    return options.batch_size or DEFAULT_BATCH, False


def ask(
    messages: DataFrame,
    options: AskOptions,
    make_completer: Callable[[], Completer],
    known: Iterable[str] | None = None,
) -> DataFrame:
    """Responses of a run, one row per chunk. The calls are made when it is read: write it before using it twice.

    A limit, threads and batches need an order or counts over everything and run jobs while the plan is built. With
    a ledger so do the calls.
    """
    return asked(chunked(items(fetch(messages, options, known), options), options.max_context), options, make_completer)


def asked(work: DataFrame, options: AskOptions, make_completer: Callable[[], Completer]) -> DataFrame:
    """Responses to chunks, from the ledger if there is one."""
    how = {"attempts": options.attempts, "concurrency": options.concurrency, "profile": options.profile}
    if options.ledger:
        return ask_once(work, options.prompt, make_completer, options.ledger, **how)
    return infer(work, options.prompt, make_completer, **how)


def run_ask(
    messages: DataFrame,
    options: AskOptions,
    make_completer: Callable[[], Completer],
    known: Iterable[str] | None = None,
) -> AskResult:
    """Run the questions once, write the records and report.

    The responses are written to the shared folder first; records, statistics and error report read them
    there, so no call is made twice for them.
    """
    started = time.monotonic()
    known = list(known) if known else None
    responses = pin(ask(messages, options, make_completer, known), "responses")
    found = records(responses, options.batch)
    path = write_records(
        found, options.output_dir or default_output_dir(), options.per_key_files, options.dry_run, options.run_id
    )
    names = resolve_mailboxes(options.boxes, known) if known else options.boxes
    # Of an item's chunks the first stands for it; messages count for their own mailbox, also in a batch.
    firsts = responses.filter("chunk_ix IS NULL OR chunk_ix = 0").select(F.explode("emails").alias("email"))
    fetched = firsts.select("email.mailbox", "email.copies")
    return AskResult(
        responses=responses,
        records=found,
        stats=run_stats(responses),
        counts=mailbox_counts(fetched, names),
        errors=error_report(responses),
        path=path,
        elapsed_seconds=time.monotonic() - started,
    )
