"""Mailboxes by name: which kind of source each is and where its messages lie."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.operators.filters import Names, resolve_mailboxes
from postbag.schema import MESSAGE
from postbag.sources.provider_json import provider_json_errors, read_provider_json
from postbag.sources.rfc822 import mail_files, read_packed_rfc822, read_rfc822, rfc822_errors

Reader = Callable[[SparkSession, str, str], DataFrame]


def read_messages(spark: SparkSession, path: str, mailbox: str = "messages") -> DataFrame:
    """A message table. Missing columns are an error, extra ones are dropped."""
    table = spark.read.parquet(path)
    missing = [name for name in MESSAGE.names if name not in table.columns and name != "mailbox"]
    if missing:
        raise ValueError(f"{path} is no message table, it lacks: {', '.join(missing)}")
    return table.withColumn("mailbox", F.lit(mailbox)).to(MESSAGE).filter("uid IS NOT NULL")


SOURCES: dict[str, Reader] = {
    "gmail": read_provider_json,
    "imap": read_rfc822,
    "imap_packed": read_packed_rfc822,
    "table": read_messages,
}


# What each kind could not read; kinds without an entry lose nothing.
ERRORS: dict[str, Reader] = {
    "gmail": provider_json_errors,
    "imap": lambda spark, path, mailbox: rfc822_errors(mail_files(spark, path), mailbox),
    "imap_packed": lambda spark, path, mailbox: rfc822_errors(spark.read.parquet(path), mailbox),
}


def register_source(kind: str, reader: Reader, errors: Reader | None = None) -> None:
    """Add a kind of source: a function of (session, path, mailbox name) that returns messages, and maybe one
    that returns (mailbox, source, error) of what could not be read."""
    SOURCES[kind] = reader
    ERRORS.pop(kind, None)
    if errors:
        ERRORS[kind] = errors


def read_mailbox(spark: SparkSession, kind: str, path: str, mailbox: str) -> DataFrame:
    if kind not in SOURCES:
        raise ValueError(f"unknown source type {kind!r}; use one of {', '.join(sorted(SOURCES))}")
    return SOURCES[kind](spark, path, mailbox)


def read_mailboxes(
    spark: SparkSession, mailboxes: Mapping[str, tuple[str, str]], requested: Names = None
) -> DataFrame:
    """The requested mailboxes of ``{name: (kind, path)}`` as one table, by default the first one."""
    names = resolve_mailboxes(requested, mailboxes)
    return reduce(
        lambda a, b: a.unionByName(b), [read_mailbox(spark, *mailboxes[name], name) for name in names]
    )


def read_errors(
    spark: SparkSession, mailboxes: Mapping[str, tuple[str, str]], requested: Names = None
) -> DataFrame:
    """(mailbox, source, error) of everything in the requested mailboxes that ``read_mailboxes`` cannot show."""
    names = resolve_mailboxes(requested, mailboxes)
    found = [ERRORS[kind](spark, path, name) for name in names for kind, path in [mailboxes[name]] if kind in ERRORS]
    empty = spark.createDataFrame([], "mailbox string, source string, error string")
    return reduce(lambda a, b: a.unionByName(b), found, empty)
