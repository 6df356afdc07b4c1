"""Messages from landed RFC 822 files, one folder of the tree per mail folder."""

from __future__ import annotations

import email
import email.message
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.functions.text import trim
from postbag.schema import MESSAGE
from postbag.sources.provider_json import mail_date

_FIELDS = ("subject", "from", "to", "date")
_PARSED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in _FIELDS],
        T.StructField("text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def _part_text(part: email.message.EmailMessage) -> str:
    """Text of a part. Where its charset is unknown or wrong, what UTF-8 makes of it, with replacement characters."""
    try:
        return part.get_content()
    except (LookupError, UnicodeError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def _parse(raw: bytes) -> dict:
    """Header fields and the bodies of all parts of a message."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    fields = {name: str(message[name]) if message[name] is not None else "" for name in _FIELDS}
    bodies: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in message.walk():
        if part.get_content_type() in bodies and not part.is_attachment():
            bodies[part.get_content_type()].append(_part_text(part))
    fields["text"] = "".join(bodies["text/plain"]) or None
    fields["html"] = "".join(bodies["text/html"]) or None
    return fields


def _parse_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.name for field in _PARSED.fields]
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"]):
            try:
                rows.append({"path": path, **_parse(content), "error": None})
            except Exception as failure:
                rows.append({"path": path, "error": f"{type(failure).__name__}: {failure}"})
        yield pd.DataFrame(rows, columns=names).astype(object).where(lambda f: f.notna(), None)


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file of a ``binaryFile`` scan; a file that cannot be read has an ``error``."""
    return files.select("path", "content").mapInPandas(_parse_files, _PARSED)


def mail_files(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """Files below ``path``, one per mail. The driver lists them: for very many mails pack them into tables."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def read_rfc822(spark: SparkSession, path: str, mailbox: str = "imap", glob: str = "*.eml") -> DataFrame:
    """Files below ``path`` as messages: the directory is the folder, the file's stem the uid.

    Files that cannot be read are in ``rfc822_errors``.
    """
    return from_mail_rows(mail_files(spark, path, glob), mailbox)


def read_packed_rfc822(spark: SparkSession, path: str, mailbox: str = "imap") -> DataFrame:
    """Mails from a Parquet table with columns ``path`` and ``content``: many mails to a file."""
    return from_mail_rows(spark.read.parquet(path), mailbox)


def rfc822_errors(files: DataFrame, mailbox: str = "imap") -> DataFrame:
    """(mailbox, source, error) of the mails that could not be read."""
    return parse_files(files).filter("error IS NOT NULL").select(
        F.lit(mailbox).alias("mailbox"), F.col("path").alias("source"), "error"
    )


def from_mail_rows(files: DataFrame, mailbox: str) -> DataFrame:
    """Messages of rows with ``path`` and ``content``."""
    dated = parse_files(files).filter("error IS NULL").withColumn("_date", mail_date(F.col("date")))
    messages = dated.select(
        F.lit(mailbox).alias("mailbox"),
        F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("uid"),
        F.lit(None).cast("string").alias("thread_id"),
        "subject",
        F.col("from").alias("sender"),
        F.filter(F.transform(F.split("to", ","), trim), lambda r: r != "").alias("recipients"),
        F.col("_date.local").alias("date_local"),
        F.col("_date.offset").alias("date_offset_min"),
        "text",
        "html",
        F.lit(None).cast("array<string>").alias("labels"),
    )
    return messages.to(MESSAGE)
