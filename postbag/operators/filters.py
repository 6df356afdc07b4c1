"""Which messages a run looks at. All criteria must hold; a criterion that is not given always does."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDERS = ("INBOX",)
SENT_FOLDERS = ("sent",)

Names = str | Iterable[str] | None


def split_csv(value: Names) -> list[str] | None:
    """Names from a comma-separated string or a list, trimmed, without empty ones; None if none is left."""
    if value is None:
        return None
    parts = value.split(",") if isinstance(value, str) else value
    return [part.strip() for part in parts if part.strip()] or None


def parse_day(value: str | date | datetime | None) -> date | None:
    """The day of an ISO date or date-time."""
    if value is None:
        return None
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value.date() if isinstance(value, datetime) else value


@dataclass(frozen=True)
class Criteria:
    query: str | None = None
    sender: Names = None
    recipient: Names = None
    subject: str | None = None
    date_from: str | date | datetime | None = None
    date_to: str | date | datetime | None = None
    where: str | Column | None = None  # any Spark predicate, for what the fields above cannot say


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def holds(c: Column, needle: str) -> Column:
    """Substring test without regard to case; NULL holds nothing."""
    return F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))


def sender_matches(names: Names) -> Column:
    wanted = split_csv(names)
    return any_of(holds(F.col("sender"), name) for name in wanted) if wanted else F.lit(True)


def recipient_matches(names: Names) -> Column:
    wanted = split_csv(names)
    if not wanted:
        return F.lit(True)
    return F.coalesce(
        F.exists("recipients", lambda r: any_of(holds(r, name) for name in wanted)), F.lit(False)
    )


def text_matches(query: str | None) -> Column:
    """The words occur in a header field or a body. The short fields are tested first."""
    if not query:
        return F.lit(True)
    return any_of(
        [
            holds(F.col("subject"), query),
            holds(F.col("sender"), query),
            F.coalesce(F.exists("recipients", lambda r: holds(r, query)), F.lit(False)),
            holds(F.col("text"), query),
            holds(F.col("html"), query),
        ]
    )


def date_in_range(date_from: str | date | None, date_to: str | date | None) -> Column:
    """From the first day on, up to but not including the last. Plain comparisons, so that scans can
    skip row groups."""
    test = F.lit(True)
    for day, compare in ((parse_day(date_from), "__ge__"), (parse_day(date_to), "__lt__")):
        if day is not None:
            bound = F.lit(day.isoformat()).cast("timestamp_ntz")
            test = test & getattr(F.col("date_local"), compare)(bound)
    return test


def matches(criteria: Criteria) -> Column:
    """All criteria as one predicate."""
    test = (
        date_in_range(criteria.date_from, criteria.date_to)
        & sender_matches(criteria.sender)
        & recipient_matches(criteria.recipient)
    )
    if criteria.subject:
        test = test & holds(F.col("subject"), criteria.subject)
    test = test & text_matches(criteria.query)
    if criteria.where is not None:
        test = test & (F.expr(criteria.where) if isinstance(criteria.where, str) else criteria.where)
    return test


def resolve_mailboxes(requested: Names, known: Iterable[str]) -> list[str]:
    """The requested mailboxes, by default the first known one. All unknown names are reported at once."""
    known = list(known)
    names = split_csv(requested) or known[:1]
    missing = [name for name in names if name not in known]
    if missing:
        raise ValueError(f"unknown mailbox: {', '.join(missing)}; known are {', '.join(known)}")
    return names


def resolve_folders(folders: Names, in_sent: bool = False) -> list[str]:
    """The requested folders; without any, sent mail if ``in_sent``, else the inbox."""
    return split_csv(folders) or list(SENT_FOLDERS if in_sent else DEFAULT_FOLDERS)


def in_mailboxes(names: list[str]) -> Column:
    return F.col("mailbox").isin(names)


def in_folders(folders: list[str]) -> Column:
    """A message lies in one folder, or carries labels that count as folders."""
    wanted = [folder.lower() for folder in folders]
    labelled = F.exists("labels", lambda label: F.lower(label).isin(wanted))
    return F.coalesce(F.lower("folder").isin(wanted), F.lit(False)) | F.coalesce(labelled, F.lit(False))


def search(
    messages: DataFrame,
    criteria: Criteria | None = None,
    mailboxes: list[str] | None = None,
    folders: list[str] | None = None,
) -> DataFrame:
    """The hits of a search. Messages without uid are no messages."""
    test = F.col("uid").isNotNull()
    if mailboxes:
        test = test & in_mailboxes(mailboxes)
    if folders:
        test = test & in_folders(folders)
    return messages.filter(test & matches(criteria or Criteria()))
