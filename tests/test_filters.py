from datetime import date, datetime

import pytest

from postbag.operators.filters import (
    Criteria,
    parse_day,
    resolve_folders,
    resolve_mailboxes,
    search,
    split_csv,
)
from tests.rows import frame, message


@pytest.mark.parametrize(
    "given, expected",
    [
        (None, None),
        ("", None),
        ("one", ["one"]),
        ("one, two, three", ["one", "two", "three"]),
        ("  one  ,  two  ", ["one", "two"]),
        (["one", " two "], ["one", "two"]),
        ([], None),
    ],
)
def test_split_csv(given, expected):
    assert split_csv(given) == expected


def test_parse_day():
    assert parse_day(None) is None
    assert parse_day("2024-01-15") == parse_day("2024-01-15T10:30:00") == date(2024, 1, 15)
    assert parse_day(datetime(2024, 1, 15, 10)) == date(2024, 1, 15)


def test_resolve_mailboxes():
    known = ["first", "second"]
    assert resolve_mailboxes(None, known) == ["first"]
    assert resolve_mailboxes("second", known) == ["second"]
    assert resolve_mailboxes("second,first", known) == ["second", "first"]
    with pytest.raises(ValueError, match="third, fourth"):
        resolve_mailboxes(["third", "first", "fourth"], known)


def test_resolve_folders():
    assert resolve_folders(None) == ["INBOX"]
    assert resolve_folders(None, in_sent=True) == ["sent"]
    assert resolve_folders("a,b", in_sent=True) == ["a", "b"]


ROWS = [
    message("a", sender="Al <al@x>", recipients=["me@x", "you@y"], subject="Weekly Report"),
    message("b", sender="bo@y", recipients=[], subject=None, folder="Sent", text=None, html="<p>Report</p>"),
    message("c", sender=None, recipients=None, labels=["Inbox", "Work"], folder=None, text="über Straßen"),
    message("d", date_local=datetime(2024, 1, 16), mailbox="second"),
    message("e", date_local=None),
    message(None),
]


@pytest.mark.parametrize(
    "criteria, mailboxes, folders, uids",
    [
        (None, None, None, "abcde"),
        (Criteria(), None, None, "abcde"),
        (Criteria(sender="AL@x"), None, None, "a"),
        (Criteria(sender="al, bo"), None, None, "ab"),
        (Criteria(sender=["bo@y", "nobody"]), None, None, "b"),
        (Criteria(recipient="you"), None, None, "a"),
        (Criteria(recipient="you,me@example"), None, None, "ade"),
        (Criteria(subject="weekly"), None, None, "a"),
        (Criteria(query="report"), None, None, "ab"),
        (Criteria(query="ÜBER"), None, None, "c"),
        (Criteria(query="you@"), None, None, "a"),
        (Criteria(date_from="2024-01-15", date_to="2024-01-16"), None, None, "abc"),
        (Criteria(date_from="2024-01-16T10:00:00"), None, None, "d"),
        (Criteria(where="size(recipients) = 0"), None, None, "b"),
        (Criteria(sender="al", subject="nothing"), None, None, ""),
        (None, ["second"], None, "d"),
        (None, ["first"], ["inbox"], "ace"),
        (None, None, ["INBOX", "Sent"], "abcde"),
        (None, None, ["work"], "c"),
    ],
)
def test_search(spark, criteria, mailboxes, folders, uids):
    found = search(frame(spark, ROWS), criteria, mailboxes, folders)
    assert "".join(sorted(row["uid"] for row in found.collect())) == uids


def test_filters_reach_the_scan(spark, tmp_path):
    frame(spark, ROWS).write.parquet(str(tmp_path / "m"))
    found = search(
        spark.read.parquet(str(tmp_path / "m")), Criteria(date_from="2024-01-16"), ["first"]
    ).select("uid")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(mailbox,first), GreaterThanOr" in pushed  # the plan shortens the list
    assert "DataFilters: [" in plan and "date_local#" in plan
    assert "ReadSchema: struct<mailbox:string,uid:string,date_local:timestamp_ntz>" in plan
