"""Builds message rows for tests."""

from datetime import datetime, timedelta

from postbag.schema import MESSAGE

START = datetime(2024, 1, 15, 10, 30)


def message(uid="1", **given):
    row = {
        "mailbox": "first",
        "folder": "INBOX",
        "uid": uid,
        "thread_id": None,
        "subject": "Test Subject",
        "sender": "john.doe@example.com",
        "recipients": ["me@example.com"],
        "date_local": START,
        "date_offset_min": None,
        "text": "content",
        "html": None,
        "labels": None,
    }
    unknown = set(given) - set(row)
    assert not unknown, unknown
    return {**row, **given}


def frame(spark, rows):
    return spark.createDataFrame(
        [tuple(row[name] for name in MESSAGE.names) for row in rows], MESSAGE
    )


def after(minutes):
    return START + timedelta(minutes=minutes)
