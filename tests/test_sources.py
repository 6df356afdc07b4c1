import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postbag.schema import MESSAGE
from postbag.sources import registry
from postbag.sources.provider_json import mail_date, read_provider_json
from postbag.sources.registry import read_errors, read_mailbox, read_mailboxes, register_source
from postbag.sources.rfc822 import parse_files, read_rfc822, rfc822_errors
from tests.rows import frame, message


def encoded(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def header(name, value):
    return {"name": name, "value": value}


def part(mime_type, text):
    return {"mimeType": mime_type, "body": {"data": encoded(text)}}


MAIL = [
    {
        "id": "parts",
        "threadId": "t1",
        "labelIds": ["INBOX", "UNREAD"],
        "snippet": "not read",
        "payload": {
            "mimeType": "multipart/alternative",
            "headers": [
                header("Subject", "first"),
                header("SUBJECT", "last wins"),
                header("From", "Al <al@x>"),
                header("To", "a@x, b@x ,"),
                header("Date", "Mon, 15 Jan 2024 10:30:00 +0200 (EET)"),
            ],
            "parts": [
                part("text/plain", "overridden"),
                part("text/plain", "ünï >>> ???"),
                part("text/html", "<p>x</p>"),
                {"mimeType": "text/plain", "body": {"attachmentId": "1"}},
                {"mimeType": "multipart/mixed", "parts": [part("text/plain", "nested")]},
            ],
        },
    },
    {
        "id": "html",
        "payload": {
            "mimeType": "text/html",
            "headers": [header("date", "bogus")],
            "body": {"data": encoded("<b>only</b>")},
        },
    },
    {"id": "text", "payload": {"headers": [], "body": {"data": encoded("plain")}}},
    {"id": "none", "payload": {"mimeType": "text/plain", "headers": [], "body": {"size": 0}}},
    {"threadId": "no id"},
]


def test_provider_json(spark, tmp_path):
    (tmp_path / "mail.json").write_text("\n".join(json.dumps(m) for m in MAIL))
    read = read_provider_json(spark, str(tmp_path), "work")
    assert read.schema.names == MESSAGE.names
    rows = {row["uid"]: row.asDict() for row in read.collect()}
    assert set(rows) == {"parts", "html", "text", "none"}
    assert rows["parts"] == {
        "mailbox": "work",
        "folder": None,
        "uid": "parts",
        "thread_id": "t1",
        "subject": "last wins",
        "sender": "Al <al@x>",
        "recipients": ["a@x", "b@x"],
        "date_local": datetime(2024, 1, 15, 10, 30),
        "date_offset_min": 120,
        "text": "ünï >>> ???",
        "html": "<p>x</p>",
        "labels": ["INBOX", "UNREAD"],
    }
    html = rows["html"]
    assert (html["text"], html["html"], html["date_local"]) == (None, "<b>only</b>", None)
    assert (html["subject"], html["sender"], html["recipients"]) == ("", "", [])
    assert (rows["text"]["text"], rows["text"]["html"]) == ("plain", None)
    assert (rows["none"]["text"], rows["none"]["html"]) == (None, None)


def test_only_the_named_fields_are_read(spark, tmp_path):
    (tmp_path / "mail.json").write_text("\n".join(json.dumps(m) for m in MAIL))
    plan = read_provider_json(spark, str(tmp_path)).select("uid", "subject")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "parts" not in text[text.index("ReadSchema") :]


@pytest.mark.parametrize(
    "value, local, offset",
    [
        ("Mon, 15 Jan 2024 10:30:05 +0200", datetime(2024, 1, 15, 10, 30, 5), 120),
        ("1 Feb 2024 9:05 -0530", datetime(2024, 2, 1, 9, 5), -330),
        ("Thursday, 01-Feb-24 09:05:00 GMT", datetime(2024, 2, 1, 9, 5), 0),
        ("1 Feb 99 09:05:00 EST", datetime(1999, 2, 1, 9, 5), -300),
        ("1 Feb 2024 09:05:00 -0000", datetime(2024, 2, 1, 9, 5), None),
        ("1 Feb 2024 09:05:00", datetime(2024, 2, 1, 9, 5), None),
        ("31 Feb 2024 09:05:00 +0000", None, None),
        ("1 Foo 2024 09:05:00 +0000", None, None),
        ("yesterday", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_mail_date(spark, value, local, offset):
    row = spark.createDataFrame([(value,)], "v string").select(mail_date(F.col("v")).alias("d")).first()["d"]
    assert (row["local"] if row else None, row["offset"] if row else None) == (local, offset)


EML = b"""Subject: =?utf-8?B?w5xuw68=?=
From: Al <al@x>
To: a@x, b@x
Date: Mon, 15 Jan 2024 10:30:00 +0200
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: multipart/alternative; boundary=C

--C
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

na=EFve
--C
Content-Type: text/html; charset=utf-8

<p>x</p>
--C--
--B
Content-Type: text/plain
Content-Disposition: attachment; filename=a.txt

attached
--B--
"""


def test_rfc822(spark, tmp_path):
    (tmp_path / "Sent").mkdir()
    (tmp_path / "Sent" / "42.eml").write_bytes(EML)
    (tmp_path / "Sent" / "43.eml").write_bytes(b"Subject: bare\n\nbody\n")
    (tmp_path / "Sent" / "note.txt").write_text("no mail")
    rows = {row["uid"]: row for row in read_rfc822(spark, str(tmp_path), "home").collect()}
    assert set(rows) == {"42", "43"}
    mail = rows["42"]
    assert (mail["mailbox"], mail["folder"], mail["subject"], mail["sender"]) == ("home", "Sent", "Ünï", "Al <al@x>")
    assert mail["recipients"] == ["a@x", "b@x"]
    assert (mail["date_local"], mail["date_offset_min"]) == (datetime(2024, 1, 15, 10, 30), 120)
    assert (mail["text"].strip(), mail["html"].strip()) == ("naïve", "<p>x</p>")
    assert (rows["43"]["text"], rows["43"]["date_local"]) == ("body\n", None)


def test_a_bad_file_is_a_row_not_a_failure(spark):
    files = spark.createDataFrame([("p/1.eml", None), ("p/2.eml", bytearray(b"Subject: x\n\ny"))], "path string, content binary")
    rows = {row["path"]: row for row in parse_files(files).collect()}
    assert rows["p/1.eml"]["error"] and rows["p/1.eml"]["subject"] is None
    assert rows["p/2.eml"]["error"] is None and rows["p/2.eml"]["subject"] == "x"
    assert [(r.mailbox, r.source) for r in rfc822_errors(files, "m").collect()] == [("m", "p/1.eml")]


def test_an_odd_charset_loses_no_message(spark, tmp_path):
    odd = b"Subject: odd\nContent-Type: text/plain; charset=no-such-charset\nContent-Transfer-Encoding: 8bit\n\nab \xff \xc3\xa9\n"
    wrong = b"Subject: wrong\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nab \xff\n"
    packed = [("in/1.eml", bytearray(odd)), ("in/2.eml", bytearray(wrong))]
    spark.createDataFrame(packed, "path string, content binary").write.parquet(str(tmp_path / "packed"))
    found = {r.subject: r for r in read_mailbox(spark, "imap_packed", str(tmp_path / "packed"), "m").collect()}
    assert found["odd"].text == "ab \ufffd é\n" and found["wrong"].text == "ab \ufffd\n"
    assert found["odd"].folder == "in" and found["odd"].uid == "1"
    assert read_errors(spark, {"m": ("imap_packed", str(tmp_path / "packed"))}).collect() == []


def test_bad_lines_are_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(MAIL[0]) + '\n{not json\n{"threadId": "x"}\n\n')
    mailboxes = {"m": ("gmail", str(tmp_path)), "t": ("table", "unused")}
    assert [r.uid for r in read_mailboxes(spark, mailboxes, "m").collect()] == ["parts"]
    found = sorted(tuple(r) for r in read_errors(spark, mailboxes, "m,t").collect())
    assert found == [("m", '{"threadId": "x"}', "no message id"), ("m", "{not json", "no JSON")]


def test_registry(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "SOURCES", dict(registry.SOURCES))
    frame(spark, [message("1"), message("2")]).write.parquet(str(tmp_path / "m"))
    mailboxes = {"a": ("table", str(tmp_path / "m")), "b": ("table", str(tmp_path / "m"))}
    assert {r["mailbox"] for r in read_mailboxes(spark, mailboxes).collect()} == {"a"}
    assert read_mailboxes(spark, mailboxes, "b,a").count() == 4
    with pytest.raises(ValueError, match="c"):
        read_mailboxes(spark, mailboxes, "c")
    with pytest.raises(ValueError, match="pop3"):
        read_mailbox(spark, "pop3", "x", "x")
    register_source("rows", lambda session, path, name: frame(session, [message("9", mailbox=name)]))
    assert read_mailbox(spark, "rows", "", "mine").first()["mailbox"] == "mine"
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="subject"):
        read_mailbox(spark, "table", str(tmp_path / "other"), "x")
