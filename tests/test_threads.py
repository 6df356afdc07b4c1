from collections import Counter

import pytest
from pyspark.sql import functions as F

from postbag.operators import ordering
from postbag.operators.cleaning import with_content
from postbag.operators.filters import Criteria, search
from postbag.operators.ordering import with_order
from postbag.operators.threads import expand_threads, transcripts, with_thread_key
from tests.rows import after, frame, message

ROWS = [
    message("1", thread_id="t", sender="al@x"),
    message("2", thread_id="t", sender="bo@x", folder="sent"),
    message("3", thread_id="t", sender="al@x", mailbox="second"),
    message("4", thread_id="t", sender="al@x", folder="archive"),
    message("5", thread_id=None, sender="al@x"),
    message("5", thread_id="", sender="bo@x", folder="sent"),
    message("6", thread_id="u", sender="bo@x"),
]


def ids(found, *more):
    return sorted(tuple(row[c] for c in ("mailbox", "folder", "uid", *more)) for row in found.collect())


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_expand_threads(spark, broadcast_bytes):
    messages = frame(spark, ROWS)
    hits = search(messages, Criteria(sender="al@x"), ["first"])
    expected = [("first", "INBOX", "1", 2), ("first", "INBOX", "5", 1), ("first", "archive", "4", 2), ("first", "sent", "2", 2)]
    found = expand_threads(hits, messages, dedup=False, broadcast_bytes=broadcast_bytes)
    assert ids(found, "copies") == expected
    once = expand_threads(hits, messages, broadcast_bytes=broadcast_bytes)
    assert ids(once) == [e[:3] for e in expected]


def test_expansion_is_closed(spark):
    """Expanding what was expanded adds nothing."""
    messages = frame(spark, ROWS)
    once = expand_threads(messages.filter("uid = '2'"), messages)
    twice = expand_threads(once.drop("thread_key"), messages)
    assert ids(once) == ids(twice)


def test_fallback_keeps_hits_the_archive_does_not_know(spark):
    messages = frame(spark, ROWS)
    archive = messages.filter("uid IN ('1', '2')")
    for dedup in (True, False):
        found = expand_threads(messages.filter("mailbox = 'first'"), archive, dedup=dedup, fallback=True)
        assert ids(found) == [
            ("first", "INBOX", "1"), ("first", "INBOX", "5"), ("first", "INBOX", "6"),
            ("first", "sent", "2"), ("first", "sent", "5"),
        ]


def test_a_hot_thread_is_split_over_tasks(spark, tmp_path):
    """A third of all rows in one thread: the shuffled join cuts its partition into several."""
    rows = [
        message(str(i), thread_id="hot" if i % 3 == 0 else f"t{i}", text="x" * 2000) for i in range(6000)
    ]
    path = str(tmp_path / "m")
    frame(spark, rows).repartition(12).write.parquet(path)
    messages = spark.read.parquet(path)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = expand_threads(messages, messages, dedup=False, broadcast_bytes=0)
        # With the bodies: without them no partition is large.
        found = found.withColumn("task", F.spark_partition_id())
        tasks = Counter(row["task"] for row in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "SortMergeJoin(skew=true)" in plan
    assert sum(tasks.values()) == 6000
    assert max(tasks.values()) < 1500


def blocks(spark, rows):
    content = with_content(frame(spark, rows), headers=True)
    return with_thread_key(with_order(content, ["first"], ["INBOX"]))


def test_message_block(spark):
    rows = [
        message("1", sender="Newsletter <no-reply@example.com>", subject="", date_offset_min=120),
        message("2", subject=None, sender=None, text=None),
    ]
    found = {row["uid"]: row["content"] for row in blocks(spark, rows).collect()}
    assert found["1"] == (
        "From: Newsletter <no-reply@example.com>\nDate: 2024-01-15 10:30:00+02:00\nSubject: \n\ncontent"
    )
    assert found["2"] == "From: \nDate: 2024-01-15 10:30:00\nSubject: \n\n"


def test_transcripts(spark):
    rows = [
        message("2", thread_id="t", date_local=after(5), sender="b@x", text="second"),
        message("1", thread_id="t", date_local=after(0), sender="a@x", text="first"),
        message("3", thread_id="t", date_local=after(5), sender="c@x", text="third"),
        message("4", text="alone"),
    ]
    found = {row["thread_key"]: row for row in transcripts(blocks(spark, rows)).collect()}
    thread = found["t:t"]
    assert (thread["part"], thread["messages"]) == (0, 3)
    parts = thread["transcript"].split("\n---\n")
    assert [part.split("\n")[0] for part in parts] == ["From: a@x", "From: b@x", "From: c@x"]
    assert [part.split("\n\n")[1] for part in parts] == ["first", "second", "third"]
    assert found["m:|INBOX|4"]["messages"] == 1
    assert transcripts(blocks(spark, [])).count() == 0


def test_a_long_thread_comes_in_parts_that_make_up_the_whole(spark, monkeypatch):
    rows = [
        message(f"{i:04}", thread_id="hot" if i % 3 else f"t{i % 6}", date_local=after(i), text=f"text {i} " * 5)
        for i in range(900)
    ]
    whole = {r["thread_key"]: r["transcript"] for r in transcripts(blocks(spark, rows)).collect()}
    assert len(whole) == 3
    parts_of_one_range = sorted(map(tuple, transcripts(blocks(spark, rows), 1500).collect()))
    # As if the thread didn't fit one task.
    monkeypatch.setattr(ordering, "RANGE_BYTES", 5000)
    monkeypatch.setattr(ordering, "SMALL_RANGE", 200)
    cut = transcripts(blocks(spark, rows), 1500)
    assert sorted(map(tuple, cut.collect())) == parts_of_one_range
    by_thread = {}
    for row in sorted(cut.collect(), key=lambda r: (r["thread_key"], r["part"])):
        by_thread.setdefault(row["thread_key"], []).append(row["transcript"])
    assert {key: "\n---\n".join(parts) for key, parts in by_thread.items()} == whole
    assert max(len(part) for parts in by_thread.values() for part in parts) < 1500 + 200
    # The hot thread is worked on by all tasks.
    tasks = cut.filter("thread_key = 't:hot'").select(F.spark_partition_id()).distinct().count()
    assert tasks >= 3
