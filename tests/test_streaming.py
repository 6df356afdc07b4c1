import json

import pytest

from postbag import AskOptions
from postbag.operators import ordering
from postbag.operators.cleaning import with_content
from postbag.operators.filters import Criteria, search
from postbag.operators.reports import Progress, run_stats
from postbag.plans import ask as plans_ask
from postbag.plans.ask import ask
from postbag.session import input_bytes
from postbag.sources.archive import ThreadArchive
from postbag.sources.records import read_records, records
from postbag.streaming import jobs
from postbag.streaming.jobs import (
    ask_arrived,
    ask_stream,
    buffer_size,
    finish_batches,
    message_stream,
    provider_json_stream,
    responses_path,
    run_each,
    write_asked_stream,
    write_records_stream,
    write_stream,
)
from tests.rows import after, frame, message
from tests.test_asking import make_echo
from tests.test_sources import MAIL


def test_buffer_size():
    assert buffer_size(8192) == 327
    assert buffer_size(100) == 10


def land(spark, path, rows):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def contents(spark, path):
    read = spark.read.schema("mailbox string, uid string, content string").parquet(path)
    return sorted((r["uid"], r["content"]) for r in read.collect())


def test_a_stream_equals_the_batch_and_takes_each_file_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))

    def run():
        found = search(message_stream(spark, source, max_files=2), Criteria(sender="john"))
        query = write_stream(with_content(found).select("mailbox", "uid", "content"), out, checkpoint)
        query.awaitTermination()
        return query

    for i in range(3):
        land(spark, source, [message(f"{i}{j}", text=f" text {i}{j}\n> quoted") for j in range(4)])
    run()
    batch = with_content(search(spark.read.parquet(source), Criteria(sender="john")))
    assert contents(spark, out) == sorted((r["uid"], r["content"]) for r in batch.collect())
    one_by_one = message_stream(spark, source, max_bytes="1").select("uid")
    query = write_stream(one_by_one, str(tmp_path / "bytes"), str(tmp_path / "bytes-checkpoint"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows == 4]) == 3
    land(spark, source, [message("99", text="late"), message("98", sender="other")])
    run()
    assert len(contents(spark, out)) == 13
    query = run()
    assert not query.isActive and len(contents(spark, out)) == 13


def test_ask_stream_equals_ask(spark, tmp_path):
    source = str(tmp_path / "in")
    land(spark, source, [message(str(i), text=f"this is text {i}", date_local=after(i)) for i in range(5)])
    options = AskOptions("P")
    seen = []
    listener = Progress(lambda rows, total: seen.append((rows, total)))
    spark.streams.addListener(listener)
    try:
        stream = ask_stream(message_stream(spark, source), options, make_echo)
        write_records_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    batch = records(ask(spark.read.parquet(source), options, make_echo, ["first"]))
    streamed = read_records(spark, str(tmp_path / "out"))
    shown = ["output_key", "email", "response"]
    assert sorted(streamed.select(*shown).collect()) == sorted(batch.select(*shown).collect())
    assert all(total >= rows for rows, total in seen)


def test_batches_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(2):
        land(spark, source, [message(f"{i}{j}", text=f"text number {i}{j}", date_local=after(j)) for j in range(5)])
    options = AskOptions("P", batch=True, batch_size=3)
    for _ in range(2):  # the second time there is nothing new
        stream = message_stream(spark, source, max_files=1)
        write_asked_stream(stream, options, make_echo, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    found = read_records(spark, str(tmp_path / "out"), batch=True).collect()
    assert sorted(len(r["emails"]) for r in found) == [2, 2, 3, 3]


def test_bad_lines_do_not_stop_a_mailbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = {"mimeType": "text/plain", "headers": [], "body": {"data": "no base64!"}}
    unreadable, nameless = json.dumps({"id": "odd", "payload": body}), json.dumps({"threadId": "t"})
    lines = [json.dumps(MAIL[0]), "{not json", json.dumps(MAIL[1]), nameless, unreadable, ""]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    good, bad = provider_json_stream(spark, str(tmp_path / "in"), "work")
    write_stream(good.select("uid"), str(tmp_path / "good"), str(tmp_path / "c1")).awaitTermination()
    write_stream(bad, str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["uid"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["html", "odd", "parts"]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == sorted(
        [("work", "{not json", "no JSON"), ("work", nameless, "no message id"), ("work", unreadable, "unreadable body")]
    )


def test_threads_of_a_stream_come_from_a_table(spark, tmp_path):
    archive = frame(spark, [message(str(i), thread_id="t" if i < 3 else None, text=f"number {i}") for i in range(5)])
    hits = [message("1", thread_id="t"), message("2", thread_id="t"), message("4"), message("7", thread_id="new")]
    land(spark, str(tmp_path / "in"), hits)
    stream = message_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write_asked_stream(
        stream, AskOptions("P", thread=True), make_echo, out, str(tmp_path / "c"), archive
    ).awaitTermination()
    found = read_records(spark, out).collect()
    assert sorted(r["email"]["uid"] for r in found) == ["0", "1", "2", "4", "7"]
    assert all("From: john.doe@example.com" in r["response"]["content"] for r in found)


def make_failing():
    def complete(prompt, content):
        if "told to fail" in content:
            raise ValueError(content)
        return {"content": f"answer to {content}"}

    return complete


def test_failures_of_a_stream_are_kept(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [message(str(i), text="told to fail" if i % 2 else "fine") for i in range(4)])
    for name, options in (("one", AskOptions("P", attempts=1)), ("batch", AskOptions("P", attempts=1, batch=True, batch_size=1))):
        out, stream = str(tmp_path / name), message_stream(spark, str(tmp_path / "in"))
        if options.batch:
            query = write_asked_stream(stream, options, make_failing, out, f"{out}-c")
        else:
            query = write_records_stream(ask_stream(stream, options, make_failing), out, f"{out}-c")
        query.awaitTermination()
        assert read_records(spark, out, batch=options.batch).count() == 2
        kept = spark.read.parquet(responses_path(out))
        stats = run_stats(kept).first()
        assert (stats["emails_processed"], stats["emails_failed"]) == (2, 2)


@pytest.mark.parametrize("option", [{"max_emails": 2}, {"dry_run": True}, {"batch": True}])
def test_what_a_stream_cannot_do_is_an_error(spark, tmp_path, option):
    options, stream = AskOptions("P", **option), message_stream(spark, str(tmp_path))
    with pytest.raises(ValueError, match=next(iter(option))):
        ask_stream(stream, options, make_echo)
    if "batch" not in option:
        with pytest.raises(ValueError, match=next(iter(option))):
            write_asked_stream(stream, options, make_echo, str(tmp_path / "o"), str(tmp_path / "c"))


def batches_of(spark, path):
    found = spark.read.option("recursiveFileLookup", "true").parquet(responses_path(path)).collect()
    return {r["item_id"]: [e["uid"] for e in r["emails"]] for r in found if r["chunk_ix"] == 0}


def expected_batches(spark, source, options):
    found = ask(spark.read.parquet(source), options, make_echo, ["first"]).filter("chunk_ix = 0").collect()
    return {r["item_id"]: [e["uid"] for e in r["emails"]] for r in found}


def land_in_order(spark, source, sizes, start=0):
    for n in sizes:
        rows = [message(f"{start + j:03}", text=f"text {start + j} " + "x" * ((start + j) * 7 % 40), date_local=after(start + j)) for j in range(n)]
        land(spark, source, rows)
        start += n
    return start


@pytest.mark.parametrize("size", [4, "fit"])
def test_batches_go_on_from_micro_batch_to_micro_batch(spark, tmp_path, size):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "c"))
    options = AskOptions("P", batch=True, batch_size=size, max_context=1150)
    start = land_in_order(spark, source, [3, 1, 6])
    stream = lambda: message_stream(spark, source, max_files=1)
    write_asked_stream(stream(), options, make_echo, out, checkpoint, carry=True).awaitTermination()
    so_far = batches_of(spark, out)
    # The open batch waits, and goes on after a restart.
    assert so_far == {k: v for k, v in expected_batches(spark, source, options).items() if k in so_far}
    assert sum(map(len, so_far.values())) < 10
    land_in_order(spark, source, [2, 7], start)
    ask_arrived(stream(), options, make_echo, out, checkpoint)
    assert batches_of(spark, out) == expected_batches(spark, source, options)
    finish_batches(spark, options, make_echo, out)  # nothing is left
    assert batches_of(spark, out) == expected_batches(spark, source, options)
    # What comes later begins a new batch.
    land(spark, source, [message("900", text="late", date_local=after(900))])
    ask_arrived(stream(), options, make_echo, out, checkpoint)
    found = batches_of(spark, out)
    assert sorted(u for b in found.values() for u in b) == [f"{i:03}" for i in range(19)] + ["900"] and ["900"] in found.values()


def test_a_repeated_micro_batch_starts_from_the_same_state(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "c"))
    options = AskOptions("P", batch=True, batch_size=4)
    land_in_order(spark, source, [3, 3, 5])
    written, fail = jobs._write_micro_batch, {1: True}

    def breaks(responses, path, number, batch):
        if fail.pop(number, False):
            raise RuntimeError("lost between state and answers")
        written(responses, path, number, batch)

    monkeypatch.setattr(jobs, "_write_micro_batch", breaks)
    with pytest.raises(Exception, match="lost between"):
        write_asked_stream(message_stream(spark, source, max_files=1), options, make_echo, out, checkpoint, carry=True).awaitTermination()
    ask_arrived(message_stream(spark, source, max_files=1), options, make_echo, out, checkpoint)
    assert batches_of(spark, out) == expected_batches(spark, source, options)


def test_a_broken_tail_is_asked_about_in_its_place(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "c"))
    options = AskOptions("P", batch=True, batch_size=4)
    start = land_in_order(spark, source, [3])
    stream = lambda: message_stream(spark, source, max_files=1)
    leave = jobs._leave
    monkeypatch.setattr(jobs, "_leave", lambda rows, path, name, *rest: leave(rows, path, name, *rest) if "tail" not in name else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ask_arrived(stream(), options, make_echo, out, checkpoint)
    monkeypatch.setattr(jobs, "_leave", leave)
    land_in_order(spark, source, [2], start)
    ask_arrived(stream(), options, make_echo, out, checkpoint)
    assert sorted(batches_of(spark, out).values()) == [["000", "001", "002"], ["003", "004"]]


def test_an_open_batch_waits_so_long(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "c"))
    options = AskOptions("P", batch=True, batch_size=4)
    start = land_in_order(spark, source, [3])
    run = lambda: write_asked_stream(message_stream(spark, source), options, make_echo, out, checkpoint, carry=True, longest_wait=0).awaitTermination()
    run()
    assert batches_of(spark, out) == {} if spark.read.option("recursiveFileLookup", "true").parquet(responses_path(out)).count() else True
    land_in_order(spark, source, [2], start)
    run()
    assert list(batches_of(spark, out).values()) == [["000", "001", "002"]]


def test_only_batches_are_carried_on(spark, tmp_path):
    with pytest.raises(ValueError, match="batches"):
        write_asked_stream(message_stream(spark, str(tmp_path)), AskOptions("P"), make_echo, str(tmp_path / "o"), str(tmp_path / "c"), carry=True)
    finish_batches(spark, AskOptions("P", batch=True), make_echo, str(tmp_path / "o"))  # no run, nothing to do


def test_a_broken_mailbox_ends_no_other(spark, tmp_path):
    land(spark, str(tmp_path / "one"), [message("1")])
    land(spark, str(tmp_path / "three"), [message("3", mailbox="three")])
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.parquet").write_text("no table")
    clean = lambda name: write_stream(with_content(message_stream(spark, str(tmp_path / name))).select("mailbox", "uid", "content"), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-c"))
    starts = {name: (lambda name=name: clean(name)) for name in ("one", "two", "three")}
    starts["four"] = lambda: message_stream(spark, str(tmp_path / "nowhere" / "x")).writeStream.start()
    errors = {r["mailbox"]: r["error"] for r in run_each(spark, starts).collect()}
    assert set(errors) == {"two", "four"} and all(errors.values())
    assert [u for u, _ in contents(spark, str(tmp_path / "one-out"))] == ["1"]
    assert [u for u, _ in contents(spark, str(tmp_path / "three-out"))] == ["3"]


def test_threads_of_a_stream_read_the_folders_they_need(spark, tmp_path, monkeypatch):
    archive = ThreadArchive(str(tmp_path / "archive"), buckets=16)
    assert archive.of(spark.createDataFrame([("first", "t:t1")], "mailbox string, thread_key string")).count() == 0
    rows = [message(str(i), thread_id=f"t{i % 20}", text=f"number {i}", date_local=after(i)) for i in range(60)]
    for half in (rows[:30], rows[30:] + [message("alone")]):
        archive.add(frame(spark, half))
    every = archive.all(spark)
    assert every.count() == 60
    hits = [message("5", thread_id="t5"), message("7", thread_id="t7"), message("90"), message("91", thread_id="new")]
    land(spark, str(tmp_path / "in"), hits)
    read, of = [], ThreadArchive.of

    def noted(self, threads):
        read.append(of(self, threads))
        return read[-1]

    monkeypatch.setattr(ThreadArchive, "of", noted)
    out = str(tmp_path / "out")
    write_asked_stream(
        message_stream(spark, str(tmp_path / "in")), AskOptions("P", thread=True), make_echo, out, str(tmp_path / "c"), archive
    ).awaitTermination()
    found = read_records(spark, out).collect()
    assert sorted(r["email"]["uid"] for r in found) == sorted(["5", "25", "45", "7", "27", "47", "90", "91"])
    assert len(read) == 1 and 0 < len(read[0].inputFiles()) <= len(every.inputFiles()) // 3


def test_the_archive_is_read_once_for_a_micro_batch(spark, tmp_path):
    frame(spark, [message(str(i), thread_id=f"t{i % 4}") for i in range(20)]).write.parquet(str(tmp_path / "t"))
    archive = spark.read.parquet(str(tmp_path / "t"))
    found = jobs._expanded(frame(spark, [message("1", thread_id="t1"), message("2", thread_id="gone")]), archive)
    assert found.count() == 6
    # What has been found was written; the plan has no scan of the archive left.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "t") not in plan


def test_a_stream_of_few_files_is_dealt_out(spark, tmp_path):
    """One file with one row group is cleaned and asked about by more than one task."""
    frame(spark, [message(str(i), text=f"text {i}") for i in range(200)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = jobs.ask_stream(jobs.message_stream(spark, str(tmp_path / "in")), AskOptions("P", attempts=1), make_echo)
    jobs.write_records_stream(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    kept = spark.read.parquet(jobs.responses_path(str(tmp_path / "out")))
    assert kept.count() == 200 and len(kept.inputFiles()) > 4


@pytest.mark.parametrize("carry", [False, True])
def test_batches_of_few_ranges_are_dealt_out(spark, tmp_path, monkeypatch, carry):
    """Batches made in more than one range but fewer than there are cores: the calls use all cores."""
    frame(spark, [message(f"{i:03}", text=f"text {i}", date_local=after(i)) for i in range(200)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    size = input_bytes(spark.read.parquet(str(tmp_path / "in")))
    for module in (ordering, plans_ask):
        monkeypatch.setattr(module, "RANGE_BYTES", size // 2)
    monkeypatch.setattr(ordering, "SMALL_RANGE", 10)
    options = AskOptions("P", batch=True, batch_size=5, attempts=1)
    write_asked_stream(message_stream(spark, str(tmp_path / "in")), options, make_echo, str(tmp_path / "out"), str(tmp_path / "checkpoint"), carry=carry).awaitTermination()
    kept = spark.read.parquet(f"{responses_path(str(tmp_path / 'out'))}/micro_batch=0")
    assert kept.count() in (39, 40) and len(kept.inputFiles()) > 4
