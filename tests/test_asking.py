import json

import pytest

from postbag import AskOptions, run_ask
from postbag.operators import reports
from postbag.operators.inference import answered, failed, infer, wait_before
from postbag.operators.packing import chunked, single_items
from postbag.operators.cleaning import with_content
from postbag.plans.ask import fetch
from postbag.session import pin
from postbag.sources.records import (
    default_output_dir,
    read_records,
    records,
    run_ids,
    with_verdict,
    write_records,
)
from tests.rows import after, frame, message


def no_wait(seconds):
    pass


def make_echo():
    def complete(prompt, content):
        if "fail" in content:
            raise ValueError("told to fail")
        if "nothing" in content:
            return {"content": "nothing was found"}
        if "null" in content:
            return {"content": None, "usage_prompt_tokens": 10, "usage_completion_tokens": None}
        return {
            "content": f"{prompt}: {content}",
            "model": "echo",
            "usage_prompt_tokens": 2,
            "usage_completion_tokens": 1,
        }

    return complete


def make_flaky():
    calls = {}

    def complete(prompt, content):
        calls[content] = calls.get(content, 0) + 1
        if calls[content] < 3:
            raise ConnectionError("try again")
        return {"content": f"answer at attempt {calls[content]}"}

    return complete


def work(spark, *bodies, **given):
    rows = [message(str(i), text=body, date_local=after(i), **given) for i, body in enumerate(bodies)]
    return chunked(single_items(with_content(frame(spark, rows))), size=100)


def test_infer(spark):
    found = infer(work(spark, "hello there", "null", "please fail", ""), "P", make_echo, sleep=no_wait)
    rows = {row["item_id"][-1]: row for row in found.collect()}
    assert rows["0"]["response"].asDict() == {
        "content": "P: hello there",
        "model": "echo",
        "usage_prompt_tokens": 2,
        "usage_completion_tokens": 1,
    }
    assert rows["0"]["attempts"] == 1 and rows["0"]["error"] is None
    assert rows["1"]["response"]["content"] == "" and rows["1"]["response"]["usage_prompt_tokens"] == 10
    assert rows["1"]["response"]["usage_completion_tokens"] == 0
    assert rows["2"]["response"] is None and rows["2"]["attempts"] == 3
    assert rows["2"]["error"] == "ValueError: told to fail"
    assert rows["3"]["response"] is None and rows["3"]["attempts"] == 0 and rows["3"]["error"] is None
    assert answered(found).count() == 2 and failed(found).count() == 1


def test_retry_and_concurrency(spark):
    found = infer(work(spark, "a b c d", "e f g h"), "P", make_flaky, sleep=no_wait, concurrency=2)
    assert found.rdd.getNumPartitions() == 2
    assert [(r["attempts"], r["response"]["content"]) for r in found.collect()] == [(3, "answer at attempt 3")] * 2
    assert failed(infer(work(spark, "x"), "P", make_flaky, attempts=2, sleep=no_wait)).count() == 1
    assert [wait_before(n) for n in range(2, 8)] == [1, 2, 4, 8, 10, 10]


def test_messages_keep_their_metadata(spark):
    found = infer(work(spark, "one. " * 100, subject="Ünï"), "P", make_echo, sleep=no_wait)
    assert {(r["emails"][0]["subject"], tuple(r["emails"][0]["recipients"])) for r in found.collect()} == {
        ("Ünï", ("me@example.com",))
    }
    assert sorted(r["chunk_ix"] for r in found.collect()) == [0, 1, 2, 3, 4]


def run(spark, rows, tmp_path, **options):
    options = {"prompt": "P", "output_dir": str(tmp_path / "out"), "attempts": 1, **options}
    return run_ask(frame(spark, rows), AskOptions(**options), make_echo, ["first", "second"])


def json_lines(path):
    return [json.loads(line) for file in path.rglob("*.json") for line in file.read_text().splitlines()]


def test_run_ask(spark, tmp_path):
    rows = [
        message("1", text="<hello there>", date_offset_min=120, subject="Q3 büdget"),
        message("2", text="nothing", date_local=after(1)),
        message("3", text="please fail", date_local=after(2)),
        message("4", text="", date_local=after(3)),
        message("5", text="elsewhere", mailbox="second"),
        message("6", text="sent mail", folder="sent"),
    ]
    result = run(spark, rows, tmp_path)
    assert result.path == str(tmp_path / "out")
    (line,) = json_lines(tmp_path / "out")
    assert line.pop("timestamp")
    assert line == {
        "output_key": "240115-103000-john-doe-q3-budget.jsonl",
        "email": {
            "uid": "1",
            "subject": "Q3 büdget",
            "sender": "john.doe@example.com",
            "recipients": ["me@example.com"],
            "date": "2024-01-15T10:30:00+02:00",
        },
        "response": {
            "content": "P: <hello there>",
            "model": "echo",
            "usage_prompt_tokens": 2,
            "usage_completion_tokens": 1,
        },
    }
    assert result.stats.first().asDict() == {
        "emails_fetched": 4,
        "emails_processed": 3,
        "emails_failed": 1,
        "calls": 2,
        "retries": 0,
        "tokens_used": 3,
        "records_written": 1,
        "answers_skipped": 1,
        "distinct_keys": 1,
        "no_emails": False,
    }
    assert [tuple(r) for r in result.counts.collect()] == [("first", 4), ("Total", 4)]
    (error,) = result.errors.collect()
    assert error.asDict() == {
        "mailbox": "first",
        "errors": 1,
        "last_errors": "no answer on [Test Subject]: ValueError: told to fail",
        "more": 0,
    }


def test_run_ask_in_batches(spark, tmp_path):
    rows = [message(f"{i:02}", text=f"text {i}", date_local=after(i)) for i in range(12)]
    result = run(spark, rows, tmp_path, batch=True, batch_size=5)
    lines = sorted(json_lines(tmp_path / "out"), key=lambda line: line["emails"][0]["uid"])
    assert [len(line["emails"]) for line in lines] == [5, 5, 2]
    assert lines[0]["response"]["content"] == "P: " + "\n---\n".join(f"text {i}" for i in range(5))
    assert lines[1]["output_key"].startswith("240115-103500-")
    assert set(lines[0]["emails"][0]) == {"uid", "subject", "sender", "recipients", "date"}
    assert result.stats.first()["emails_processed"] == 12
    fitted = run(spark, rows, tmp_path / "fit", batch=True, batch_size="fit")
    assert fitted.stats.first()["calls"] == 1


def test_a_failed_batch_fails_all_its_messages(spark, tmp_path):
    rows = [message(f"{i:02}", text=f"text {i}" if i else "fail", date_local=after(i)) for i in range(12)]
    stats = run(spark, rows, tmp_path, batch=True, batch_size=5).stats.first()
    assert (stats["emails_failed"], stats["emails_processed"]) == (5, 7)


def test_run_ask_with_threads(spark, tmp_path):
    rows = [
        message("1", thread_id="t", text="question one", sender="al@x"),
        message("2", thread_id="t", text="the answer", folder="sent", date_local=after(1)),
        message("3", thread_id="t", text="question two", sender="al@x", date_local=after(2)),
        message("4", text="other"),
    ]
    result = run(spark, rows, tmp_path, thread=True, sender="al")
    lines = json_lines(tmp_path / "out")
    assert sorted(line["email"]["uid"] for line in lines) == ["1", "2", "3"]
    assert "P: From: al@x\nDate: 2024-01-15 10:30:00\nSubject: Test Subject\n\nquestion one" in {
        line["response"]["content"] for line in lines
    }
    # Two hits: the search shows the thread twice, each message is asked about once.
    stats = result.stats.first()
    assert (stats["emails_fetched"], stats["calls"]) == (6, 3)
    limited = fetch(frame(spark, rows), AskOptions("P", thread=True, sender="al", max_emails=3), ["first"])
    assert sorted((r["uid"], r["copies"]) for r in limited.collect()) == [("1", 2), ("3", 1)]


def test_nothing_found_and_dry_run(spark, tmp_path):
    result = run(spark, [message("1")], tmp_path, subject="no such subject")
    assert result.stats.first()["no_emails"] is True
    assert [tuple(r) for r in result.counts.collect()] == [("first", 0), ("Total", 0)]
    dry = run(spark, [message("1", text="hello there")], tmp_path / "dry", dry_run=True)
    assert dry.path is None and not (tmp_path / "dry").exists()
    assert dry.records.count() == 1


def test_without_a_list_of_mailboxes_all_are_asked(spark, tmp_path):
    rows = [message("1", mailbox=name, text=f"hello {name}") for name in ("b", "a", "b")]
    options = AskOptions("P", output_dir=str(tmp_path / "out"), batch=True, batch_size=2)
    result = run_ask(frame(spark, rows[:2]), options, make_echo)
    assert result.records.first()["response"]["content"] == "P: hello a\n---\nhello b"
    assert [tuple(r) for r in result.counts.collect()] == [("a", 1), ("b", 1), ("Total", 2)]
    single = run_ask(frame(spark, rows[:2]), AskOptions("P", dry_run=True), make_echo)
    assert [tuple(r) for r in single.counts.collect()] == [("a", 1), ("b", 1), ("Total", 2)]


def test_max_emails(spark, tmp_path):
    rows = [message(str(i), text=f"Hello number {i}", date_local=after(i)) for i in range(10)]
    assert run(spark, rows, tmp_path, max_emails=3).stats.first()["emails_fetched"] == 3


def test_a_run_is_written_once(spark, tmp_path, monkeypatch):
    found = records(pin(infer(work(spark, "hello there", "good morning"), "P", make_echo, sleep=no_wait), "responses"))
    path = str(tmp_path / "out")
    contents = lambda: sorted(r["content"] for r in read_records(spark, path).select("response.content").collect())
    write_records(found.limit(1), path, run_id="one")
    # A run breaks between writing and its mark, and is repeated.
    with monkeypatch.context() as broken:
        broken.setattr("postbag.sources.records.create_file", lambda *given: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write_records(found, path, run_id="two")
    assert len(contents()) == 1 and run_ids(spark, path) == ["one"]
    for _ in range(2):
        write_records(found, path, run_id="two")
        assert len(contents()) == 3 and run_ids(spark, path) == ["one", "two"]
    # While a run is repeated it isn't there.
    with monkeypatch.context() as broken:
        broken.setattr("postbag.sources.records.create_file", lambda *given: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write_records(found.limit(0), path, run_id="one")
    assert len(contents()) == 2
    with pytest.raises(ValueError):
        write_records(found, path, run_id="../elsewhere")
    only_broken = str(tmp_path / "broken")
    found.write.json(f"{only_broken}/run_id=x")
    assert read_records(spark, only_broken).collect() == []


def test_a_named_run_replaces_itself(spark, tmp_path):
    rows = [message("1", text="hello there"), message("2", text="good morning", date_local=after(1))]
    for _ in range(2):
        run(spark, rows, tmp_path, run_id="monday")
    assert len(json_lines(tmp_path / "out")) == 2
    run(spark, rows[:1], tmp_path, run_id="tuesday")
    assert read_records(spark, str(tmp_path / "out")).count() == 3


def test_records_are_appended_and_read_back(spark, tmp_path):
    found = pin(infer(work(spark, "hello there", "nothing"), "P", make_echo, sleep=no_wait), "responses")
    path = str(tmp_path / "out")
    write_records(records(found), path)
    write_records(records(found), path)
    read = read_records(spark, path)
    assert [r["content"] for r in read.select("response.content").collect()] == ["P: hello there"] * 2
    write_records(records(found), str(tmp_path / "keyed"), per_key_files=True)
    assert [p.name for p in (tmp_path / "keyed").glob("run_id=*/output_key=*")] == [
        "output_key=240115-103000-john-doe-test-subject.jsonl"
    ]
    assert read_records(spark, str(tmp_path / "keyed")).first()["output_key"].endswith("test-subject.jsonl")
    assert default_output_dir().startswith("output/")


def test_verdicts_leave_failures_out(spark):
    found = with_verdict(infer(work(spark, "hello there", "nothing", "fail"), "P", make_echo, sleep=no_wait))
    assert sorted(str(r["is_empty"]) for r in found.collect()) == ["False", "None", "True"]


def test_error_report_keeps_the_last_of_many(spark):
    found = pin(infer(work(spark, *[f"fail {i}" for i in range(50)]), "P", make_echo, attempts=1), "responses")
    report = reports.error_report(found)
    row = report.first()
    assert (row["errors"], row["more"], row["last_errors"].count("told to fail")) == (50, 47, 3)
    # Each task keeps three errors before the shuffle.
    assert "WindowGroupLimit" in report._jdf.queryExecution().executedPlan().toString()


def test_counts_with_several_mailboxes(spark):
    rows = [message("1"), message("2"), message("3", mailbox="second")]
    counts = reports.mailbox_counts(frame(spark, rows), ["third", "second", "first"])
    assert [tuple(r) for r in counts.collect()] == [("third", 0), ("second", 1), ("first", 2), ("Total", 3)]


def test_observed(spark):
    df, observation = reports.observed(spark.range(7), "progress")
    df.collect()
    assert observation.get["rows"] == 7


def test_options():
    options = AskOptions("P", sender=" a, b ", boxes=["x"], date_from="2024-01-15T10:00:00")
    assert options.sender == ["a", "b"] and options.boxes == ["x"]
    assert str(options.criteria.date_from) == "2024-01-15"
    with pytest.raises(ValueError):
        AskOptions("P", date_to="yesterday")


def test_copies_count_in_batches(spark, tmp_path):
    rows = [message(str(i), thread_id="t", text=f"number {i}", date_local=after(i)) for i in range(3)]
    given = {"thread": True, "batch": True, "batch_size": 3}
    result = run_ask(frame(spark, rows), AskOptions("P", output_dir=str(tmp_path / "o"), **given), make_echo, ["first"])
    # Three hits in one thread of three messages: each message is found three times and fills a batch.
    assert sorted(len(r["emails"]) for r in result.responses.collect()) == [1, 1, 1]
    assert result.stats.first()["emails_fetched"] == 9
    assert [tuple(r) for r in result.counts.collect()] == [("first", 9), ("Total", 9)]
