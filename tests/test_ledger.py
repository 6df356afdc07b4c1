import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postbag import AskOptions, run_ask
from postbag.operators.inference import infer
from postbag.operators.ledger import ask_once, call_key, read_ledger
from tests.rows import after, frame, message
from tests.test_asking import make_echo, no_wait, work


def logged(path, fails=lambda text: False, dies=lambda text: False, model="m"):
    """A completer that writes down every call; some fail for good, some take their process with them."""

    def make():
        def complete(prompt, content):
            with open(path, "a") as log:
                log.write(content + "\n")
            if dies(content):
                time.sleep(3)
                os._exit(1)
            if fails(content):
                raise ValueError("never")
            return {"content": f"{prompt}: {content}", "model": model, "usage_prompt_tokens": 1, "usage_completion_tokens": 2}

        return complete

    return make


def calls(path):
    return Counter(path.read_text().split("\n")[:-1]) if path.exists() else Counter()


TEXTS = [f"text {i}" for i in range(24)]


def test_no_finished_call_is_made_again(spark, tmp_path):
    log, chunks = tmp_path / "log", work(spark, *TEXTS, "")
    half = lambda text: int(text.split()[1]) >= 12
    ask = lambda **given: ask_once(chunks, "P", logged(log, **given), str(tmp_path / "ledger"), attempts=1, sleep=no_wait, calls_per_task=5)
    first = ask(fails=half).collect()
    assert sum(r["response"] is not None for r in first) == 12 and sum(r["error"] == "ValueError: never" for r in first) == 12
    again = ask(model="other").collect()
    assert calls(log) == Counter({t: 2 if half(t) else 1 for t in TEXTS})
    models = {r["chunk"]: r["response"]["model"] for r in again if r["chunk"]}
    assert models == {t: "other" if half(t) else "m" for t in TEXTS} and not any(r["error"] for r in again)
    empty = [r for r in again if r["chunk"] is None]
    assert [(r["response"], r["attempts"], r["error"]) for r in empty] == [(None, 0, None)]
    ask()
    assert sum(calls(log).values()) == 36


def test_answers_outlive_a_broken_run(spark, tmp_path):
    log, chunks, ledger = tmp_path / "log", work(spark, *TEXTS), str(tmp_path / "ledger")
    with pytest.raises(Exception):
        ask_once(chunks, "P", logged(log, dies=lambda text: text == "text 7"), ledger, attempts=1, sleep=no_wait, calls_per_task=1)
    kept = {r["call_key"] for r in read_ledger(spark, ledger, "P").collect()}
    assert len(kept) > 8  # tasks that had ended, though the job didn't
    before = calls(log)
    found = ask_once(chunks, "P", logged(log), ledger, attempts=1, sleep=no_wait, calls_per_task=1).withColumn("key", call_key("P")).collect()
    assert len(found) == 24 and all(r["response"] is not None for r in found)
    finished = {r["chunk"] for r in found if r["key"] in kept}
    assert all(calls(log)[t] == before[t] == 1 for t in finished) and len(finished) == len(kept)


def test_the_same_as_without_a_ledger(spark, tmp_path):
    chunks = work(spark, "hello there", "null", "please fail", "", "one. " * 60)
    plain = infer(chunks, "P", make_echo, attempts=1, sleep=no_wait)
    for concurrency in (None, 2):
        found = ask_once(chunks, "P", make_echo, str(tmp_path / f"l{concurrency}"), 1, concurrency, sleep=no_wait, calls_per_task=2)
        assert found.schema.names == plain.schema.names
        assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)


def test_keys_tell_calls_apart(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    rows = [message("1", text="same"), message("2", text="same"), message("1", text="same", mailbox="second")]
    from postbag.operators.cleaning import with_content
    from postbag.operators.packing import chunked, single_items

    chunks = chunked(single_items(with_content(frame(spark, rows))), size=100)
    # The same message listed twice is asked about once.
    doubled = chunks.unionByName(chunks)
    assert ask_once(doubled, "P", logged(log), ledger, sleep=no_wait).filter("response IS NOT NULL").count() == 6
    assert calls(log) == Counter({"same": 3})
    ask_once(chunks, "Q", logged(log), ledger, sleep=no_wait)
    assert calls(log) == Counter({"same": 6})
    keys = chunks.select(call_key("P").alias("k")).union(chunks.withColumn("chunk_ix", F.lit(1)).select(call_key("P")))
    assert keys.distinct().count() == 6


def test_a_run_with_a_ledger(spark, tmp_path):
    log = tmp_path / "log"
    rows = [message(str(i), text=f"a longer text {i}", date_local=after(i)) for i in range(6)]
    options = lambda name: AskOptions("P", output_dir=str(tmp_path / name), attempts=1, ledger=str(tmp_path / "ledger"))
    broken = run_ask(frame(spark, rows), options("one"), logged(log, fails=lambda t: t > "a longer text 2"), ["first"])
    assert broken.stats.first()["emails_failed"] == 3
    done = run_ask(frame(spark, rows), options("two"), logged(log), ["first"])
    assert done.stats.first()["emails_failed"] == 0 and done.records.count() == 6
    assert calls(log) == Counter({f"a longer text {i}": 1 if i < 3 else 2 for i in range(6)})


def test_a_written_table_is_not_written_again_and_texts_move_once(spark, tmp_path, monkeypatch):
    from postbag.operators import ledger
    from postbag.session import is_written, pin

    kinds, real = [], ledger.pin
    monkeypatch.setattr(ledger, "pin", lambda df, kind: kinds.append((kind, df.columns)) or real(df, kind))
    plans, infer = [], ledger.infer
    monkeypatch.setattr(ledger, "infer", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or infer(df, *a))
    chunks, log = work(spark, *TEXTS), tmp_path / "log"
    written = pin(chunks, "chunks")
    assert is_written(written) and not is_written(chunks) and not is_written(written.filter("chunk > 'a'"))
    found = ask_once(written, "P", logged(log), str(tmp_path / "ledger"), sleep=no_wait, calls_per_task=5)
    assert kinds == [("answered", ["call_key"])]
    ask_once(chunks, "P", logged(log), str(tmp_path / "ledger"), sleep=no_wait)
    assert kinds[1][0] == "calls" and calls(log) == Counter(TEXTS)
    assert found.filter("response IS NOT NULL").count() == 24
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning(call_key") == 1 and plans[0].count("Exchange") == 1
