import random

import pytest
from pyspark.sql import functions as F

from postbag.functions.chunks import chunk_size, chunks, fixed_chunks, token_count, token_estimate
from postbag.operators import ordering
from postbag.operators.cleaning import with_content
from postbag.operators.ordering import limit, running_sums, with_order
from postbag.operators.packing import batch_items, batches, chunked, fitted_batches, single_items
from postbag.operators.threads import transcripts, with_thread_key
from tests.rows import after, frame, message


def ordered(spark, rows, mailboxes=("first", "second"), folders=("INBOX", "sent")):
    return with_order(frame(spark, rows), list(mailboxes), list(folders))


def shuffled(rows):
    rows = list(rows)
    random.Random(7).shuffle(rows)
    return rows


@pytest.fixture(params=["one range", "many ranges"])
def ranges(request, monkeypatch):
    """Small tables as they are, and as if a range held next to nothing."""
    if request.param == "many ranges":
        monkeypatch.setattr(ordering, "RANGE_BYTES", 1)
        monkeypatch.setattr(ordering, "SMALL_RANGE", 4)


def test_running_sums_with_one_frequent_value(spark, monkeypatch):
    """Half of all rows share a group; sums and ranges do not depend on it."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 1000)
    rows = [("hot" if i % 2 else f"g{i % 7}", i, i % 5) for i in range(4000)]
    df = spark.createDataFrame(shuffled(rows), "g string, i int, c bigint")
    for within in ((), ("g",)):
        summed = running_sums(df, ("g", "i"), "c", within).collect()
        expected, totals = {}, {}
        for g, i, c in sorted(rows):
            key = g if within else None
            expected[g, i] = totals.get(key, 0)
            totals[key] = expected[g, i] + c
        assert {(r["g"], r["i"]): r["before"] for r in summed} == expected
        sizes = [r["count"] for r in df.sparkSession.createDataFrame(summed).groupBy("slot").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2000


def test_running_sums_want_the_group_first(spark):
    with pytest.raises(ValueError):
        running_sums(spark.range(1).toDF("i"), ("i",), "i", ("g",))


@pytest.mark.parametrize("top", [ordering.TOP_KEYS, 2])
@pytest.mark.parametrize("n, expected", [(None, 40), (0, 40), (3, 3), (17, 17), (40, 40), (100, 40)])
def test_limit_takes_the_first_in_fetch_order(spark, n, expected, top, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_KEYS", top)
    rows = [message(f"{i:02}", date_local=after(i * 400), mailbox=["second", "first"][i % 2]) for i in range(40)]
    found = limit(ordered(spark, shuffled(rows)), n).collect()
    assert len(found) == expected
    order = [f"{i:02}" for i in range(1, 40, 2)] + [f"{i:02}" for i in range(0, 40, 2)]
    assert sorted(row["uid"] for row in found) == sorted(order[:expected])


@pytest.mark.parametrize("top", [ordering.TOP_KEYS, 1])
def test_limit_counts_copies(spark, top, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_KEYS", top)
    rows = [message(str(i), date_local=after(i)) for i in range(4)]
    found = limit(ordered(spark, rows).withColumn("copies", F.lit(3).cast("long")), 7, "copies")
    assert sorted((r["uid"], r["copies"]) for r in found.collect()) == [("0", 3), ("1", 3), ("2", 1)]


@pytest.mark.parametrize("top", [ordering.TOP_KEYS, 1])
def test_limit_with_undated_messages(spark, top, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_KEYS", top)
    rows = [message("x", date_local=None), message("y"), message("z", date_local=after(1))]
    assert {r["uid"] for r in limit(ordered(spark, rows), 2).collect()} == {"x", "y"}


def test_a_split_passes_on_no_more_keys_than_the_limit(spark):
    keys = ordered(spark, [message(f"{i:02}") for i in range(40)]).select(*ordering.ORDER)
    plan = ordering.first_keys(keys, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=5" in plan and "rangepartitioning" not in plan


def test_a_large_limit_looks_at_the_keys_of_one_day_only(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_KEYS", 20)
    rows = [message(f"{i:03}", date_local=after(i * 60)) for i in range(240)]  # ten days
    seen, last = [], ordering._last_taken
    monkeypatch.setattr(ordering, "_last_taken", lambda keys, n, order=ordering.ORDER: seen.append((keys.count(), n)) or last(keys, n, order))
    found = limit(ordered(spark, shuffled(rows)), 130).collect()
    assert sorted(r["uid"] for r in found) == [f"{i:03}" for i in range(130)]
    assert seen[0] == (11, 130) and seen[1][0] <= 24 and seen[1][1] <= 24


def test_range_count():
    assert ordering.range_count(0, 0) == ordering.range_count(10**6 // 10, 1 << 20) == 1
    assert ordering.range_count(10**7, 0) == 100
    assert ordering.range_count(10**9, 100 << 40) == ordering.MOST_RANGES
    assert ordering.range_count(3000, 1 << 40) == 3


def contents(spark, rows):
    return with_content(ordered(spark, shuffled(rows)))


@pytest.mark.parametrize("size, n", [(10, 25), (1, 5), (7, 7), (None, 3), (None, 25), (10, 0)])
def test_batches(spark, size, n, ranges):
    rows = [message(f"{i:03}", date_local=after(i), text=f"text {i}", mailbox=["first", "second"][i > 11]) for i in range(n)]
    found = sorted(batches(contents(spark, rows), size).collect(), key=lambda r: r["batch_id"])
    size = size or 10
    expected = [rows[i : i + size] for i in range(0, n, size)]
    assert [[e["uid"] for e in r["emails"]] for r in found] == [[m["uid"] for m in b] for b in expected]
    assert [r["content"] for r in found] == ["\n---\n".join(m["text"] for m in b) for b in expected]
    assert [r["mailbox"] for r in found] == [b[0]["mailbox"] for b in expected]
    assert [r["batch_id"] for r in found] == list(range(len(expected)))


def test_fitted_batches(spark, ranges):
    sizes = [40, 1, 0, 0, 300, 2, 95, 50, 7] * 5
    rows = [message(f"{i:03}", date_local=after(i), text="x" * n) for i, n in enumerate(sizes)]
    found = sorted(fitted_batches(contents(spark, rows), 100).collect(), key=lambda r: r["batch_id"])
    expected, place = {}, 0
    for row, n in zip(rows, sizes):
        over = place + n + 5 > (place // 100 + 1) * 100
        expected.setdefault(2 * (place // 100) + over, []).append(row["uid"])
        place += n + 5
    assert {r["batch_id"]: [e["uid"] for e in r["emails"]] for r in found} == expected
    assert all(len(r["content"]) <= 100 for r in found if len(r["emails"]) > 1)


def test_batching_moves_texts_once_and_never_to_one_task(spark, ranges, request):
    if "one range" in request.node.name:
        pytest.skip("fits one task")
    rows = [message(f"{i:04}", date_local=after(i)) for i in range(400)]
    plan = batches(contents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "shufflepartitionidpassthrough" in plan
    assert "SinglePartition" not in plan


def test_equal_dates_are_spread_over_ranges(spark, monkeypatch):
    """Every message has the same date: the uid decides."""
    monkeypatch.setattr(ordering, "RANGE_BYTES", 1)
    monkeypatch.setattr(ordering, "SMALL_RANGE", 250)
    rows = [message(f"{i:04}") for i in range(1000)]
    found = batches(contents(spark, rows), 10)
    assert found.count() == 100
    sizes = found.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) <= 50


def test_bodies_are_cleaned_once(spark, ranges):
    """Their lengths decide where they go; they are computed once all the same."""
    cleaned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        cleaned.add(1)
        return text.strip()

    rows = [message(f"{i:03}", date_local=after(i), text="x" * (i % 37), thread_id=f"t{i % 5}") for i in range(200)]
    content = ordered(spark, rows).withColumn("content", clean("text")).drop("text", "html")
    assert fitted_batches(content, 100).count() > 20 and cleaned.value == 200
    assert transcripts(with_thread_key(content), 50).count() > 20 and cleaned.value == 400


def test_chunk_size():
    assert chunk_size(8192) == 7192
    assert chunk_size(1050) == chunk_size(10) == 100


def reference_chunks(content, size):
    """Greedy search by hand."""
    blanks, spaces, found = " \t\r\f", " \t\r\f\n", []
    while content:
        cut = None
        if len(content.rstrip(spaces)) <= size:
            cut = len(content)
        for strength in range(4) if cut is None else ():
            for end in range(min(size, len(content)), 0, -1):
                rest = content[end:]
                line = rest.lstrip(blanks)
                if (
                    (strength == 0 and line[:1] == "\n" and line[1:].lstrip(blanks)[:1] == "\n")
                    or (strength == 1 and line[:1] == "\n")
                    or (strength == 2 and content[end - 1] in ".!?" and rest[:1] and rest[0] in spaces)
                    or (strength == 3 and rest[:1] and rest[0] in spaces)
                ):
                    cut = end
                    break
            if cut is not None:
                break
        if cut is None:
            cut = size
        found.append(content[:cut].strip())
        content = content[cut:].lstrip(spaces)
    return [piece for piece in found if piece]


def texts():
    random_ = random.Random(3)
    parts = ["word", "a", "longer-word-than-others", ". ", "! ", " ", "\n", "\n\n", " \n \n ", "é", "x" * 30, "😀"]
    return ["".join(random_.choices(parts, k=random_.randint(0, 120))).strip() for _ in range(200)]


@pytest.mark.parametrize("size", [1, 7, 25, 100])
def test_chunks_agree_with_a_search_by_hand(spark, size):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    for row in rows.select("t", chunks(F.col("t"), size).alias("c")).collect():
        assert row["c"] == reference_chunks(row["t"], size), row["t"]
        assert all(len(c) <= size for c in row["c"])
        assert "".join("".join(row["c"]).split()) == "".join(row["t"].split())


@pytest.mark.parametrize("size", [1, 7, 100])
def test_fixed_chunks(spark, size):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string")
    for row in rows.select("t", fixed_chunks(F.col("t"), size).alias("c")).collect():
        assert row["c"] == [row["t"][i : i + size] for i in range(0, len(row["t"]), size)]


def test_chunk_cases(value):
    assert value(lambda c: chunks(c, 3096), "Short text") == ["Short text"]
    assert value(lambda c: chunks(c, 100), "") == []
    found = value(lambda c: chunks(c, 200), "word " * 500)
    assert len(found) > 1 and max(map(len, found)) <= 200


def test_a_long_text_without_boundaries(value):
    found = value(lambda c: chunks(c, 7192), "x" * 1_000_000)
    assert [len(c) for c in found] == [7192] * 139 + [312]


def test_chunked_keeps_items_without_text(spark):
    rows = [message("a", text=""), message("b", text="one. " * 100)]
    found = chunked(single_items(contents(spark, rows)), size=100).collect()
    assert [(r["chunk_ix"], r["chunk"]) for r in found if "|a" in r["item_id"]] == [(None, None)]
    assert [r["chunk_ix"] for r in found if "|b" in r["item_id"]] == [0, 1, 2, 3, 4]


def test_messages_without_folder(spark, ranges):
    """Provider messages carry labels and no folder."""
    rows = [message(f"{i:02}", folder=None, date_local=after(i % 3), text=f"text {i}") for i in range(60)]
    expected = sorted(rows, key=lambda m: (m["date_local"], m["uid"]))
    found = sorted(batches(contents(spark, rows), 7).collect(), key=lambda r: r["batch_id"])
    assert [e["uid"] for r in found for e in r["emails"]] == [m["uid"] for m in expected]
    assert {len(r["emails"]) for r in found[:-1]} == {7}
    first = limit(ordered(spark, shuffled(rows)), 25).collect()
    assert {r["uid"] for r in first} == {m["uid"] for m in expected[:25]}


def test_batch_items(spark):
    rows = [message(str(i), date_local=after(i)) for i in range(3)]
    row = batch_items(batches(contents(spark, rows))).first()
    assert (row["item_id"], row["copies"], len(row["emails"])) == ("b|0", 1, 3)


def test_tokens(spark, value):
    assert value(token_estimate, "") == 0
    assert value(token_estimate, None) == 0
    assert value(token_estimate, "Hello, wörld_1! ") == 6
    assert value(token_count(lambda: str.split), "a b  c") == 3
    assert value(token_count(lambda: str.split), None) == 0
