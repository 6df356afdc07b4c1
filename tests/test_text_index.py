import random

import pytest
from pyspark.sql import functions as F

from postbag.operators import text_index
from postbag.operators.filters import Criteria, search
from postbag.operators.text_index import candidate_files, index_files, search_files
from postbag.schema import MESSAGE
from tests.rows import after, frame, message

WORDS = [f"{a}{b}" for a in ("alp", "bre", "cor", "dun", "él", "日本") for b in ("", "ine", "Ton", "uß")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Six files of messages with words of their own, and their index."""
    base, draw = tmp_path_factory.mktemp("indexed"), random.Random(5)
    for part in range(6):
        words = WORDS[part * 4 : part * 4 + 4]
        rows = []
        for i in range(30):
            text = " ".join(draw.choice(words) for _ in range(20))
            given = [{"text": text}, {"text": None, "html": f"<p>{text}</p>"}, {"subject": text}, {"sender": text}, {"recipients": [text, "b"]}, {"recipients": None, "text": ""}][i % 6]
            rows.append(message(f"{part}-{i:02}", date_local=after(i), **given))
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(base / "t"))
    index_files(spark, str(base / "t"), str(base / "index"))
    return str(base / "t"), str(base / "index")


def uids(found):
    return sorted(r["uid"] for r in found.select("uid").collect())


@pytest.mark.parametrize("query", [*WORDS, "ALPINE", "ine", "p", "ß", "", "orTon c", "Tondun", "nowhere to be found", "日本uß 日本", "john", None])
def test_finds_what_a_whole_search_finds(spark, table, query):
    path, index = table
    criteria = Criteria(query=query)
    assert uids(search_files(spark, path, index, criteria)) == uids(search(spark.read.schema(MESSAGE).parquet(path), criteria))


def test_files_without_the_words_are_not_read(spark, table):
    path, index = table
    every = set(spark.read.parquet(path).inputFiles())
    assert len(every) == 6
    found = search_files(spark, path, index, Criteria(query="alpine"))
    assert len(found.inputFiles()) == 1 and set(found.inputFiles()) < every
    assert candidate_files(spark, path, index, "nowhere to be found") == []
    assert len(candidate_files(spark, path, index, "al")) == 6  # too short to tell


def test_files_that_came_later(spark, table, tmp_path):
    path, index = str(tmp_path / "a t%ä"), str(tmp_path / "index")
    frame(spark, [message("1", text="first words")]).coalesce(1).write.parquet(path)
    assert uids(search_files(spark, path, index, Criteria(query="first"))) == ["1"]  # no index yet
    index_files(spark, path, index)
    frame(spark, [message("2", text="second words")]).coalesce(1).write.mode("append").parquet(path)
    # Not in the index, so it is read.
    assert uids(search_files(spark, path, index, Criteria(query="second"))) == ["2"]
    for _ in range(2):
        index_files(spark, path, index)
        assert [len(candidate_files(spark, path, index, q)) for q in ("first", "second", "words", "third")] == [1, 1, 2, 0]
    assert spark.read.parquet(index).groupBy("file", "stretch").count().filter("count > 1").count() == 0


def test_many_candidates_are_not_named(spark, table, monkeypatch):
    path, index = table
    monkeypatch.setattr(text_index, "MOST_FILES", 0)
    assert candidate_files(spark, path, index, "alpine") is None
    assert uids(search_files(spark, path, index, Criteria(query="alpine")))


def test_other_criteria_hold_too(spark, table):
    path, index = table
    criteria = Criteria(query="alp", sender="john", date_from="2024-01-01")
    assert uids(search_files(spark, path, index, criteria, ["first"], ["INBOX"])) == uids(
        search(spark.read.schema(MESSAGE).parquet(path), criteria, ["first"], ["INBOX"])
    )
    assert search_files(spark, path, index, criteria, ["second"]).count() == 0


def test_indexing_shuffles_bitmaps_not_groups(spark, table):
    """What a task passes on is bounded by the files it reads, however long their texts are."""
    messages = spark.read.schema(MESSAGE).parquet(table[0])
    plan = text_index.index_rows(messages)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "bitmap_or_agg" in plan
    rows = text_index.index_rows(messages).collect()
    known = {(r["file"], r["stretch"]): r["bitmap"] for r in spark.read.parquet(table[1]).collect()}
    assert {(r["file"], r["stretch"]): r["bitmap"] for r in rows} == known


def test_groups_of_texts():
    number = lambda g: (ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2])
    assert text_index.groups(["abcd", "", "x", "日本😀é"]).tolist() == [number(g) for g in ("abc", "bcd", "日本😀", "本😀é")]
    assert text_index.groups([]).tolist() == text_index.groups(["ab"]).tolist() == []


def test_an_index_of_another_hash_is_not_read(spark, table, tmp_path):
    index = str(tmp_path / "index")
    names = spark.read.parquet(table[1]).select("file", F.lit(0).cast("long").alias("stretch"), F.lit(b"").alias("bitmap")).distinct()
    names.write.parquet(index)
    assert candidate_files(spark, table[0], index, "alpine") is None
    index_files(spark, table[0], index)
    assert len(candidate_files(spark, table[0], index, "alpine")) == 1
