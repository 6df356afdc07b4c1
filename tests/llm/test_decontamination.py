import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from postbag.llm import decontamination as dec

SCHEMA = "doc_id bigint, text string, row string, n_words string, item string, window string, start string"
ITEMS = "item_id bigint, text string, doc_id string, words string, size string"
CLASH, ITEM_CLASH = tuple("abcde"), tuple("abc")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    """Every window of every item against every stretch of every document."""
    wins = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            wins.setdefault(tuple(own[i : i + window]), set()).add("" if item is None else str(item))
    out = Counter()
    for doc, text in rows:
        own, hit, names = words(text), set(), set()
        for win, ids in wins.items():
            for i in range(len(own) - len(win) + 1):
                if tuple(own[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names |= ids
        out[doc, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    vocabulary = ["the"] * 6 + [f"w{i}" for i in range(12)] + ["É1", "straße", "日本"]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, say(draw.randint(1, 30))) for i in range(25)]
    # Few words, no words, one window of one word over and over, the same window in two items, ids that are missing or twice.
    items += [(30, "the W3"), (31, ""), (32, None), (33, "..."), (34, "the " * 14), (35, items[2][1]), (None, items[3][1] + " end"), (36, "zebra"), (36, say(12)), (101, "Zebra, the")]
    docs = []
    for i in range(120):
        text = say(draw.randint(0, 60))
        if i % 3 == 0:
            own = draw.choice(items)[1] or ""
            text = f"{text}. {own.upper() if i % 2 else own}! {say(5)}"
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "?!"), (3, docs[3][1]), (3, docs[3][1]), (None, "a zebra - the\x00W3"), (503, "the " * 3_000 + items[4][1]), (504, say(3000))]
    return docs, items


def both(spark, rows):
    docs, items = rows
    return spark.createDataFrame([(*r, *CLASH) for r in docs], SCHEMA), spark.createDataFrame([(*r, *ITEM_CLASH) for r in items], ITEMS)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, rows, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    found = dec.contamination_digests(*both(spark, rows))
    assert Counter(tuple(r) for r in found.select(*COLUMNS).collect()) == brute(*rows)


def test_against_sql(spark, rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows[0])
    connection.executemany("INSERT INTO benchmark VALUES (?, ?)", rows[1])
    result = connection.execute(dec.CONTAMINATION_SQL)
    assert [c[0] for c in result.description] == COLUMNS
    assert Counter(result.fetchall()) == brute(*rows)


@pytest.mark.parametrize("containment", [0.5, 0.8])
def test_shares_of_a_window(spark, rows, containment):
    """With a lower share: all places of all windows, by the definition."""
    docs, items = [r for r in rows[0] if r[0] is not None and r[0] < 60], rows[1]
    sets = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - 5) if own else 0):
            sets.setdefault(tuple(own[i : i + 6]), set()).add("" if item is None else str(item))
    expected = Counter()
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for win, ids in sets.items():
            size = min(2, len(win))
            grams = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            wanted = grams(win)
            for i in range(len(own) - len(win) + 1):
                if len(wanted & grams(own[i : i + len(win)])) >= -(-len(wanted) * containment // 1):
                    hit |= set(range(i, i + len(win)))
                    names |= ids
        expected[doc, len(hit), tuple(sorted(names))] += 1
    found = dec.contamination(*both(spark, (docs, items)), window=6, shingle=2, containment=containment)
    assert Counter((r.doc_id, r.n_hit, tuple(r["items"])) for r in found.collect()) == expected


def test_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x One two three y one two three one two"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "one two three")], "item_id bigint, text string")
    found = {r.doc_id: r for r in dec.contamination(docs, items).collect()}
    assert [tuple(s) for s in found[1].spans] == [(1, 4), (5, 8)] and found[1]["items"] == ["7"] and found[2].spans == []
    assert dec.contamination_digests(docs.limit(0), items).collect() == []
    none = dec.contamination_digests(docs, items.limit(0)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in none) == [(1, 10, 0, False), (2, 0, 0, False)]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7])
def test_hashes_tell_shingles_apart(spark, size):
    draw = random.Random(size)
    rows = [([draw.choice("abc") for _ in range(draw.randint(0, 12))],) for _ in range(60)]
    frame = spark.createDataFrame(rows, "words array<string>")
    seen = {}
    for r in frame.select("words", dec.shingle_hashes(dec.F.col("words"), size).alias("hashes")).collect():
        grams = [tuple(r["words"][i : i + size]) for i in range(len(r["words"]) - size + 1)]
        assert len(r["hashes"]) == len(grams)
        for gram, code in zip(grams, r["hashes"]):
            assert seen.setdefault(gram, code) == code
    assert len(set(seen.values())) == len(seen)


def test_only_the_rarest_shingles_are_joined(spark):
    """At a share of 1 a window is looked for where its rarest shingle stands, and nowhere else."""
    line = "a b c d e f g h i j"
    docs = [(0, line, 10)] + [(i, f"a b c d e f g x{i} h i j k l", 13) for i in range(1, 40)]
    rows = spark.createDataFrame(docs, "row bigint, norm string, n_words int")
    items = spark.createDataFrame([(1, line)], "item_id bigint, text string")
    windows = dec.item_windows(items, 10, 4)
    assert [r.row for r in dec.candidates(rows, windows, [4], True, 1.0).collect()] == [0]
    assert dec.candidates(rows, windows, [4], True, 0.5).count() == 40
