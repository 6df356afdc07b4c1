import hashlib
import random
from collections import Counter

import duckdb
import pytest

from postbag.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, lang string, block string, pos string, term string, mask string, n string"
CLASH = tuple("abcdef")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(0)
    texts = [" ".join(f"w{draw.randint(0, 300)}" for _ in range(draw.randint(5, 80))) for _ in range(150)]
    rows = [(i * 7, t, *CLASH) for i, t in enumerate(texts)]
    return rows + [(500, "", *CLASH), (501, None, *CLASH), (None, texts[3], *CLASH), (14, texts[2], *CLASH), (14, "other", *CLASH), (601, "É é ß 日本 x-1", *CLASH), (602, "w1 w2 " * 5000, *CLASH)]


@pytest.fixture(scope="module", params=[4096, 20])
def found(spark, rows, request):
    kept, fp.BLOCK_ROWS = fp.BLOCK_ROWS, request.param
    out = fp.fingerprint_digests(spark.createDataFrame(rows, SCHEMA)).collect()
    fp.BLOCK_ROWS = kept
    return out


def test_against_sql(found, rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    result = connection.execute(fp.FINGERPRINT_SQL)
    names = [c[0] for c in result.description]
    expected = [dict(zip(names, r)) for r in result.fetchall()]
    key = lambda r: tuple("" if r[n] is None else str(r[n]) for n in sorted(names))
    assert sorted(key(r.asDict()) for r in found) == sorted(map(key, expected))


def test_edited_texts(found, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    texts = [r[1] or "" for r in order]
    expected = Counter()
    for row, text, after in zip(order, texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected[row[0], len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected


def test_likeness(found):
    by_print = {}
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert sum(r.near_edited for r in found) > 5 * sum(r.near_next for r in found if r.near_next < 1)
    for r in found:
        by_print.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {500, 501} in by_print.values()  # equal texts have equal fingerprints


def test_same_prints_alone(spark, rows, found):
    alone = fp.document_fingerprints(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint").collect()
    assert Counter(map(tuple, alone)) == Counter((r.doc_id, r.fingerprint) for r in found)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fp.fingerprint_digests(none).collect() == []
    one = fp.fingerprint_digests(spark.createDataFrame([(1, "abcd", *CLASH)], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_blocks_are_even_whatever_the_ids(spark, monkeypatch):
    """Two thirds have one id or none."""
    monkeypatch.setattr(fp, "BLOCK_ROWS", 20)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}", *CLASH) for i in range(600)]
    found, bounds = fp._blocks(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"))
    assert found == 600 and len(bounds) >= 25
    block = fp.range_of(fp.F.struct(*fp._place()), bounds, fp.T._parse_datatype_string(fp.KEY))
    sizes = spark.createDataFrame(rows, SCHEMA).groupBy(block.alias("block")).count().collect()
    assert len(sizes) == len(bounds) and max(r["count"] for r in sizes) <= 60


def test_a_text_is_shuffled_once(spark, rows, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK_ROWS", 20)
    plan = fp.fingerprint_digests(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    # The other one finds the first document of each block.
    assert len(moved) == 2 and sum("shufflepartitionidpassthrough" in line for line in moved) == 1
