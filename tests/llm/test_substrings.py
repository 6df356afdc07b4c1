"""Chunks against a plain reading of the rule; planted passages are found, clean documents are left alone."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from postbag.llm import substrings as sub
from postbag.llm.common import BATCH_ROWS, pieces, utf8
from tests.llm.test_ppm import traced

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, seq string, digest string, first_doc string"
CLASH = ("l", "s", 1, "x", "y", "z")


def words(draw, n):
    return [f"w{draw.randint(0, 9999)}" for _ in range(n)]


def plain_chunks(text):
    """(start, end, words) one byte after the other."""
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    rolled, value = [], 0
    for byte in data:
        value = ((value << 2) + int(sub.GEAR[byte])) % (1 << 32)
        rolled.append(value)
    cuts = []
    for i, (start, _) in enumerate(spans):
        if not cuts or (i - cuts[-1] >= sub.LEAST_WORDS and rolled[start - 1] < sub.SHARE * 2**32):
            cuts.append(i)
    return [(spans[a][0], spans[b - 1][1], b - a) for a, b in zip(cuts, cuts[1:] + [len(spans)])]


def test_chunks_follow_the_rule():
    draw = random.Random(0)
    texts = ["", "  ", None, "one", " é\nb  "] + [draw.choice(["", " "]) + draw.choice([" ", "\n"]).join(words(draw, draw.randint(1, 200))) + draw.choice(["", " "]) for _ in range(30)] + [""]
    row, seq, start, end, count, digest = sub.chunks(*utf8(pa.array(texts)))
    for i, text in enumerate(texts):
        own = np.flatnonzero(row == i)
        assert list(zip(start[own], end[own], count[own])) == plain_chunks(text or "")
        assert seq[own].tolist() == list(range(len(own)))
    by_text = {}
    for i, s, e, d in zip(row, start, end, digest):
        assert by_text.setdefault(d, (texts[i].encode()[s:e]).split()) == texts[i].encode()[s:e].split()


def test_insertions_shift_chunks_only_nearby():
    draw = random.Random(1)
    base = words(draw, 2000)
    one, two = (set(sub.chunks(*utf8(pa.array([" ".join(t)])))[5].tolist()) for t in (base, base[:700] + ["inserted", "words"] + base[700:]))
    assert len(one - two) <= 6


@pytest.fixture
def rows():
    draw = random.Random(2)
    passages = [words(draw, n) for n in (51, 60, 80, 120)]
    texts = {}
    for i in range(200):
        body = words(draw, draw.randint(60, 300))
        if i % 2:
            body[30:30] = passages[i % 8 // 2]
        elif i % 4 == 0:
            body[20:20] = "All rights reserved under the general licence of this site".split()
        texts[i] = " ".join(body)
    return [(i, t, *CLASH) for i, t in texts.items()]


def test_planted_passages(spark, rows):
    found = sub.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in found} == {i for i in range(8, 200) if i % 2}
    assert all(r.first_doc_id < 8 for r in found)
    texts = {r[0]: r[1].encode() for r in rows}
    for r in found:
        assert texts[r.doc_id][r.start : r.end] in texts[r.first_doc_id]
        assert len(texts[r.doc_id][r.start : r.end].split()) >= r.words


def test_cut_out(spark, rows):
    odd = [(None, None, *CLASH), (300, "", *CLASH), (301, rows[0][1], *CLASH), (301, rows[0][1], *CLASH), (302, "x y " * 30_000, *CLASH)]
    documents = spark.createDataFrame(rows + odd, SCHEMA)
    cut = sub.without_repeats(documents)
    assert cut.columns == documents.columns
    found = cut.collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    texts = {r[0]: r[1] for r in rows + odd}
    for i, r in by_id.items():
        if i is None or i % 2 == 0 and i < 300 or i < 8 or i in (300, 302):
            assert r.text == texts[i] and r.n_chars == 1
        elif i < 300:
            # A 51-word passage loses what surely lies inside it.
            assert len(r.text.split()) <= len(texts[i].split()) - 20 and r.n_chars == len(r.text)
    assert by_id[301].text == ""


def test_spans_are_cut():
    assert sub.without(b"ab cd ef gh", [(3, 5)]) == b"ab\nef gh"
    assert sub.without(b"ab cd ef gh", [(0, 5), (3, 8)]) == b"gh"


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sub.repeats(none).collect() == [] and sub.without_repeats(none).collect() == []


def spans(spark, texts):
    rows = [(i, t, *CLASH) for i, t in enumerate(texts)]
    return {(r.doc_id, texts[r.doc_id].encode()[r.start : r.end].decode(), r.words) for r in sub.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_parts_in_other_documents_hide_no_passage(spark):
    draw = random.Random(6)
    whole, rest = words(draw, 60), lambda: words(draw, 70)
    pieces = [" ".join(rest() + whole[i : i + 20] + rest()) for i in range(0, 60, 20)]
    halves = [" ".join(rest() + whole[i : i + 30] + rest()) for i in (0, 30)]
    texts = [*pieces, *halves, *[" ".join(rest() + whole + rest()) for _ in range(2)]]
    assert spans(spark, texts) == {(6, " ".join(whole), 60)}


def test_exact_ends_and_no_shorter_passages(spark):
    draw = random.Random(7)
    texts, expected = [], set()
    for n in [40, 49] * 10 + [50, 51, 77] * 10:
        own = words(draw, n)
        for _ in range(2):
            texts.append(" ".join(words(draw, draw.randint(0, 60)) + own + words(draw, draw.randint(0, 60))))
        if n >= 50:
            expected.add((len(texts) - 1, " ".join(own), n))
    assert spans(spark, texts) == expected


def test_windows_bear_a_number_for_the_document():
    """Its id and a hash of its text, which would not compress, are not shuffled with every window."""
    assert [c.split()[0] for c in sub.WINDOWS.split(", ")] == ["doc", "at", "start", "end", "digest"]


class Rows:
    """In place of a table: gives the function that its rows would go through."""

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        return work


@pytest.mark.parametrize("make", [sub._anchor_rows, sub._window_rows])
def test_steps_over_texts_hold_little(spark, make):
    texts = pa.array([" ".join(words(random.Random(i), 400)) for i in range(2000)])
    ids = pa.array(range(len(texts)))
    columns = [ids, ids, texts] if make is sub._anchor_rows else [ids, texts, pa.array([[0]] * len(texts), pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(columns, ["a", "b", "c"])
    seen = []
    peak = traced(lambda: seen.extend(part.num_rows for part in make(Rows(), sub.WORDS)(iter([batch]))))
    assert len(seen) > 12 and peak < 24 << 20


def test_batches_come_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * BATCH_ROWS + 7))], ["n"])
    parts = list(pieces(iter([batch[:0], batch, batch[:3]])))
    assert [p.num_rows for p in parts] == [BATCH_ROWS, BATCH_ROWS, 7, 3]
    assert pa.Table.from_batches(parts[:3])["n"].to_pylist() == list(range(batch.num_rows))


def test_large_batches_are_cut_alike(spark):
    draw = random.Random(5)
    passage = words(draw, 60)
    rows = [(i, None if i % 7 == 0 else " ".join(words(draw, i % 5) + passage * (i % 3 == 0) + ["é"]), *CLASH) for i in range(2500)]
    documents = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for most in ("100", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            found.append(sorted(sub.without_repeats(documents).collect(), key=lambda r: r.doc_id))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1]
    # The first document with the passage keeps it.
    assert [r.doc_id for r in found[1] if passage[9] in (r.text or "")] == [3]
    assert sum(r.text is None for r in found[1]) == sum(r[1] is None for r in rows)
