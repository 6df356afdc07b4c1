import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postbag.llm import lm, ppm
from postbag.llm.common import utf8
from tests.llm.test_ppm import bits_one_by_one, traced

SCHEMA = "doc_id bigint, text string, word string, score string, c string"
TEXTS = ["The cat sat.", "  THE\tÉcat\n\n cat ", "", " ", "x", "the the the end", "日本 語 the"]


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[2:4], [""], [" a", "b "], ["\n"] * 3])
def test_normal_rows_and_words(texts):
    data, borders = lm.normal(*utf8(pa.array(texts)))
    assert [bytes(data[a:b]).decode() for a, b in zip(borders, borders[1:])] == [" ".join(plain(t)) + "\n" for t in texts]
    words, per_row = lm.words_of(data, borders)
    assert [w.decode() for w in words.to_pylist()] == [w for t in texts for w in plain(t)]
    assert per_row.tolist() == [len(plain(t)) for t in texts]


def expected(rows, training, order):
    counts = Counter(w for _, t, *_ in training for w in [*plain(t), None])
    total, kinds = sum(counts.values()), len(counts)
    seen = [(" ".join(plain(t)) + "\n").encode() for _, t, *_ in training]
    for doc_id, text, *_ in rows:
        tokens = [*plain(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        score = -bits_one_by_one(seen, (" ".join(plain(text)) + "\n").encode(), order) * math.log10(2)
        yield doc_id, len(tokens), sum(counts[t] > 0 for t in tokens), total, base, score


@pytest.mark.parametrize("head_share", [2.0**-17, 0.05, 2.0])
def test_scores(spark, monkeypatch, head_share):
    monkeypatch.setattr(lm, "HEAD_SHARE", head_share)
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["The", "cat", "é", "sat", f"w{draw.randint(0, 40)}"]) for _ in range(draw.randint(0, 30))), *"abc") for i in range(40)]
    rows += [(None, None, *"abc"), (None, "the cat", *"abc"), (3, "the cat", *"abc"), (3, "the cat", *"abc"), (5, "", *"abc")]
    training = rows[::2]
    found = lm.scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(training, SCHEMA), order=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    for ours, theirs in zip(sorted(map(tuple, found), key=key), sorted(expected(rows, training, 3), key=key), strict=True):
        assert ours[:4] == theirs[:4]
        assert np.allclose(ours[4:], theirs[4:])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lm.lm_digests(none).collect() == []
    one = lm.scores(spark.createDataFrame([(1, "ab", *"abc")], SCHEMA), none).first()
    assert one.train_tokens == 0 and one.n_known == 0
    assert one.score == pytest.approx(-3 * 8 * math.log10(2))


def test_model_learns(spark):
    draw = random.Random(5)
    rows = [(i, " ".join("".join(draw.choice("tion er an st ou le re ai ch en ab om".split()) for _ in range(3)) for _ in range(50)), *"abc") for i in range(200)]
    found = [r for r in lm.lm_digests(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    # A word of three out of twelve parts takes 10.75 bits at least.
    bits = [-r.score / math.log10(2) / 50 for r in found]
    assert found and 10.7 < sum(bits) / len(bits) < 14


@pytest.mark.parametrize("gram_share", [0.0, 2.0**-9, 2.0])
def test_rare_grams_count_at_any_share(spark, monkeypatch, gram_share):
    # Which grams are sent to the tasks decides nothing: the others are joined.
    monkeypatch.setattr(lm, "GRAM_HEAD_SHARE", gram_share)
    monkeypatch.setattr(lm.ppm, "HELD_GRAMS", 50)
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["the", "cat", "sat", "é"]) for _ in range(40)), *"abc") for i in range(30)]
    rows += [(30, "zyxwvut qponmlk", *"abc"), (31, "qponmlk jihgfed", *"abc")]
    training = rows[:31]
    found = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(training, SCHEMA)).collect()}
    assert found == pytest.approx({doc_id: score for doc_id, *_, score in expected(rows, training, lm.ORDER)})


def test_steps_over_texts_hold_little():
    texts = pa.array(["The cat sat on the mat. " * 200] * 1000)
    data, _ = lm.normal(*utf8(texts))
    seen = []
    peak = traced(lambda: seen.extend(int(borders[-1]) for *_, part, borders in lm._normalised(texts) if len(ppm.padded(part, borders, lm.ORDER)) == borders[-1]))
    assert sum(seen) == len(data)
    assert peak < 24 << 20
