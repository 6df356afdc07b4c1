"""Signatures against similarities, classes against comparing all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from postbag.llm import near_dups as nd
from tests.llm.test_ppm import traced

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_id string, kept string, bucket string, m string"
CLASH = ("l", "s", 1, "x", "y", "z", "w")


def signed(*texts, counted=False):
    """Signatures of lists of words, and their sets."""
    hashes = [nd.word_hashes(np.frombuffer(" ".join(t).encode(), np.uint8))[0] for t in texts]
    kinds, weights, borders = nd.shingle_sets_of(np.concatenate(hashes), np.cumsum([0, *map(len, hashes)]), counted)
    sets = [dict(zip(kinds[a:b].tolist(), weights[a:b])) for a, b in zip(borders, borders[1:])]
    return nd.signatures_of(kinds, weights, borders)[0], sets


@pytest.mark.parametrize("counted", [False, True])
def test_agreement_is_similarity(counted):
    draw, agree, expected = random.Random(1), 0, 0
    for _ in range(60):
        base = [draw.choice("abcd") + str(draw.randint(0, 30 if counted else 999)) for _ in range(120)]
        if counted:
            base += base[:40] * 3
        other = [w if draw.random() < 0.98 else "new" for w in base]
        found, (a, b) = signed(base, other, counted=counted)
        agree += (found[0] == found[1]).mean()
        expected += sum(min(a[x], b[x]) for x in a.keys() & b.keys()) / sum(max(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys())
    assert abs(agree - expected) / 60 < 0.03


def test_fractional_weights():
    rng, agree = np.random.default_rng(0), []
    kinds = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for _ in range(40):
        kinds = nd.mix(kinds)
        a, b = rng.random(40) * 5, rng.random(40) * 5
        found, _ = nd.signatures_of(np.tile(kinds, 2), np.concatenate([a, b]), np.array([0, 40, 80]))
        agree.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree)) < 0.03


def test_rows_are_signed_apart():
    draw = random.Random(3)
    texts = [[], ["one"], ["one", "two"]] + [[f"w{draw.randint(0, 50)}" for _ in range(draw.randint(1, 40))] for _ in range(30)] + [[]]
    together, sets = signed(*texts)
    for text, found, own in zip(texts, together, sets):
        alone, (again,) = signed(text)
        assert (found == alone[0]).all() and own == again
        assert len(own) == len(shingles(" ".join(text)))
    assert (together[0] == 0).all() and (together[1] != 0).any()


def test_rows_do_not_run_together():
    import pyarrow as pa

    from postbag.llm.common import utf8

    texts = ["a b", "", "c", None, " d  e f "]
    hashes, borders = nd.word_hashes_apart(*utf8(pa.array(texts)))
    assert np.diff(borders).tolist() == [2, 0, 1, 0, 3]
    alone = [nd.word_hashes(np.frombuffer((t or "").encode(), np.uint8))[0] for t in texts]
    assert hashes.tolist() == np.concatenate(alone).tolist()


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def weighted(text, counted):
    words = (text or "").split()
    counts = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    return counts if counted else Counter(counts.keys())


def brute(rows, counted=True):
    """Classes by comparing every pair of texts."""
    parent = {r[1] or "": r[1] or "" for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {t: weighted(t, counted) for t in parent}
    for a in parent:
        for b in parent:
            if a < b and sets[a] and sets[b] and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total() - 1e-9:
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for r in rows:
        ids[root(r[1] or "")].append(r[0])
    return {t: min((i for i in ids[root(t)] if i is not None), default=None) for t in parent}, {t: len(ids[root(t)]) for t in parent}


@pytest.fixture
def rows():
    draw = random.Random(2)
    texts = []
    for _ in range(25):
        base = [f"w{draw.randint(0, 500)}" for _ in range(draw.randint(3, 150))]
        for _ in range(draw.randint(1, 12)):
            rate = draw.choice([0, 0.01, 0.03, 0.06])
            texts.append(" ".join(w if draw.random() > rate else f"x{draw.randint(0, 9)}" for w in base))
    # Lines over and over: alike as sets, but not by how often.
    line = [f"r{i}" for i in range(30)]
    texts += [" ".join(line * k) for k in (2, 3, 4, 6, 7, 20)]
    # One word further each time: linked in a chain whose ends have little in common.
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 60, 4)]
    draw.shuffle(texts)
    rows = [(i, t, *CLASH) for i, t in enumerate(texts)]
    return rows + [(900, None, *CLASH), (901, "", *CLASH), (None, texts[0], *CLASH), (None, "only without id", *CLASH), (3, texts[3], *CLASH), (902, "q " * 20_000, *CLASH)]


@pytest.mark.parametrize("counted, broadcast", [(True, True), (False, True), (True, False)])
def test_classes(spark, rows, counted, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(nd, "BROADCAST_IDS", -1)
    found = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), counted=counted).collect()
    classes, sizes = brute(rows, counted)
    text_of = defaultdict(set)
    for r in rows:
        text_of[r[0]].add(r[1] or "")
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert r.class_id in {classes[t] for t in text_of[r.doc_id]}
        assert r.class_size in {sizes[t] for t in text_of[r.doc_id]}


def test_one_of_each_stays(spark, rows):
    documents = spark.createDataFrame(rows, SCHEMA)
    kept = nd.keep_one_of_each(documents)
    assert kept.columns == documents.columns
    classes, _ = brute(rows)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, set(classes.values())))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicates(none).collect() == [] and nd.keep_one_of_each(none).collect() == []


@pytest.mark.parametrize("growth", [4, 64])
def test_a_hot_bucket_of_many_classes(spark, monkeypatch, growth):
    """Texts that share most of their words, in many classes: rounds of ever more leaders find all links."""
    monkeypatch.setattr(nd, "GROWTH", growth)
    monkeypatch.setattr(nd, "LOAD_BYTES", 20_000)
    draw = random.Random(6)
    common, rows = [f"c{i}" for i in range(60)], []
    for family in range(30):
        own = [f"f{family}_{i}" for i in range(draw.randint(14, 24))]
        for _ in range(draw.randint(1, 5)):
            words = common + own
            words[draw.randint(60, len(words) - 1)] = f"x{draw.randint(0, 99)}"
            rows.append((len(rows), " ".join(words), *CLASH))
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    classes, _ = brute(rows)
    assert found == {r[0]: classes[r[1]] for r in rows} and len(set(found.values())) > 1


@pytest.mark.parametrize("outside, most_rounds", [(0, 9), (1024, 1)])
def test_a_bucket_ends_with_the_texts_outside_its_largest_class(spark, monkeypatch, outside, most_rounds):
    """Few enough of them are the leaders of one round; without that, rounds of ever more leaders find the same."""
    monkeypatch.setattr(nd, "GROWTH", 4)
    monkeypatch.setattr(nd, "OUTSIDE", outside)
    draw, common, rows, rounds = random.Random(8), [f"c{i}" for i in range(70)], [], []
    for family in range(24):
        own = [f"f{family}_{i}" for i in range(18)]
        for copy in range(30 if family == 0 else 3):
            words = common + own
            words[draw.randint(70, 87)] = f"x{copy}"
            rows.append((len(rows), " ".join(words), *CLASH))
    compare = nd.links_with_leaders
    monkeypatch.setattr(nd, "links_with_leaders", lambda *given: rounds.append(given[1]) or compare(*given))
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    classes, _ = brute(rows)
    assert found == {r[0]: classes[r[1]] for r in rows} and len(set(found.values())) > 1
    assert 1 <= len(rounds) <= most_rounds and (outside or len(rounds) > 1)


def test_steps_over_texts_hold_little():
    texts = pa.array([" ".join(f"w{i * k % 9973}" for k in range(400)) for i in range(2000)])
    seen = []
    peak = traced(lambda: seen.extend(len(borders) - 1 for *_, borders in nd._sets(texts, True)))
    assert sum(seen) == len(texts) and peak < 32 << 20
