import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from postbag.llm import divergence as dv
from postbag.llm.transducer import build

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, ordinal string, value string"
CLASH = (1, "t", "o", "v")


def machine(terms):
    data = np.frombuffer(b"".join(terms), np.uint8)
    return build(data, np.cumsum([0, *map(len, terms)]))


def ask(made, words):
    return made.ordinals(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])).tolist()


@pytest.mark.parametrize("seed", range(30))
def test_ordinals_of_terms_and_of_others(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 7))).encode()
    terms = sorted({word() for _ in range(draw.randint(1, 200))})
    made, others = machine(terms), [w for w in {word() for _ in range(200)} - set(terms)]
    assert ask(made, terms) == list(range(len(terms)))
    assert ask(made, others + [b""]) == [-1] * (len(others) + 1)


@pytest.mark.parametrize("seed", range(20))
def test_no_two_states_have_one_right_language(seed):
    draw = random.Random(seed)
    terms = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 6))).encode() for _ in range(60)})
    prefixes = {t[:k] for t in terms for k in range(len(t) + 1)}
    languages = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in prefixes}
    made = machine(terms)
    assert len(made.final) == len(languages)
    assert len(set(made.keys.tolist())) == len(made.keys) and (np.diff(made.keys) > 0).all()


def test_suffixes_are_shared_and_long_terms_taken():
    endings = [a + b"ations" for a in (b"form", b"norm", b"perform", b"inform")]
    assert len(machine(sorted(endings)).final) < len({t[:k] for t in endings for k in range(len(t) + 1)})
    long = [b"x" * 5000, b"x" * 5000 + b"y"]
    assert ask(machine(long), [long[1], b"x" * 4999, long[0]]) == [1, -1, 0]
    assert ask(machine([]), [b"a", b""]) == [-1, -1]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, ranks=200):
    docs = [(l or "", s or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, l, s in rows]
    out, groups = [], {(l, s) for l, s, _ in docs}
    for lang in {l for l, _ in groups}:
        df, n = Counter(), {s: Counter() for l, s in groups if l == lang}
        for l, s, terms in docs:
            if l == lang:
                df.update(set(terms))
                n[s].update(terms)
        kept = sorted(t for t in df if df[t] >= least)
        p = lambda count, total: 1 + 10**9 * (count + 1) // (total + len(kept))
        total = {s: sum(c[t] for t in kept) for s, c in n.items()}
        of = {s: {t: p(c[t], total[s]) for t in kept} for s, c in n.items()}
        q = {t: p(sum(c[t] for c in n.values()), sum(total.values())) for t in kept}
        for s in n:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in n if o != s]
            best = [((of[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return Counter(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    words = [f"{a}{b}" for a in ("a", "B", "ca", "é", "Straße", "日本", "zz") for b in ("", "x", "yx", "É", "on", "ons")]
    rows = []
    for i in range(250):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["s0", "s0", "s1", "s2", None])
        start = {"s0": 0, "s1": 15}.get(source, 25)
        text = " ".join(draw.choice(words[start:] if draw.random() < 0.5 else words) for _ in range(draw.randint(0, 40)))
        rows.append((i, text + ", 12-x3_y!", lang, source))
    # A source without terms, one without texts, a language of one source and one without kept terms.
    rows += [(400, "123 ?", "en", "digits"), (401, None, "en", "nothing"), (402, "one two", "fr", "s0"), (403, "one two", "fr", "s0"), (404, "one two", "fr", "s0")]
    rows += [(405, "uno", "es", "s0"), (406, "dos", "es", "s1"), (None, "B " * 30_000 + "x" * 9000, "de", "s1"), (3, rows[3][1], rows[3][2], rows[3][3]), (3, rows[3][1], rows[3][2], rows[3][3])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"range_terms": 9, "load_bytes": 1500, "block": 4}])
def test_against_brute_force(spark, rows, options):
    found = dv.divergences(frame(spark, rows), **options).select(*COLUMNS).collect()
    assert Counter(map(tuple, found)) == brute(rows)


def test_ranks_of_terms_are_limited(spark, rows):
    found = dv.divergences(frame(spark, rows), ranks=5, block=8).select(*COLUMNS).collect()
    assert Counter(map(tuple, found)) == brute(rows, ranks=5)


def test_against_sql(rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    result = connection.execute(dv.DIVERGENCE_SQL)
    assert [c[0] for c in result.description] == COLUMNS
    assert Counter(result.fetchall()) == brute(rows)


def test_tasks_pass_counts_on_when_there_are_many(spark, rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dv, "TALLIED", 40)
    text = [r[1] for r in rows[:60]]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 60), pa.array(text)], ["lang", "text"])
    found = Counter()
    for part in dv._document_counts(iter([batch, batch])):
        for _, term, n in zip(*(c.to_pylist() for c in part.columns)):
            found[term] += n
    expected = Counter()
    for t in text:
        expected.update({w.encode(): 2 for w in {x for x in TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))}})
    assert found == expected


def test_empty_tables(spark, rows):
    assert dv.divergence_digests(frame(spark, rows).limit(0)).collect() == []
    assert dv.divergence_digests(frame(spark, [(1, None, None, None)])).collect() == []
    two = dv.divergence_digests(frame(spark, [(1, None, None, None), (2, "", "", "b")])).select(*COLUMNS).collect()
    assert sorted(map(tuple, two)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
