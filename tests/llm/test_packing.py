"""Packing against tokenising whole texts and against best-fit decreasing piece by piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postbag.llm import packing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, task string, rank string"
TEXTS = [
    "Anblewh sttible, athawh  thonre.\n\n was\tis é è ñ à x",
    "nbsp  then　 space  x  ",
    "",
    "   ",
    "\x1c a\x1f b <|endoftext|> c' don't  123 45",
    "日本語 の テキスト — “quotes” x",
    "und die chüung\r\n geüü\x00 x",
    "word " * 3000,
]


@pytest.fixture(scope="module")
def reference_ids():
    """Ids by the JSON vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts(reference_ids):
    encode, draw = packing.public_encoder(), random.Random(0)
    alphabet = "aZé ß 日'd'll\n\r\t\x0b\x1c\x85\xa0\u2028\u3000\u200b1２½-_🙂\U000e0001\x00"
    odd = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(500)]
    odd += [f"{a}<|endoftext|>{b}" for a, b in zip(odd[:60], odd[60:])] + ["ab <|endoftext|> cd", "<|endoftext|>" * 5, "<|endoftext", " " * 1_500_000 + "a"]
    for text in TEXTS + odd:
        assert encode(text).tolist() == reference_ids(text)
    assert encode("ab <|endoftext|> cd").tolist() == [397, 220, 50256, 22927]


def one_by_one(counts, most):
    """Best-fit decreasing over single pieces: how full the bins are, whichever of equally full ones is taken."""
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [(most - sum(b), i) for i, b in enumerate(bins) if most - sum(b) >= length]
            if fitting:
                bins[min(fitting)[1]].append(length)
            else:
                bins.append([length])
    return Counter(map(sum, bins))


@pytest.mark.parametrize("seed", range(20))
def test_intervals_are_best_fit_decreasing(seed):
    draw = random.Random(seed)
    most = draw.choice([5, 10, 33, 64])
    counts = {length: draw.randint(1, 12) for length in range(1, most + 1) if draw.random() < 0.6}
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in packing.best_fit(counts, most):
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            bins[first + i].append((offset, length))
    assert {length: sorted(r) for length, r in ranks.items()} == {length: list(range(n)) for length, n in counts.items()}
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held])[:-1])
        assert sum(n for _, n in held) <= most
    assert Counter(sum(n for _, n in b) for b in bins.values()) == one_by_one(counts, most)


def test_pieces_round_trip(spark, reference_ids):
    rows = [(i, t, None, None, None, "x", "y") for i, t in enumerate(TEXTS)] + [(None, None) + (None,) * 5] * 2 + [(0, TEXTS[0]) + (None,) * 5]
    found = packing.packed(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = Counter()
    for row in rows:
        own = reference_ids(row[1] or "") + [packing.END]
        start = 0
        for piece, length in enumerate(packing.piece_lengths(len(own))):
            crc = zlib.crc32(np.array(own[start : start + length], "<u4").tobytes())
            expected[row[0], piece, start, length, crc] += 1
            start += length
    assert Counter(tuple(r)[:5] for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held])[:-1])
        assert sum(n for _, n in held) <= packing.LENGTH


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_blank_runs(reference_ids):
    text = "ab" + " " * 1_500_000 + "x"
    assert packing.public_encoder()(text).tolist() == reference_ids(text)
