"""Toxic passages by maximum-scoring segments.

A token's score is the logarithm of its odds to occur in toxic against other documents, under a Dirichlet prior, less
a drift. A word counts by itself or, where too little is known of it, by its longest beginning of which enough is.
Words whose odds aren't significantly higher cost the drift alone; every occurrence of the others scores, since a word
that stood alone before may be part of a passage later. In a text that isn't toxic scores then sum to ever less, and a passage is a maximal segment of positive sum. One scan over the scores finds all of them
(Ruzzo and Tompa). How high segments get by chance follows an extreme-value law: in n harmless tokens K n exp(-lambda s)
segments of score s or more are expected, where lambda is the root of E exp(lambda score) = 1 over harmless tokens.
The best segments together give the expected number of equally good ones, E, and a document's score is exp(-E).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.llm.common import fold, steps, utf8

#: Of each class about so many labelled documents train, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
#: Dirichlet pseudo-count of each token; z-score from which a token's odds count; cost of each token.
PRIOR, LEAST_Z, DRIFT = 0.5, 5.0, 0.12
#: Lengths, in bytes, of the beginnings of words.
BEGINNINGS = (8, 7, 6, 5, 4)
#: Passages whose chance is looked at together.
TOGETHER = 6
#: A shorter text counts as one of so many tokens: a single slip in it is no more telling.
LEAST_TOKENS = 100
#: Values tried for the constant of the extreme-value law.
LOG_K = [k / 2 for k in range(-24, 61)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[b for b in range(128) if not chr(b).isalnum()]] = 32


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Lexicon:
    tokens: pa.Array
    scores: np.ndarray
    rate: float  # lambda
    log_k: float


def tokens_of(data: np.ndarray, borders: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words (letters, digits and all other than ASCII) of the rows, their borders, and where words begin."""
    rows = len(borders) - 1
    apart = np.full(len(data) + rows + 1, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(borders))
    apart[at] = LOWER[data]
    # Capital letters with accents follow the byte C3.
    accent = np.flatnonzero((apart[:-1] == 0xC3) & (apart[1:] >= 0x80) & (apart[1:] <= 0x9E) & (apart[1:] != 0x97)) + 1
    apart[accent] += 32
    word = apart != 32
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0], edges[1::2], edges[2::2] = 0, starts, ends
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(apart)])
    words = both.take(pa.array(np.arange(1, 2 * len(starts), 2))).cast(pa.binary())
    return words, np.searchsorted(starts, borders + np.arange(1, rows + 2)), starts


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), from left to right.

    Each segment knows the last one before it that begins at a lower sum, so that looking for one skips those between.
    """
    # Start, end, sum before, sum at the end, place of the last one with a lower sum before.
    found: list[tuple[int, int, float, float, int]] = []
    sums = np.append(0.0, np.cumsum(scores))
    for at in np.flatnonzero(scores > 0).tolist():
        start, before, end = at, sums[at], sums[at + 1]
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:
                k = found[k][4]
            if k < 0 or found[k][3] >= end:
                break
            # The segment from there on is better than both apart.
            start, _, before, _, below = found[k]
            del found[k:]
            k = below
        found.append((start, at + 1, before, end, k))
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


def expected(best: np.ndarray, n: int, rate: float, log_k: float) -> float:
    """How many sets of segments as good as the ``best`` (descending) are expected in n harmless tokens."""
    if not len(best):
        return math.inf
    sums, least = 0.0, math.inf
    for r, score in enumerate(best[:TOGETHER], 1):
        above = rate * score - log_k - math.log(max(n, LEAST_TOKENS))
        if above <= 0 and r > 1:
            break
        sums += above
        # Chance of r segments with this sum, and twice as much for each further one that was tried.
        chance = -sums + (r - 1) * math.log(max(sums, 1e-300)) - math.lgamma(r + 1) - math.lgamma(r) + (r - 1) * math.log(2)
        least = min(least, chance)
    return math.exp(min(least, 700))


def root_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum shares * exp(rate * scores) = 1."""
    low, high = 1e-6, 1.0
    value = lambda rate: float((shares * np.exp(np.minimum(rate * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def training_rows(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of about ``train_rows`` documents of each class. Of several labels the highest counts.

    Labels of documents that aren't there, without an id or other than 0 and 1 teach nothing; a document that comes
    several times is learned as often.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    share = F.when(F.col("toxic") == 1, min(1.0, train_rows / counts.get(1, 1))).otherwise(min(1.0, train_rows / counts.get(0, 1)))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    # Two times train_rows ids, about.
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def features(words: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Features of words, the most telling first, and which words have them: whole words, then their beginnings.

    A beginning is shorter than its word, so no occurrence of a word counts twice as the same feature.
    """
    yield _marked(words), np.arange(len(words))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    for k in BEGINNINGS:
        longer = np.flatnonzero(lengths > k)
        yield pc.binary_slice(words.take(pa.array(longer)), 0, k), longer


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a class a feature is, not how often: one that repeats a line says no more than another."""
    for batch in batches:
        for toxic in (0, 1):
            own = batch.filter(pc.equal(batch.column(1), toxic))
            data, borders = utf8(own.column(0))
            for low, high in steps(borders):
                words, at, _ = tokens_of(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low])
                row = np.repeat(np.arange(high - low), np.diff(at))
                for feature, which in features(words):
                    coded = feature.dictionary_encode()
                    once = np.unique(coded.indices.to_numpy().astype(np.int64) * (high - low) + row[which]) // (high - low)
                    kinds, n = np.unique(once, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(kinds), pa.int32()), coded.dictionary.take(pa.array(kinds)), pa.array(n)], ["toxic", "token", "n"])


def learn(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Token scores and the constants of the extreme-value law, from labelled documents."""
    rows = training_rows(documents, labels, train_rows)

    counted = rows.mapInArrow(_document_counts, "toxic int, token binary, n bigint").groupBy("token").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    of_class = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    all_bad, all_good = of_class.get(1, 0), of_class.get(0, 0)
    # Features of a bounded sample that may reach the z-score.
    table = counted.filter((F.col("bad") > 1) & (F.col("bad") * all_good > F.col("good") * all_bad)).toArrow()
    bad, good = table["bad"].to_numpy() + PRIOR, table["good"].to_numpy() + PRIOR
    odds = np.log(bad / (all_bad - bad + 2 * PRIOR)) - np.log(good / (all_good - good + 2 * PRIOR))
    kept = (odds >= LEAST_Z * np.sqrt(1 / bad + 1 / good)) & (odds > DRIFT)
    tokens, scores = table["token"].combine_chunks().filter(pa.array(kept)), odds[kept] - DRIFT
    # How often harmless documents have each score; as many rows as there are features, at most.
    harmless = rows.filter("toxic = 0").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    seen = harmless.mapInArrow(_score_counts(Lexicon(tokens, scores, 0.0, 0.0)), "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).toArrow()
    n = seen["n"].to_numpy()
    rate = root_rate(seen["score"].to_numpy(), n / max(1, n.sum()))
    lexicon = Lexicon(tokens, scores, rate, 0.0)
    # One row per training document: how many tokens, and its best segments.
    found = rows.select("toxic", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_best(lexicon), "toxic int, n int, best array<double>").toArrow()
    return Lexicon(tokens, scores, rate, _fitted_log_k(found, rate))


def _score_counts(lexicon: Lexicon) -> Batches:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores for scores, _, _ in _scored(batch.column(1), lexicon)]
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["score", "n"])

    return count


def _best(lexicon: Lexicon) -> Batches:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for scores, _, _ in _scored(batch.column(1), lexicon):
                n.append(len(scores))
                out.append(sorted((s for _, _, s in segments(scores)), reverse=True)[:TOGETHER])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.float64()))], ["toxic", "n", "best"])

    return best


def _fitted_log_k(found: pa.Table, rate: float) -> float:
    """The constant K at which a score of one half parts the training documents best.

    What counts is the share of toxic documents found and, twice, that of the others left alone.
    """
    toxic, n, best = found["toxic"].to_numpy(), found["n"].to_numpy(), found["best"].to_pylist()
    if not len(toxic):
        return 0.0

    def merit(log_k: float) -> float:
        said = np.array([expected(np.array(b), m, rate, log_k) <= math.log(2) for b, m in zip(best, n)])
        return float(said[toxic == 1].mean() + 2 * (~said[toxic == 0]).mean()) if 0 < toxic.sum() < len(toxic) else 0.0

    # Of equally good values the middle one.
    merits = [merit(log_k) for log_k in LOG_K]
    if max(merits) <= 2 and 0 < toxic.sum() < len(toxic):
        warnings.warn("no constant tells toxic training documents from others; no document will be called toxic", stacklevel=2)
    good = [log_k for log_k, m in zip(LOG_K, merits) if m >= max(merits) - 1e-12]
    return good[len(good) // 2]


def _scored(column: pa.Array, lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Token scores of each row; where its tokens begin, and where the row begins, in the same bytes."""
    data, borders = utf8(column)
    none = len(lexicon.scores)
    for low, high in steps(borders):
        words, at, starts = tokens_of(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low])
        which = np.full(len(words), none)
        for feature, own in features(words):
            code = pc.index_in(feature, value_set=lexicon.tokens).fill_null(none).to_numpy()
            which[own] = np.where(which[own] == none, code, which[own])
        scores = np.full(len(words), -DRIFT)
        hits = np.flatnonzero(which < none)
        scores[hits] = lexicon.scores[which[hits]]
        for row in range(high - low):
            yield scores[at[row] : at[row + 1]], starts[at[row] : at[row + 1]], int(borders[low + row] - borders[low]) + row + 1


def _marked(words: pa.Array) -> pa.Array:
    """Whole words, apart from equal beginnings."""
    return pc.binary_join_element_wise(pa.scalar(b"", words.type), words, pa.scalar(b"=", words.type))


def score(documents: DataFrame, lexicon: Lexicon, significant: float = 0.05) -> DataFrame:
    """doc_id, score, passages (start byte, token count, score) of every row.

    Passages are the segments that fewer than ``significant`` equally good ones are expected of in harmless text of
    that length. NULL, empty and wordless texts score 0 and have none. Texts are scanned whole. Repeated rows come as
    often as they are given, each with the same score; NULL ids are kept.
    """
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    passage = pa.struct([("start", pa.int64()), ("tokens", pa.int32()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores, passages = [], []
            for own, starts, base in _scored(batch.column(1), known):
                found = segments(own) if len(own) and own.max() > 0 else []
                best = np.array(sorted((s for _, _, s in found), reverse=True))
                scores.append(math.exp(-expected(best, len(own), known.rate, known.log_k)))
                passages.append([{"start": int(starts[a]) - base, "tokens": b - a, "score": s} for a, b, s in found if expected(np.array([s]), len(own), known.rate, known.log_k) < significant])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], ["doc_id", "score", "passages"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, "doc_id bigint, score double, passages array<struct<start: bigint, tokens: int, score: double>>")


def toxicity_digests(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Query 4: the toxicity of every document, learned from the labels of four fifths of them."""
    found = score(documents, learn(documents, labels.filter(fold("doc_id", 5) != 0)))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
