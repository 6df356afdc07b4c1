"""Language-model scores of documents by prediction by partial matching, and a unigram score to hold them against.

The model is a trie of byte contexts with counts from all training documents (see ``ppm``). A text is scored as its
lower-case words, parted by single spaces, and one end; the score is the log10 probability of all these bytes.
Every gram of the training text counts, however rare. Costs of grams above a share of all are sent to the tasks, at
most 1 / GRAM_HEAD_SHARE; the other grams of a document are joined with the table of all grams, which may grow
without bound.

The unigram score needs the count of every word of the corpus. Counts of words above a share of all tokens are sent
to the tasks: there are at most 1 / HEAD_SHARE of those, in a corpus of any size. The other words of a document are
joined with the counts table, which may grow without bound.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.llm import ppm
from postbag.llm.common import BATCH, SMALL_STEP_BYTES, fold, row_sums, steps, utf8
from postbag.session import pin

ORDER = 5
GRAM_HEAD_SHARE = 2.0**-24
HEAD_SHARE = 2.0**-20
SMOOTHING = 0.1
#: Words that a counting task holds.
HELD_WORDS = 250_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def normal(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as lower-case words with one space between them and a line feed at the end."""
    space = SPACE[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[borders[:-1]] = True
    after = np.append(True, space[:-1])  # after white space or at the start of a row
    after[np.flatnonzero(starts[:-1])] = True
    first = ~space & after
    lead = first.copy()
    # The first word of a row has no space before it.
    at = np.flatnonzero(first)
    row_of = np.searchsorted(borders, at, "right") - 1
    lead[at[np.append(True, row_of[1:] != row_of[:-1])[: len(at)]]] = False
    kept = ~space
    width = kept.astype(np.int64) + lead
    cum = np.append(0, np.cumsum(width))
    rows = len(borders) - 1
    new_borders = cum[borders] + np.arange(rows + 1)
    out = np.full(new_borders[-1], 32, np.uint8)
    place = cum[:-1] + lead + np.repeat(np.arange(rows), np.diff(borders))
    out[place[kept]] = LOWER[data[kept]]
    out[new_borders[1:] - 1] = 10
    return out, new_borders


def words_of(data: np.ndarray, borders: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of normalised rows, and how many each row has. The end of a row is no word here."""
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.append(0, ends[:-1] + 1)
    full = ends > starts
    flat = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    # Each word still has the byte that ends it.
    flat = pc.binary_slice(flat.cast(pa.large_binary()), 0, -1)
    per_row = np.add.reduceat(full, np.searchsorted(ends, borders[:-1])) if len(borders) > 1 else np.zeros(0, np.int64)
    return flat.filter(pa.array(full)), per_row.astype(np.int64)


def _normalised(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, borders = utf8(column)
    for low, high in steps(borders, SMALL_STEP_BYTES):
        yield low, high, *normal(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows; the end of a text is the NULL word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, rows = [], 0, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns(["word", "n"]).combine_chunks().to_batches()[0]

        for batch in batches:
            rows += batch.num_rows
            for _, _, data, borders in _normalised(batch.column(0)):
                counts = words_of(data, borders)[0].value_counts()
                word = counts.field("values").cast(pa.binary())
                parts.append(pa.RecordBatch.from_arrays([word, counts.field("counts")], ["word", "n"]))
                held += len(word)
                if held > HELD_WORDS:
                    parts = [out()]
                    held = parts[0].num_rows
                    if held > HELD_WORDS // 2:
                        yield parts[0]
                        parts, held = [], 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([rows], pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = ((None, ppm.padded(data, borders, order)) for batch in batches for _, _, data, borders in _normalised(batch.column(0)))
        for batch in ppm.counted(grams, ["name", "gram", "n"]):
            yield batch.select(["gram", "n"])

    return texts.select("text").mapInArrow(count, "gram bigint, n bigint")


def distinct_in_rows(grams: np.ndarray, at: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the ``grams`` at some places: the distinct ones of each row, how often each stands there, and the rows' borders."""
    row, own = np.searchsorted(borders, at, "right") - 1, grams[at]
    order = np.lexsort((own, row))
    row, own = row[order], own[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    return own[first], np.diff(np.append(first, len(own))), np.searchsorted(row[first], np.arange(len(borders)))


def head_costs(counts: DataFrame, total: int) -> tuple[ppm.GramTable, np.ndarray]:
    """Bits of the frequent grams, at most 1 / GRAM_HEAD_SHARE, and a 0 for all others. Each was seen in its longest context, and codes there."""
    context = F.shiftrightunsigned("gram", 8).alias("context")
    head = counts.filter(F.col("n") >= total * GRAM_HEAD_SHARE).select(context, "gram", "n")
    every = counts.groupBy(context).agg(F.sum("n").alias("all"))
    table = head.join(every, "context").select("gram", "n", "all").toArrow()
    bits = -np.log2((table["n"].to_numpy() - ppm.DISCOUNT) / table["all"].to_numpy())
    return ppm.GramTable(table["gram"].to_numpy().astype(np.uint64)), np.append(bits, 0.0)


def scores(documents: DataFrame, training: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``documents``, learned from ``training``.

    A NULL or empty text is its end alone. Repeated rows and NULL ids are rows of their own. With no training
    documents every byte costs 8 bits, and base_score is that of N = V = 0.
    """
    spark = documents.sparkSession
    words = pin(count_words(training), "words", **BATCH)
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("V"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0)).alias("ends")).first()
    total, kinds, ends = sums["N"], (sums["V"] or 0), sums["ends"]
    words = words.filter("word IS NOT NULL AND c > 0")
    # At most 1 / HEAD_SHARE rows.
    head = words.filter(F.col("c") >= total * HEAD_SHARE).toArrow()
    below = total + SMOOTHING * (kinds + 1)
    grams = pin(count_grams(training, order).groupBy("gram").agg(F.sum("n").alias("n")), "grams", **BATCH)
    bytes_ = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast((*head_costs(grams, bytes_), head["word"].combine_chunks(), head["c"].to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, names, counts = shared.value
        each = np.append(np.log10((counts + SMOOTHING) / below), 0.0)
        end = np.log10((ends + SMOOTHING) / below)
        row_id = secrets.randbits(62)
        for batch in batches:
            for low, high, data, borders in _normalised(batch.column(1)):
                flat, per_row = words_of(data, borders)
                flat, rows = flat.cast(pa.binary()), high - low
                found = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy()
                at = np.append(0, np.cumsum(per_row))
                rare = np.flatnonzero(found < 0)
                rare_borders = np.searchsorted(np.searchsorted(at, rare, "right") - 1, np.arange(rows + 1))
                own = ppm.padded(data, borders, order)
                place = known.find(own)
                odd, odd_n, odd_borders = distinct_in_rows(own, np.flatnonzero(place < 0), borders)
                odd = pa.StructArray.from_arrays([pa.array(odd.astype(np.int64)), pa.array(odd_n)], ["gram", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row_id + np.arange(rows)),
                        batch.column(0)[low:high],
                        pa.array(per_row + 1),
                        pa.array(row_sums((found >= 0).astype(np.int64), at).astype(np.int64) + (ends > 0)),
                        pa.array(row_sums(each[found], at) + end),
                        pa.array(row_sums(bits[place], borders)),
                        pa.ListArray.from_arrays(pa.array(rare_borders, pa.int32()), flat.take(pa.array(rare))),
                        pa.ListArray.from_arrays(pa.array(odd_borders, pa.int32()), odd),
                    ],
                    ["row_id", "doc_id", "n_tokens", "n_head", "head_score", "head_bits", "rare", "odd"],
                )
                row_id += rows

    schema = "row_id bigint, doc_id bigint, n_tokens bigint, n_head bigint, head_score double, head_bits double, rare array<binary>, odd array<struct<gram: bigint, n: bigint>>"
    # Row numbers are drawn once, and fixed by writing them.
    scored = pin(documents.select("doc_id", "text").mapInArrow(score, schema), "lm-scores", **BATCH)
    rare = scored.select("row_id", F.explode("rare").alias("word")).join(words.filter(F.col("c") < total * HEAD_SHARE), "word")
    rare = rare.groupBy("row_id").agg(F.count("*").alias("known"), F.sum(F.log10((F.col("c") + SMOOTHING) / below) - float(np.log10(SMOOTHING / below))).alias("gain"))
    odd = scored.select("row_id", F.explode("odd").alias("odd")).select("row_id", "odd.*")
    costs = ppm.costs(grams, odd.select("gram").distinct(), ppm.short_levels(grams, order), order)
    odd = odd.join(costs, "gram").groupBy("row_id").agg(F.sum(F.col("n") * F.col("bits")).alias("odd_bits"))
    joined = scored.withColumn("n_rare", F.size("rare")).drop("rare", "odd").join(rare, "row_id", "left").join(odd, "row_id", "left")
    known, gain = F.coalesce("known", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    base = F.col("head_score") + F.col("n_rare") * float(np.log10(SMOOTHING / below)) + gain
    score = (F.col("head_bits") + F.coalesce("odd_bits", F.lit(0.0))) * -float(np.log10(2))
    return joined.select("doc_id", "n_tokens", (F.col("n_head") + known).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def lm_digests(documents: DataFrame) -> DataFrame:
    """Query 8: scores of all documents, learned from nine tenths of them."""
    found = scores(documents, documents.filter(fold("doc_id", 10) != 0))
    return found.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
