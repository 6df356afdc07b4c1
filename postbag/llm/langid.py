"""Language identification by prediction by partial matching.

Each language has a context trie of its own, learned from labelled documents and then frozen. A text belongs to the
language whose trie codes it in the fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.llm import ppm
from postbag.llm.common import SMALL_STEP_BYTES, fold, pieces, steps, utf8
from postbag.session import pin

ORDER = 4
#: Of each language about so many documents train, chosen by hash.
TRAIN_ROWS = 2000
#: So many languages' counts are broadcast; those of more are joined by shuffling.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
#: A text that takes more bits for a byte than this in every language, more than its plain bytes, is in none of them.
MOST_BITS = 8.0


class Languages:
    def __init__(self, names: list[str], model: ppm.Model):
        self.names, self.model = names, model


def training_rows(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """text and lang of about ``train_rows`` documents of each language, of rarer ones all; one at least.

    Chosen by a hash of id and text, so copies of a text are chosen apart.
    """
    key = [c for c in ("doc_id",) if c in labelled.columns]
    place = F.pmod(F.xxhash64(*key, "text"), F.lit(1 << 30)).alias("place")
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("text", "lang", place)
    counts = pin(labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")), "languages")
    # One row a language.
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    share = F.least(F.lit(1.0), F.lit(float(train_rows)) / F.col("n")) * float(1 << 30)
    return labelled.join(counts, "lang").filter((F.col("place") < share) | (F.col("place") == F.col("least"))).select("text", "lang")


def learn(labelled: DataFrame, order: int = ORDER, train_rows: int = TRAIN_ROWS) -> Languages:
    """Tries of all languages of ``labelled`` (text, lang, maybe doc_id), from a bounded sample of each."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for lang in batch.column(1).unique().to_pylist():
                    own = batch.filter(pa.compute.equal(batch.column(1), lang))
                    data, borders = utf8(own.column(0))
                    for low, high in steps(borders, SMALL_STEP_BYTES):
                        yield lang, ppm.padded(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low], order)

        yield from ppm.counted(parts(), ["lang", "gram", "n"])

    counts = training_rows(labelled, train_rows).mapInArrow(grams, "lang string, gram bigint, n bigint")
    # All grams of the sample, which is bounded for each language.
    table = ppm.trie_counts(counts, order, 0.0, ["lang"]).toArrow()
    names = sorted(table["lang"].unique().to_pylist())
    levels = [ppm.levels_of(table.filter(pa.compute.equal(table["lang"], name)), order) for name in names]
    return Languages(names, ppm.Model(levels, order))


def identify(documents: DataFrame, languages: Languages, text: Column | None = None) -> DataFrame:
    """All columns of ``documents`` (in struct ``doc``), lang_pred, score, bits_per_byte.

    lang_pred is ``und`` with score 0 if the text is NULL, has no letter, or no language was learned. Otherwise the
    score is the probability of the language, all being equally likely beforehand; equal code lengths go to the name
    that sorts first. Whole texts are coded, however long.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((languages.names, languages.model))
    text = F.col("text") if text is None else text
    kept = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*kept).alias("doc"), F.coalesce(text, F.lit("")).alias("body"))
    rows = rows.select("doc", F.when(F.col("body").rlike(r"\p{L}"), F.col("body")).otherwise("").alias("body"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in pieces(batches):
            data, borders = utf8(batch.column(1))
            bits = np.zeros((batch.num_rows, max(1, len(names))))
            if names:
                for low, high in steps(borders, SMALL_STEP_BYTES):
                    bits[low:high] = model.bits(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low])
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            lengths = np.diff(borders)
            coded = (lengths > 0) & bool(names)
            score = np.where(coded, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
            named = pa.array(np.append(np.array(names, object), UNKNOWN)[np.where(coded, best, len(names))], pa.string())
            each = pa.array(np.where(coded, least / np.maximum(lengths, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), named, pa.array(score), each], ["doc", "lang_pred", "score", "bits_per_byte"])

    out = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return rows.mapInArrow(predict, out)


def learned_from(documents: DataFrame) -> Languages:
    return learn(documents.filter(fold("doc_id", 4) != 2))


def language_digests(documents: DataFrame) -> DataFrame:
    """Query 6: the language of every document, learned from three quarters of them."""
    found = identify(documents.select("doc_id", "text"), learned_from(documents))
    doc_id = F.col("doc.doc_id")
    held_out = (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2
    return found.select(doc_id.alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_known_languages(documents: DataFrame, languages: Languages | None = None, most_bits: float = MOST_BITS) -> DataFrame:
    """The documents, as they are, that are in one of the learned languages."""
    found = identify(documents, languages or learned_from(documents))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= most_bits)).select("doc.*")
