"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All but the last
return the columns of documents; what they decide takes effect in the rows: documents go, lose repeated passages or
come several times. The last returns packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postbag.llm.common import table
from postbag.llm.langid import keep_known_languages
from postbag.llm.mixing import mixed
from postbag.llm.near_dups import keep_one_of_each
from postbag.llm.packing import packed
from postbag.llm.substrings import without_repeats
from postbag.session import pin


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from them; NULL and letterless texts go."""
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that an earlier one has."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in sequences."""
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Empty input gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Language models, similarity classes and token ids are beyond SQL.
ORACLE_SQL = None
